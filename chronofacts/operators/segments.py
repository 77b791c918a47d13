"""Running values over the rows of a key, where one key may hold most of the rows.

A window over a key sorts all its rows in one task. Here a range exchange by key and order deals the rows into parts, so that a large key spans many
parts and a part holds stretches of keys; each (key, part) is summed up to one row, the short table of these is scanned by key, and every part is
finished on its own from what the parts before it amount to. The short table has one row for each key and one more for each further part of it.

Keys may be null (null is a key). Rows that agree in key and order stay in one part, so ``order`` should tell rows apart, or equal rows be counted first.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.facts import stored_table

#: Pieces into which the candidates of one key and place can be cut.
TIES = 4096
#: Aggregates that can be carried: how a part is summed up, and how two summaries combine (null: nothing yet).
COMBINE: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
}


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_part`` and, in place of the keys, ``_key`` (a struct of them): parts ascend with key and order. Stored, as the parts must stay what they are."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return stored_table(dealt.select(F.struct(*keys).alias("_key"), *(c for c in rows.columns if c not in keys), F.spark_partition_id().alias("_part")))


def _carried(rows: DataFrame, aggregates: dict[str, tuple[str, Column]], later: bool = False) -> DataFrame:
    """``rows`` with ``_c_<name>``: the aggregate over the key's parts before (or behind) the row's own."""
    parts = rows.groupBy("_key", "_part").agg(*(COMBINE[kind][0](c).alias(name) for name, (kind, c) in aggregates.items()))
    w = Window.partitionBy("_key").orderBy("_part")
    w = w.rowsBetween(1, Window.unboundedFollowing) if later else w.rowsBetween(Window.unboundedPreceding, -1)
    short = parts.select("_key", "_part", *(COMBINE[kind][0](F.col(name)).over(w).alias(f"_c_{name}") for name, (kind, _) in aggregates.items()))
    return rows.join(short, ["_key", "_part"])


def running(rows: DataFrame, order: Sequence[str | Column], inclusive: bool = True, **aggregates: tuple[str, Column]) -> DataFrame:
    """``ranged`` rows with, for each ``name=(kind, column)``, the aggregate over the key's rows up to this one (or before it); null where there is none."""
    w = Window.partitionBy("_key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    found = _carried(rows, aggregates)
    return found.withColumns({name: COMBINE[kind][1](F.col(f"_c_{name}"), COMBINE[kind][0](c).over(w)) for name, (kind, c) in aggregates.items()}).drop(*(f"_c_{n}" for n in aggregates))


def following(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``ranged`` rows with the key's next value of ``order``; null for the last."""
    w = Window.partitionBy("_key", "_part").orderBy(order)
    return _carried(rows, {name: ("min", F.col(order))}, later=True).withColumn(name, F.coalesce(F.lead(order).over(w), F.col(f"_c_{name}"))).drop(f"_c_{name}")


def bare(rows: DataFrame) -> DataFrame:
    """Scanned rows with their keys again and without the parts."""
    return rows.select("_key.*", *(c for c in rows.columns if c not in ("_key", "_part")))


def row_number(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the place of each among its key's rows in ``order``, from 1."""
    return bare(running(ranged(rows, keys, order), order, **{name: ("sum", F.lit(1).cast("long"))})).select(*rows.columns, name)


def best_before(candidates: DataFrame, anchors: DataFrame, keys: Sequence[str], at: str, value: str, name: str) -> DataFrame:
    """``candidates`` (keys, ``at``, others) with the largest ``value`` of the key's ``anchors`` (keys, ``at``, ``value``) whose ``at`` is not larger; null if there is none.

    Only the largest value of each place takes part. Candidates and anchors are sorted together and scanned once: no pairs arise, whatever the number of
    anchors, and a hot key is cut like any other.
    """
    frontier = anchors.groupBy(*keys, at).agg(F.max(value).alias("_value")).withColumn("_side", F.lit(0))
    columns = [F.col(c) for c in candidates.columns]
    rest = [c for c in candidates.columns if c not in (*keys, at)]
    both = candidates.select(*columns, F.lit(None).cast(frontier.schema["_value"].dataType).alias("_value"), F.lit(1).alias("_side"), F.pmod(F.xxhash64(*columns), F.lit(TIES)).cast("int").alias("_tie"))
    both = both.unionByName(frontier.withColumn("_tie", F.lit(0)), allowMissingColumns=True)
    order = [at, "_side", "_tie"]
    seen = running(ranged(both, keys, order), order, **{name: ("max", F.col("_value"))})
    return bare(seen.where("_side = 1")).select(*keys, at, *rest, name)
