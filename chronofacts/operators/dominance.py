"""Counting points below and to the left of others, for keys of any size.

For each query (s, e) of a key: how many of the key's points have a smaller s and a smaller e. Points and queries are dealt into columns by s and into rows by e
(range exchanges, so a hot key has many of both; equal values stay together). What lies in an earlier column and an earlier row is the sum of whole cells, read
from a running sum over the grid; the rest lies in the query's own column, or in its own row in an earlier column. Both are counted inside a strip, which is the size of a part and not of a key.
Where only one of the two is asked for, a running sum over parts of keys (``segments``) is enough, and where neither is, a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.facts import stored_table
from . import segments

#: Rows of a strip, on average, that one Python task holds.
STRIP_ROWS = 400_000


def below(ranks: np.ndarray, weights: np.ndarray, first: np.ndarray, last: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each query, the weight of the places from ``first`` to below ``last`` whose rank is below the limit: a wavelet matrix, one pass for each bit."""
    out, lo, hi = np.zeros(len(limits), np.int64), first.copy(), last.copy()
    for bit in range(int(max(limits.max(initial=0), ranks.max(initial=0))).bit_length() - 1, -1, -1):
        zero = (ranks >> bit & 1) == 0
        before = np.concatenate(([0], np.cumsum(zero)))
        sums = np.concatenate(([0], np.cumsum(np.where(zero, weights, 0))))
        one = (limits >> bit & 1) == 1
        out += np.where(one, sums[hi] - sums[lo], 0)
        lo, hi = (np.where(one, before[-1] + x - before[x], before[x]) for x in (lo, hi))
        ranks, weights = np.concatenate((ranks[zero], ranks[~zero])), np.concatenate((weights[zero], weights[~zero]))
    return out


def _strip(by: str, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of one partition, a strip: its rows with its number as ``name``, and ``found`` larger by the points of the query's key whose ``by`` and ``e`` are both smaller than the query's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        column = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
        key = table["key"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        query, at, e, n, total = column("_query") >= 0, column(by), column("e"), column("n"), column("found").copy()
        point = ~query
        places, ends = np.unique(at[point]), np.unique(e[point])
        # Keys one after another, each by its places, as one number.
        step = len(places) + 1
        where = key * step + np.searchsorted(places, at)
        order = np.argsort(where[point], kind="stable")
        where_points, ranks, weights = where[point][order], np.searchsorted(ends, e[point])[order], n[point][order]
        first, last = np.searchsorted(where_points, key[query] * step), np.searchsorted(where_points, where[query])
        total[query] += below(ranks, weights, first, last, np.searchsorted(ends, e[query]))
        strip = pa.array(np.full(table.num_rows, TaskContext.get().partitionId(), np.int32))
        out = table.set_column(table.schema.get_field_index("found"), "found", pa.array(total)).append_column(name, strip)
        yield from out.to_batches(max_chunksize=65_536)

    return run


def _on_a_line(points: DataFrame, queries: DataFrame, *axis: str) -> DataFrame:
    """``counts`` by one axis, or by the key alone: a running sum over parts of keys, or a join. No row of it goes to Python."""
    places = points.select("key", *axis, "n")
    if axis:
        places = places.unionByName(queries.select("key", *axis, F.lit(0).cast("long").alias("n"))).where("key IS NOT NULL")
    found = places.groupBy("key", *axis).agg(F.sum("n").alias("n"))
    if axis:
        found = segments.bare(segments.running(segments.ranged(found, ["key"], axis), axis, inclusive=False, found=("sum", F.col("n"))).drop("n"))
    else:
        found = found.withColumnRenamed("n", "found")
    return queries.join(found.where("found > 0"), ["key", *axis]).select("query", "found")


def counts(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, found): ``points`` (key, s, e, n as longs), ``queries`` (key, query, s, e as longs; query unique, 0 or more). Queries that find nothing are left out.

    A null key matches nothing. s and e of a point count when smaller than the query's; either or both may be missing from points and queries, and then nothing is asked of them. A strip holds about ``STRIP_ROWS`` rows, whatever the keys and the size of the tables;
    rows of a key that agree in s, or in e, stay together, so many of them should be one point or one query.
    """
    axes = [a for a in ("s", "e") if a in points.columns]
    if len(axes) < 2:
        return _on_a_line(points, queries, *axes)
    none = F.lit(0).cast("long")
    both = points.select("key", "s", "e", "n", F.lit(-1).cast("long").alias("_query"), none.alias("found")).unionByName(queries.select("key", "s", "e", none.alias("n"), F.col("query").alias("_query"), none.alias("found"))).where("key IS NOT NULL")
    kind = both.schema["key"].dataType.simpleString()
    # As many strips as the rows need: left to the size of shuffled bytes, a strip of small rows would outgrow a Python task.
    strips = max(both.sparkSession.sparkContext.defaultParallelism, -(-both.count() // STRIP_ROWS))
    columns = both.repartitionByRange(strips, "key", "s").mapInArrow(_strip("s", "_column"), f"key {kind}, s long, e long, n long, _query long, found long, _column int").drop("s")
    rows = stored_table(columns).repartitionByRange(strips, "key", "e").mapInArrow(_strip("_column", "_row"), f"key {kind}, e long, n long, _query long, found long, _column int, _row int")
    grid = stored_table(rows.drop("e"))
    # One row for each cell of the grid that a key reaches: few, but for hot keys, and at most parts times parts for one of them.
    cells = grid.groupBy("key", "_column", "_row").agg(F.sum("n").alias("n"))
    dense = cells.select("key", "_column").distinct().join(cells.select("key", "_row").distinct(), "key").join(cells, ["key", "_column", "_row"], "left")
    left = Window.partitionBy("key", "_row").orderBy("_column").rowsBetween(Window.unboundedPreceding, -1)
    under = Window.partitionBy("key", "_column").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    sums = dense.withColumn("left", F.sum("n").over(left)).withColumn("found", F.sum("left").over(under)).where("found > 0").select("key", "_column", "_row", "found")
    asked = grid.where("_query >= 0").join(sums.withColumnRenamed("found", "_whole"), ["key", "_column", "_row"], "left")
    return asked.select(F.col("_query").alias("query"), (F.col("found") + F.coalesce("_whole", none)).alias("found")).where("found > 0")
