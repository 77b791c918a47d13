"""Interval algebra over facts with ``start`` and ``end`` days, grouped by key columns."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.facts import stored_table
from . import dominance, segments


def union(facts: DataFrame, *keys: str) -> DataFrame:
    """Islands of each group: intervals that overlap or touch at a day merge; adjacent days do not. Facts without a start or an end take no part.

    A group may hold most of the facts: equal starts are one row with their latest end first, and the running ends go over parts of the group (``segments``).
    """
    spans = facts.where(F.col("start").isNotNull() & F.col("end").isNotNull()).groupBy(*keys, "start").agg(F.max("end").alias("end"))
    seen = segments.running(segments.ranged(spans, keys, ["start"]), ["start"], inclusive=False, _seen=("max", F.col("end")))
    begins = F.when(F.coalesce(F.col("start") <= F.col("_seen"), F.lit(False)), F.lit(None)).otherwise(F.col("start"))
    placed = segments.bare(segments.running(seen.withColumn("_begins", begins), ["start"], _island=("max", F.col("_begins"))))
    return placed.groupBy(*keys, "_island").agg(F.max("end").alias("end")).select(*keys, F.col("_island").alias("start"), "end")


def intersection(facts: DataFrame, key: str, *members: str) -> DataFrame:
    """Where all members of a key hold at once: each member's islands first, then a sweep over their boundaries, a step for each day at which cover changes."""
    islands = union(facts, key, *members)
    sizes = islands.select(key, *members).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_groups"))
    edges = islands.select(key, F.explode(F.array(F.struct(F.col("start").alias("day"), F.lit(1).alias("step")), F.struct(F.date_add("end", 1).alias("day"), F.lit(-1).alias("step")))).alias("e")).select(key, "e.*")
    steps = segments.ranged(edges.groupBy(key, "day").agg(F.sum("step").alias("step")), [key], ["day"])
    cover = segments.following(segments.running(steps, ["day"], _cover=("sum", F.col("step"))), "day", "_next")
    return segments.bare(cover).join(sizes, key).where("_cover = _groups AND _next IS NOT NULL").select(key, F.col("day").alias("start"), F.date_sub("_next", 1).alias("end"))


def common_interval(facts: DataFrame, *keys: str) -> DataFrame:
    """The one interval that all of a group's facts share; none if they don't."""
    return facts.groupBy(*keys).agg(F.max("start").alias("start"), F.min("end").alias("end")).where("start <= end")


def total_duration(facts: DataFrame, key: str, *members: str, merge: bool = True) -> DataFrame:
    """Days of each key's facts; with ``merge``, the overlaps of a member's facts count once."""
    parts = union(facts, key, *members) if merge else facts
    return parts.groupBy(key).agg(F.sum(F.datediff("end", "start").cast("long")).alias("days"))


def average_days(days: Column, mode: str = "floor") -> Column:
    """Average of whole days: ``floor``, ``round`` (half to even) or ``decimal`` (two digits)."""
    mean = F.sum(days) / F.count(days)
    return {"floor": F.floor(mean).cast("long"), "round": F.bround(mean, 0).cast("long"), "decimal": F.round(mean, 2)}[mode]


def average_duration(facts: DataFrame, key: str, *members: str, mode: str = "floor") -> DataFrame:
    parts = union(facts, key, *members).groupBy(key, *members).agg(F.sum(F.datediff("end", "start").cast("long")).alias("_days"))
    return parts.groupBy(key).agg(average_days(F.col("_days"), mode).alias("days"))


def compare(first: Column, second: Column) -> Column:
    """longer, shorter or equals."""
    return F.when(first > second, "longer").when(first < second, "shorter").when(first == second, "equals")


def ranked(facts: DataFrame, key: str, days: Column, position: str, longest: bool = True) -> DataFrame:
    """``duration_rank`` without ties: equal durations by position."""
    by = days.desc() if longest else days.asc()
    return facts.withColumn("duration_rank", F.row_number().over(Window.partitionBy(key).orderBy(by, position)))


def extremes(facts: DataFrame, key: str, days: Column, position: str, longest: bool = True, ties: str = "all") -> DataFrame:
    """The longest (or shortest) of each key. Ties: ``all``, the ``first`` by position, or none (``exception``)."""
    by = days.desc() if longest else days.asc()
    w = Window.partitionBy(key)
    out = facts.withColumn("_rank", F.rank().over(w.orderBy(by))).where("_rank = 1")
    if ties == "first":
        out = out.withColumn("_n", F.row_number().over(w.orderBy(position))).where("_n = 1").drop("_n")
    elif ties == "exception":
        out = out.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").drop("_n")
    return out.drop("_rank")


def rank_by_time(facts: DataFrame, key: str, time: str, position: str) -> DataFrame:
    """``time_rank``: earliest is 1; equal times by position."""
    return facts.withColumn("time_rank", F.row_number().over(Window.partitionBy(key).orderBy(time, position)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, days: int = 366) -> DataFrame:
    """Pairs of facts of one key that overlap, from ``l_start, l_end`` and ``r_start, r_end``.

    Intervals are dealt into buckets of ``days``, which makes an equi join of the inequality; a pair counts in the bucket of the later start only.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    spread = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(a)), bucket(F.col(b)))))
    pairs = spread(left, "l_start", "l_end").join(spread(right, "r_start", "r_end"), [key, "_bucket"])
    return pairs.where((F.col("l_start") <= F.col("r_end")) & (F.col("l_end") >= F.col("r_start")) & (F.col("_bucket") == bucket(F.greatest("l_start", "r_start")))).drop("_bucket")


#: For each interval relation of predicates.ALLEN, where the second interval (ys, ye) must lie: ys and ye from a bound on to below another; None is open.
REGIONS = {
    "before": lambda xs, xe: (xe + 1, None, None, None),
    "after": lambda xs, xe: (None, None, None, xs),
    "equal": lambda xs, xe: (xs, xs + 1, xe, xe + 1),
    "during": lambda xs, xe: (None, xs + 1, xe, None),
    "contains": lambda xs, xe: (xs, None, None, xe + 1),
    "overlaps": lambda xs, xe: (xs + 1, xe + 1, xe + 1, None),
    "overlapped_by": lambda xs, xe: (None, xs, xs, xe),
    "starts": lambda xs, xe: (xs, xs + 1, xe, None),
    "started_by": lambda xs, xe: (xs, xs + 1, None, xe + 1),
    "finishes": lambda xs, xe: (None, xs + 1, xe, xe + 1),
    "finished_by": lambda xs, xe: (xs, None, xe, xe + 1),
    "meets": lambda xs, xe: (xe, xe + 1, None, None),
    "metby": lambda xs, xe: (None, None, xs, xs + 1),
}


def _bounded(facts: DataFrame, key: str, relation: str) -> DataFrame:
    """A key's different intervals with the region (low, high, least, most) of their partners, as days; null bounds are open."""
    day = lambda c: F.unix_date(c).cast("long")
    bounds = dict(zip(("low", "high", "least", "most"), REGIONS[relation](F.col("s"), F.col("e")), strict=True))
    spans = facts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.col("start").alias("_start"), F.col("end").alias("_end")).agg(F.count(F.lit(1)).alias("n"))
    spans = spans.select("key", "_start", "_end", "n", day(F.col("_start")).alias("s"), day(F.col("_end")).alias("e"))
    asked = [F.col(c) for c, ends in (("s", ("low", "high")), ("e", ("least", "most"))) if any(bounds[x] is not None for x in ends)]
    known = F.lit(True)
    for b in bounds.values():
        known = known & (b.isNotNull() if b is not None else F.lit(True))
    # A region that ends before it begins, as intervals that end before they start have, holds nothing.
    for low, high in (("low", "high"), ("least", "most")):
        if bounds[low] is not None and bounds[high] is not None:
            known = known & (bounds[low] < bounds[high])
    none = F.lit(None).cast("long")
    return spans.withColumn("_asks", known).withColumns({k: b if b is not None else none for k, b in bounds.items()}).withColumn("_takes", functools.reduce(lambda x, y: x & y, (c.isNotNull() for c in asked)))


#: A bound that is open above.
TOP = 1 << 40
_BOUNDS = ("low", "high", "least", "most")


def _axes(relation: str) -> tuple[list[str], list[str]]:
    """Of s and e: those that a relation fixes to one day of a partner, which can be part of the key, and those of which it asks a range. The only day asked for is a range."""
    low, high, least, most = REGIONS[relation](0, 100)
    asked = {a: ends for a, ends in (("s", (low, high)), ("e", (least, most))) if ends != (None, None)}
    fixed = [a for a, (x, y) in asked.items() if len(asked) == 2 and x is not None and y == x + 1]
    return fixed, [a for a in asked if a not in fixed]


def _corners(relation: str) -> tuple[dict[tuple[str, ...], list[tuple[int, str | None, str | None, int]]], bool]:
    """The corners (number, bound of s, bound of e, sign) whose counts add up to a region's, by the days of the interval that they rest on; and whether they are counted from above.

    That is so for one range that is open above, which is one count from there and two from below.
    """
    fixed, ranged = _axes(relation)
    bounds = dict(zip(_BOUNDS, REGIONS[relation](0, 100), strict=True))
    ends = {"s": _BOUNDS[:2], "e": _BOUNDS[2:]}
    low, high, least, most = (n if bounds[n] is not None and any(n in ends[a] for a in ranged) else None for n in _BOUNDS)
    above = len(ranged) == 1 and high is None and most is None
    if above:
        used = [(low, least, 1)]
    else:
        used = [(high, most, 1)] + [(low, most, -1)] * (low is not None) + [(high, least, -1)] * (least is not None) + [(low, least, 1)] * (low is not None and least is not None)
    moved = {day: dict(zip(_BOUNDS, REGIONS[relation](*at), strict=True)) for day, at in (("s", (7, 100)), ("e", (0, 107)))}
    found: dict[tuple[str, ...], list[tuple[int, str | None, str | None, int]]] = {}
    for k, (s, e, sign) in enumerate(used):
        on = [s, e, *(ends[a][0] for a in fixed)]
        found.setdefault(tuple(day for day in ("s", "e") if any(b is not None and moved[day][b] != bounds[b] for b in on)), []).append((k, s, e, sign))
    return found, above


def relation_counts(facts: DataFrame, key: str, relation: str, partners: DataFrame | None = None) -> DataFrame:
    """(key, start, end, n, matches): a key's different intervals, how many facts have each, and to how many ``partners`` of the key (by default all facts, itself too) it stands in the relation.

    The join is counted, not made: the partners of an interval fill a range of starts and a range of ends, whose count is a sum of at most four counts of points below and
    left of a corner (``dominance``); these are shared out over a grid, so no task holds a key. Where a relation fixes a start or an end, that day is part of the key and one range or none is left,
    which needs no grid. A corner that rests on one day of the interval is asked once for each such day of the key,
    and days that nothing is asked of are summed up first, so that the rows of a key that share a place are as few as its days. A day that the relation asks for must not be null.
    """
    spans = stored_table(_bounded(facts, key, relation).withColumn("id", F.monotonically_increasing_id()))
    others = spans if partners is None else _bounded(partners.select(F.col(key), "start", "end"), key, relation)
    fixed, ranged = _axes(relation)
    corners, above = _corners(relation)
    first = {"s": "low", "e": "least"}
    within = lambda days: F.struct("key", *(F.col(days[a]).alias(a) for a in fixed)).alias("key") if fixed else F.col("key")
    points = others.where("_takes").select(within({"s": "s", "e": "e"}), *((-F.col(a) if above else F.col(a)).alias(a) for a in ranged), "n")
    if len(fixed + ranged) < 2:
        points = points.groupBy("key", *ranged).agg(F.sum("n").alias("n"))
    if partners is not None or len(fixed + ranged) < 2:
        points = stored_table(points)
    asks, out, parts = spans.where("_asks"), spans, []
    at = lambda b: F.lit(TOP) if b is None else 1 - F.col(b) if above else F.col(b)
    kinds = list(corners)
    total = zero = F.lit(0).cast("long")
    for kind, on in enumerate(kinds):
        needed = [b for b in _BOUNDS if any(b in c[1:3] for c in corners[on]) or b in [first[a] for a in fixed]]
        rows = asks if len(on) == 2 else stored_table(asks.select("key", *on, *needed).distinct().withColumn("id", F.monotonically_increasing_id()))
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), at(s).alias("s"), at(e).alias("e")) for k, s, e, _ in corners[on])))
        parts.append((on, rows, rows.select(within(first), "id", each.alias("c")).select("key", (F.col("id") * 16 + kind * 4 + F.col("c.k")).alias("query"), *(f"c.{a}" for a in ranged))))
    found = dominance.counts(points, functools.reduce(DataFrame.unionByName, [q for _, _, q in parts]))
    negative = [kind * 4 + k for kind, on in enumerate(kinds) for k, _, _, sign in corners[on] if sign < 0]
    signed = F.when((F.col("query") % 16).isin(*negative), -F.col("found")).otherwise(F.col("found"))
    sums = found.groupBy(F.floor(F.col("query") / 16).cast("long").alias("id"), F.floor(F.col("query") % 16 / 4).cast("int").alias("_kind")).agg(F.sum(signed).alias("_sum"))
    if len(parts) > 1:
        sums = stored_table(sums)
    for kind, (on, rows, _) in enumerate(parts):
        mine = sums.where(F.col("_kind") == kind).select("id", F.col("_sum").alias(f"_m{kind}"))
        if len(on) == 2:
            out = out.join(mine, "id", "left")
        else:
            out = out.join(rows.join(mine, "id").select("key", *on, f"_m{kind}"), ["key", *on], "left")
        total = total + F.coalesce(F.col(f"_m{kind}"), zero)
    matches = F.when(F.col("_asks"), total).otherwise(zero)
    return out.select(F.col("key").alias(key), F.col("_start").alias("start"), F.col("_end").alias("end"), "n", matches.cast("long").alias("matches"))


def _totals_inside(relation: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of one strip (key, tail, start, end): a row (key, pairs, tails) for each key that is surely whole, and the facts of the others as they are, with null ``pairs``.

    The first and the last key of a strip may go on in the next one. A key with a null day is left to the others too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        coded = table["key"].combine_chunks().dictionary_encode()
        names, key = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        cut, ends = np.zeros(len(names), bool), pc.min_max(names)
        cut[pc.index_in(pa.array([ends["min"].as_py(), ends["max"].as_py()], names.type), value_set=names).to_numpy()] = True
        cut[key[pc.or_(pc.is_null(table["start"]), pc.is_null(table["end"])).to_numpy()]] = True
        left = table.filter(pa.array(cut[key])).combine_chunks()
        nothing = lambda n, *kinds: [pa.nulls(n, kind) for kind in kinds]
        for b in left.to_batches(max_chunksize=65_536):
            yield pa.RecordBatch.from_arrays([*b.columns, *nothing(b.num_rows, pa.int64(), pa.int64())], names=[*b.schema.names, "pairs", "tails"])
        whole = ~cut[key]
        table, key = table.filter(pa.array(whole)), key[whole]
        if not len(key):
            return
        s, e = (table[c].combine_chunks().cast(pa.int32()).to_numpy().astype(np.int64) for c in ("start", "end"))
        low, high, least, most = REGIONS[relation](s, e)
        places, days = np.unique(s), np.unique(e)
        # Keys one after another, each by its places, as one number.
        step = len(places) + 1
        where = key * step + np.searchsorted(places, s)
        order = np.argsort(where, kind="stable")
        at = lambda bound, none: key * step + (none if bound is None else np.searchsorted(places, bound))
        first, last = (np.searchsorted(where[order], x) for x in (at(low, 0), at(high, len(places))))
        last = np.maximum(first, last)
        ranks, ones = np.searchsorted(days, e)[order], np.ones(len(key), np.int64)
        under = lambda bound: dominance.below(ranks, ones, first, last, np.searchsorted(days, bound))
        found = (last - first if most is None else under(most)) - (0 if least is None else under(least))
        if least is not None and most is not None:
            found = np.where(least < most, found, 0)
        pairs = np.zeros(len(names), np.int64)
        np.add.at(pairs, key, found)
        told = table["tail"].combine_chunks().dictionary_encode()
        tail = told.indices.fill_null(-1).to_numpy().astype(np.int64)
        count = len(told.dictionary) + 1
        different = np.unique((key * count + tail)[(found > 0) & (tail >= 0)])
        tails = np.bincount(different // count, minlength=len(names)).astype(np.int64)
        met = np.flatnonzero(pairs)
        out = [names.take(pa.array(met)), *nothing(len(met), *(table.schema.field(c).type for c in ("tail", "start", "end"))), pa.array(pairs[met]), pa.array(tails[met])]
        yield pa.RecordBatch.from_arrays(out, names=["key", "tail", "start", "end", "pairs", "tails"])

    return run


def relation_totals(facts: DataFrame, key: str, tail: str, relation: str) -> DataFrame:
    """(key, pairs, tails): how many pairs of a key's facts stand in the relation, each fact with itself too, and how many different tails their first facts have. Keys without pairs are left out.

    Facts are dealt once, by key, into strips of about ``dominance.STRIP_ROWS`` rows, and a key that lies inside a strip is finished there. Only the facts of keys that a strip may cut, two for each
    strip or one of any size, are counted over a grid (``relation_counts``), which deals them several times. Facts that agree in everything stay together.
    """
    rows = stored_table(facts.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(tail).alias("tail"), "start", "end"))
    strips = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // dominance.STRIP_ROWS))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    done = stored_table(rows.repartitionByRange(strips, "key", "start", "end", "tail").mapInArrow(_totals_inside(relation), f"{kinds}, pairs long, tails long"))
    cut = done.where("pairs IS NULL").select("key", "tail", "start", "end")
    met = relation_counts(cut, "key", relation).where("matches > 0").drop("n")
    met = met.select(*(F.col(c).alias(f"_{c}") for c in ("key", "start", "end")), "matches")
    rest = cut.join(met, (F.col("key") == F.col("_key")) & F.col("start").eqNullSafe(F.col("_start")) & F.col("end").eqNullSafe(F.col("_end"))).groupBy("key").agg(F.sum("matches").alias("pairs"), F.countDistinct("tail").alias("tails"))
    return done.where("pairs IS NOT NULL").select("key", "pairs", "tails").unionByName(rest).withColumnRenamed("key", key)
