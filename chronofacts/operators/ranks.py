"""Cutting strata at exact ranks without sorting them.

The row at which a stratum is cut is found by a histogram: rows are counted by stratum and leading characters of the order text, sums of the counts tell which prefix holds
the wanted rank, and only that prefix is counted again by its next characters, until it holds few rows; these alone are sorted. Then every row is
compared with its stratum's borders. Counting combines before the shuffle, so a stratum may hold any share of the rows; a pass
over the order text is needed for each few characters that the rows of a stratum have in common.

Rows that agree in stratum and order text are ties; where a border falls among them, as many as the rank asks for are before it, in the order of a hash of the whole row.
Null order texts come first, as empty ones. An empty table gives an empty result; strata may be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.facts import stored
from . import segments

#: Characters by which a prefix grows in each pass, and rows of a prefix that are sorted at last.
WIDTH, FEW = 3, 50_000


def _borders(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(_k, _cut, _at, _inside, _ties): the order text at each cut's rank, how many of the rows with this text are before the cut, and how many there are.

    ``rows``: _k, _o; ``cuts``: _k, _cut, _rank, each from 1 to below the stratum's size.
    """
    open_ = cuts.select("_k", "_cut", F.lit("").alias("_p"), F.col("_rank").alias("_left"))
    found, depth = None, 0
    while True:
        mine = rows.join(open_.select("_k", "_p").distinct(), (rows["_k"] == open_["_k"]) & (F.substring(rows["_o"], 1, depth) == F.col("_p"))).select(rows["_k"], "_p", "_o")
        counts = mine.groupBy("_k", "_p", F.substring("_o", depth + 1, WIDTH).alias("_next"), (F.length("_o") <= depth + WIDTH).alias("_ends")).agg(F.count(F.lit(1)).alias("_n"))
        # A text that ends here comes before longer ones with the same beginning.
        upto = F.sum("_n").over(Window.partitionBy("_k", "_p").orderBy("_next", F.desc("_ends")).rowsBetween(Window.unboundedPreceding, 0))
        placed = counts.withColumn("_before", upto - F.col("_n"))
        at = open_.join(placed, ["_k", "_p"]).where((F.col("_left") > F.col("_before")) & (F.col("_left") <= F.col("_before") + F.col("_n")))
        at = stored(at.select("_k", "_cut", F.concat("_p", "_next").alias("_p"), (F.col("_left") - F.col("_before")).alias("_left"), "_ends", "_n"))
        depth += WIDTH
        whole = at.where("_ends").select("_k", "_cut", F.col("_p").alias("_at"), F.col("_left").alias("_inside"), F.col("_n").alias("_ties"))
        few = at.where(~F.col("_ends") & (F.col("_n") <= FEW))
        held = rows.join(few, (rows["_k"] == few["_k"]) & (F.substring(rows["_o"], 1, depth) == few["_p"]) & (F.length(rows["_o"]) > depth)).select(few["_k"], "_cut", "_left", "_o")
        # Different texts of few rows, sorted in one stretch.
        texts = held.groupBy("_k", "_cut", "_left", "_o").agg(F.count(F.lit(1)).alias("_ties"))
        ends = F.sum("_ties").over(Window.partitionBy("_k", "_cut").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0))
        sorted_ = texts.withColumn("_inside", F.col("_left") - (ends - F.col("_ties"))).where("_inside BETWEEN 1 AND _ties").select("_k", "_cut", F.col("_o").alias("_at"), "_inside", "_ties")
        step = whole.unionByName(sorted_)
        found = step if found is None else found.unionByName(step)
        open_ = at.where(~F.col("_ends") & (F.col("_n") > FEW)).select("_k", "_cut", "_p", "_left")
        if open_.isEmpty():
            return stored(found)


def bands(records: DataFrame, keys: Sequence[str], order: str, cuts: DataFrame, name: str = "band") -> DataFrame:
    """``records`` with how many of their stratum's cuts lie before them: ``cuts`` (keys, cut, rank) puts the first ``rank`` rows of the stratum, by ``order``, before the cut.

    A stratum without cuts has band 0. ``keys`` may be empty: then all records are one stratum. The cuts of a stratum meet in one row.
    """
    key = (lambda: F.struct(*keys)) if keys else (lambda: F.struct(F.lit(0).alias("all")))
    rows = records.select(key().alias("_k"), F.coalesce(F.col(order).cast("string"), F.lit("")).alias("_o"))
    sizes = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_size"))
    known = stored(cuts.select(key().alias("_k"), F.col("cut").alias("_cut"), F.col("rank").cast("long").alias("_rank")).join(sizes, "_k"))
    inner = _borders(rows, known.where("_rank >= 1 AND _rank < _size").drop("_size"))
    # A rank of nothing lies before every row, one of all rows behind them.
    nothing = known.where("_rank < 1").select("_k", "_cut", F.lit(None).cast("string").alias("_at"), F.lit(0).cast("long").alias("_inside"), F.lit(0).cast("long").alias("_ties"))
    marks = inner.unionByName(nothing).groupBy("_k").agg(F.collect_list(F.struct("_at", "_inside", "_ties")).alias("_marks"))
    met = records.withColumn("_k", key()).withColumn("_o", F.coalesce(F.col(order).cast("string"), F.lit(""))).join(marks, "_k", "left")
    split = inner.where("_inside < _ties")
    if split.isEmpty():
        tie = F.lit(0).cast("long")
    else:
        some = F.coalesce(F.exists("_marks", lambda m: (m["_at"] == F.col("_o")) & (m["_inside"] < m["_ties"])), F.lit(False))
        tied = segments.row_number(met.where(some).withColumn("_hash", F.xxhash64(*(F.col(c) for c in records.columns))), ["_k", "_o"], ["_hash"], "_tie").drop("_hash")
        met = met.where(~some).withColumn("_tie", F.lit(0).cast("long")).unionByName(tied)
        tie = F.col("_tie")
    past = lambda m: m["_at"].isNull() | (F.col("_o") > m["_at"]) | ((F.col("_o") == m["_at"]) & (tie > m["_inside"]))
    return met.withColumn(name, F.coalesce(F.size(F.filter("_marks", past)), F.lit(0))).select(*records.columns, name)


def first(records: DataFrame, keys: Sequence[str], order: str, ranks: DataFrame) -> DataFrame:
    """The first rows of each stratum, as many as ``ranks`` (keys, rank) says; all of a stratum without a rank."""
    return bands(records, keys, order, ranks.withColumn("cut", F.lit(0)), "_band").where("_band = 0").drop("_band")
