"""The best facts of each question by the sum of three similarities, without making all matches (a threshold algorithm).

Each slot has a list of candidate names for each question, best first. Facts are reached through the lists of the ``access`` slots only, a stretch of each list at a time: a fact found by one name is looked
up in the question's other lists and gets its sum. No fact that is not reached yet can have more than the sum of what the accessed lists have at the depth reached and the
others at their top; a question whose k-th best sum is above that bound is finished, and so is one whose accessed list has ended. The others go on, four times deeper.

What a round makes is the facts of the names between two depths, once each: a fact that two lists reach counts for the first. The best k are chosen by question and salt
first, then by question. Facts join on names, so a hot name is split by the adaptive skew join. Rounds are stored.

A question without candidates for some slot has no facts. A name that is listed twice counts with its best similarity; repeated facts are facts of their own; null names match nothing. Ties in the
sum go by ``order``. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.facts import stored
from . import segments
from .match import SLOTS

DEPTH, DEEPER, SALTS = 16, 4, 32


def _lists(slot: DataFrame) -> DataFrame:
    """(qid, name, sim, pos): each name once, best first."""
    once = slot.where("qid IS NOT NULL AND name IS NOT NULL AND sim IS NOT NULL").groupBy("qid", "name").agg(F.max("sim").alias("sim")).withColumn("_by", -F.col("sim"))
    return stored(segments.row_number(once, ["qid"], ["_by", "name"], "pos").drop("_by"))


def _top(found: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    by = [F.desc("score_sum"), *order]
    near = found.withColumn("_salt", F.pmod(F.xxhash64(*SLOTS), F.lit(SALTS)))
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "_salt").orderBy(*by))).where(F.col("_n") <= k).drop("_salt")
    return near.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(*by))).where(F.col("_n") <= k).drop("_n")


def best_triples(slots: dict[str, DataFrame | None], facts: DataFrame, k: int = 50, access: Sequence[str] = ("head", "tail"), order: Sequence[str] = SLOTS, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(best, touched): the k best facts of each question with h_sim, r_sim, t_sim and score_sum, and (qid, touched), how many facts were scored.

    ``slots`` maps head, relation and tail to (qid, name, sim), or to None where the slot is unknown for all questions (it then matches everything at 1).
    ``access`` names slots with candidates whose names have few facts each.
    """
    lists = {s: _lists(slot) for s, slot in slots.items() if slot is not None}
    access = [s for s in access if s in lists]
    if not access:
        raise ValueError("no slot to reach facts by")
    ends = [df.groupBy("qid").agg(F.max("sim").alias(f"_{s}_top"), F.max("pos").alias(f"_{s}_end")) for s, df in lists.items()]
    open_ = stored(reduce(lambda a, b: a.join(b, "qid"), ends))
    best, touched, before = None, None, 0
    while True:
        questions = open_.select("qid")
        rounds = []
        for at, s in enumerate(access):
            stretch = lists[s].join(questions, "qid").where((F.col("pos") > before) & (F.col("pos") <= depth))
            found = facts.join(stretch.select("qid", F.col("name").alias(s), F.col("sim").alias(f"{s[0]}_sim")), s)
            for other in (o for o in lists if o != s):
                found = found.join(lists[other].select("qid", F.col("name").alias(other), F.col("sim").alias(f"{other[0]}_sim"), F.col("pos").alias(f"_{other}_pos")), ["qid", other])
            for behind, other in enumerate(access):
                if other != s:
                    # Lists that come first have been read to this round's depth, the others to the last one's.
                    found = found.where(F.col(f"_{other}_pos") > (depth if behind < at else before))
            for unknown in (o for o in slots if o not in lists):
                found = found.withColumn(f"{unknown[0]}_sim", F.lit(1))
            rounds.append(found.withColumn("score_sum", F.col("h_sim") + F.col("r_sim") + F.col("t_sim")).select("qid", *facts.columns, "h_sim", "r_sim", "t_sim", "score_sum"))
        made = stored(reduce(DataFrame.unionByName, rounds))
        counts = made.groupBy("qid").agg(F.count(F.lit(1)).alias("touched"))
        touched = counts if touched is None else touched.unionByName(counts)
        best = stored(_top(made if best is None else best.unionByName(made), k, order))
        # What an unreached fact can have at most: the accessed lists' next values, the others' tops.
        bound = open_
        for s in access:
            bound = bound.join(lists[s].where(F.col("pos") == depth).select("qid", F.col("sim").alias(f"_{s}_at")), "qid", "left")
        most = reduce(lambda a, b: a + b, [F.col(f"_{s}_at") if s in access else F.col(f"_{s}_top") if s in lists else F.lit(1) for s in slots])
        over = reduce(lambda a, b: a | b, [F.col(f"_{s}_end") <= depth for s in access])
        worst = best.groupBy("qid").agg(F.count(F.lit(1)).alias("_has"), F.min("score_sum").alias("_worst"))
        done = over | ((F.coalesce("_has", F.lit(0)) >= k) & (F.col("_worst") > most))
        open_ = stored(bound.join(worst, "qid", "left").where(~F.coalesce(done, F.lit(False))).select(*open_.columns))
        if open_.isEmpty():
            return best, touched.groupBy("qid").agg(F.sum("touched").alias("touched"))
        before, depth = depth, depth * DEEPER
