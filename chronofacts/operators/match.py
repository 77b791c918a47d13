"""Triple patterns against facts: exact with wildcards, fallbacks, timeline completion.

``patterns`` has qid, head, relation, tail (null or ``?``: unknown); ``facts`` has head, relation, tail and times. All questions are matched at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.facts import stored

SLOTS = ("head", "relation", "tail")
#: Keys that patterns without a known slot are joined by.
SALTS = 64
#: Relations that say the same the other way round, and one that is stored in both directions. Fixed values.
INVERSE = {"part of": "has part", "has part": "part of", "spouse": "spouse of", "spouse of": "spouse", "owned by": "owner of", "owner of": "owned by"}
REVERSED = ("winner",)


def kinds(patterns: DataFrame) -> set[str]:
    """By which slot patterns are joined, of those that arise: head, tail, relation or none; four rows at most are collected. For stored patterns."""
    slot = reduce(lambda out, s: F.when(~X.is_unknown(F.col(s)), s).otherwise(out), ("relation", "tail", "head"), F.lit("none"))
    return {r["kind"] for r in patterns.select(slot.alias("kind")).distinct().collect()}


def exact(patterns: DataFrame, facts: DataFrame, among: set[str] | None = None) -> DataFrame:
    """Facts of each pattern, with scores of 1 for each slot.

    Four equi joins: patterns with a known head join on it, then those with a known tail, then those with a known relation; what else is known
    is a condition of the join; ``among`` names the ``kinds`` that arise, so that the other joins are left out. A pattern without any known slot matches all facts: a copy of it stands under each of ``SALTS`` keys, over which the facts are spread.
    """
    p = patterns.withColumns({f"q_{s}": F.when(~X.is_unknown(F.col(s)), F.col(s)) for s in SLOTS}).drop(*SLOTS)
    p = p.withColumn("anchor_type", X.anchor_type(*(F.col(f"q_{s}") for s in SLOTS)))
    known = lambda s: F.col(f"q_{s}").isNotNull()
    same = lambda s: F.col(f"q_{s}") == F.col(s)
    free = lambda s: F.col(f"q_{s}").isNull() | same(s)
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(*SLOTS), F.lit(SALTS)).cast("int"))
    joins = {
        "head": lambda: facts.join(p.where(known("head")), same("head") & free("relation") & free("tail")),
        "tail": lambda: facts.join(p.where(~known("head") & known("tail")), same("tail") & free("relation")),
        "relation": lambda: facts.join(p.where(~known("head") & ~known("tail") & known("relation")), same("relation")),
        "none": lambda: spread.join(p.where(~known("head") & ~known("tail") & ~known("relation")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "_salt").drop("_salt"),
    }
    found = reduce(DataFrame.unionByName, [join() for kind, join in joins.items() if not among or kind in among]).drop(*(f"q_{s}" for s in SLOTS))
    one = F.lit(1.0)
    return found.withColumns({"h_sim": one, "r_sim": one, "t_sim": one, "score_sum": F.lit(3.0)})


def positions(candidates: DataFrame, *order, key: str = "qid") -> DataFrame:
    """``pos``: arrival order within a question; by default that of exact matches, by timestamp text with nulls last."""
    by = order or (F.col("timestamp").asc_nulls_last(), "head", "relation", "tail")
    return candidates.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*by)) - 1)


def known_names(patterns: DataFrame, facts: DataFrame) -> DataFrame:
    """Patterns whose known slots all stand in the vocabulary; the others have no result rather than an empty one."""
    ents = facts.select(F.col("head").alias("n")).union(facts.select("tail")).distinct()
    rels = facts.select(F.col("relation").alias("n")).distinct()
    out = patterns
    for slot, names in (("head", ents), ("relation", rels), ("tail", ents)):
        out = out.join(names.select(F.col("n").alias(f"_{slot}")), F.col(slot) == F.col(f"_{slot}"), "left").where(X.is_unknown(F.col(slot)) | F.col(f"_{slot}").isNotNull()).drop(f"_{slot}")
    return out


def first_of(branches: list[DataFrame], key: str = "qid") -> DataFrame:
    """For each question, the rows of the first branch that has any."""
    tagged = reduce(DataFrame.unionByName, [b.withColumn("_prio", F.lit(k)) for k, b in enumerate(branches)])
    least = F.min("_prio").over(Window.partitionBy(key))
    return tagged.withColumn("_least", least).where("_prio = _least").drop("_least").withColumnRenamed("_prio", "branch")


def flipped(patterns: DataFrame, relation=None) -> DataFrame:
    """Head and tail swapped; the unknown slot goes along."""
    columns = {"head": F.col("tail"), "tail": F.col("head")} | ({"relation": relation} if relation is not None else {})
    return patterns.withColumns(columns)


def exact_with_fallback(patterns: DataFrame, facts: DataFrame, stored_patterns: bool = False) -> DataFrame:
    """Exact matches; where there are none, reversed ones for relations stored both ways, then those of the inverse relation.

    With ``stored_patterns``, which are cheap to read again, joins that no pattern asks for are left out.
    """
    table = F.create_map(*(F.lit(x) for pair in INVERSE.items() for x in pair))
    inverse = F.try_element_at(table, F.col("relation"))
    asked = [patterns, flipped(patterns.where(F.col("relation").isin(*REVERSED))), flipped(patterns.where(inverse.isNotNull()), inverse)]
    if not stored_patterns:
        return first_of([exact(p, facts) for p in asked])
    arise = [kinds(p) for p in asked]
    if not any(arise[1:]):
        return exact(patterns, facts, arise[0]).withColumn("branch", F.lit(0))
    return first_of([exact(p, facts, among or {"head"}) for p, among in zip(asked, arise, strict=True)])


def exact_or_similar(patterns: DataFrame, facts: DataFrame, similar: Callable[[DataFrame], DataFrame], stored_patterns: bool = False) -> DataFrame:
    """Exact matches; questions without any get what ``similar`` finds for them (given their patterns, it returns qid and the columns of ``exact``, cut to its cap).

    With ``stored_patterns``, which are cheap to read again, joins that no pattern asks for are left out.
    """
    found = stored(exact(patterns, facts, kinds(patterns) if stored_patterns else None))
    left = patterns.join(found.select("qid").distinct(), "qid", "left_anti")
    return found.withColumn("approximate", F.lit(False)).unionByName(similar(left).withColumn("approximate", F.lit(True)), allowMissingColumns=True)


def complete_timeline(seeds: DataFrame, facts: DataFrame) -> DataFrame:
    """All facts that a seed's question asks for: of the same relation and tail (or head) and the same interval for entity answers, else all times of the seed's triple."""
    s = seeds.select("qid", "answer_type", *(F.col(c).alias(f"s_{c}") for c in (*SLOTS, "start", "end"))).dropDuplicates()
    same_time = (F.col("start") == F.col("s_start")) & (F.col("end") == F.col("s_end"))
    eq = lambda *names: reduce(lambda a, b: a & b, (F.col(n) == F.col(f"s_{n}") for n in names))
    parts = (
        (F.col("answer_type") == "subject", eq("relation", "tail") & same_time),
        (F.col("answer_type") == "object", eq("head", "relation") & same_time),
        (~F.col("answer_type").isin("subject", "object"), eq("head", "relation", "tail")),
    )
    return reduce(DataFrame.unionByName, [facts.join(s.where(kind), on) for kind, on in parts]).select("qid", "answer_type", *SLOTS, "start", "end").distinct()


def oriented(candidates: DataFrame, swapped: str) -> DataFrame:
    """Candidates that were found head for tail, turned back."""
    turn = F.col(swapped)
    return candidates.withColumns({"head": F.when(turn, F.col("tail")).otherwise(F.col("head")), "tail": F.when(turn, F.col("head")).otherwise(F.col("tail"))})


def project_answer(answer_type, kind: str = "repair"):
    """What a fact answers. ``kind``: ``repair`` falls back to the start, ``events`` to null, ``leakage`` gives durations as intervals."""
    start, end = F.col("start").cast("string"), F.col("end").cast("string")
    span = F.concat(start, F.lit(" to "), end)
    days = F.concat(F.datediff(F.col("end").cast("date"), F.col("start").cast("date")).cast("string"), F.lit(" days"))
    return (
        F.when(answer_type == "subject", F.col("head")).when(answer_type == "object", F.col("tail")).when(answer_type.isin("timestamp", "timestamp_start"), start)
        .when(answer_type == "timestamp_end", end).when(answer_type == "timestamp_range", span).when(answer_type == "duration", span if kind == "leakage" else days)
        .otherwise(start if kind == "repair" else F.lit(None).cast("string"))
    )
