"""Constrained retrieval: temporal any-match, ranking, evidence accounting, for all questions at once.

``candidates``: qid, pos, head, relation, tail, timestamp (text) and scores. ``anchors``: qid, anchor_index and the same columns. ``plans``: qid,
constraints (array of struct anchor_kind, relation, anchor_index, time_text, interval_start, interval_end, granularity, offset_days), ranking (struct rank, rank_k or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.timeparse import coarsen, explicit_interval, let, normalize_time
from . import intervals, segments

EVIDENCE = 20
APPROXIMATE = 50
FIRST_KEEPS = 3


_TIMES = "array<struct<start:date,end:date>>"


def _literal(c: Column) -> Column:
    """The one time that a constraint states itself, as an array; empty if there is none."""
    stated = F.coalesce(explicit_interval(c["interval_start"], c["interval_end"]), normalize_time(c["time_text"]))
    return let(stated, lambda t: F.when(t.isNotNull(), F.array(F.struct(t["start"].alias("start"), t["end"].alias("end")))).otherwise(F.array().cast(_TIMES)))


def _meets(c: Column, times: Column, start: Column, end: Column) -> Column:
    """Whether a range meets one constraint with any of its anchor times; no anchor time, no match."""
    test = lambda a: F.when(c["offset_days"].isNotNull(), P.offset_matches_any(start, end, a["start"], a["end"], c["relation"], c["offset_days"])).otherwise(P.matches(start, end, a["start"], a["end"], c["relation"], c["granularity"]))
    return F.exists(times, lambda a: F.coalesce(test(a), F.lit(False)))


def apply_constraints(plans: DataFrame, candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidates with ``passed``: how many constraints in a row, from the first, each has met; -1 without a time.

    Anchor times travel with their constraint in one array by question, so the theta condition is checked inside a row and no nested-loop join arises.
    """
    dated = lambda df: df.withColumn("_t", normalize_time(F.col("timestamp")))
    timed = dated(anchors).where("_t IS NOT NULL").groupBy("qid", "anchor_index").agg(F.collect_set(F.struct(F.col("_t.start").alias("start"), F.col("_t.end").alias("end"))).alias("times"))
    maps = timed.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("anchor_index", "times"))).alias("_anchors"))
    some = F.coalesce("constraints", F.array().cast(plans.schema["constraints"].dataType))
    event = lambda c: F.coalesce(F.try_element_at(F.col("_anchors"), c["anchor_index"]), F.array().cast(_TIMES))
    tests = F.transform(some, lambda c: F.struct(c.alias("c"), F.when(c["anchor_kind"] == "event", event(c)).otherwise(_literal(c)).alias("times")))
    ready = plans.join(maps, "qid", "left").withColumn("constraints", some).withColumn("_tests", tests).drop("_anchors")
    # Parsed times are columns of their own rows before they meet the candidates.
    joined = dated(candidates).join(ready, "qid")
    missed = F.array_position(F.transform("_tests", lambda x: _meets(x["c"], x["times"], F.col("_t.start"), F.col("_t.end")).cast("int")), 0)
    passed = F.when(F.size("_tests") == 0, 0).when(F.col("_t").isNull(), -1).otherwise(let(missed, lambda k: F.when(k == 0, F.size("_tests")).otherwise(k - 1)))
    return joined.withColumn("passed", passed.cast("int")).drop("_tests")


def _keeps() -> Column:
    """How many candidates a ranking asks for."""
    return F.when(F.coalesce("ranking.rank_k", F.lit(1)) == 1, FIRST_KEEPS).otherwise(F.col("ranking.rank_k"))


def rank_candidates(candidates: DataFrame, key: str = "qid") -> DataFrame:
    """Those with a time, by its start in the ranking's direction and then by ``pos``, as many as it asks for; a k of 1 keeps three."""
    start = normalize_time(F.col("timestamp"))["start"]
    days = F.datediff("_start", F.lit("0001-01-01").cast("date"))
    by = F.when(F.lower("ranking.rank") == "desc", -days).otherwise(days)
    n = F.row_number().over(Window.partitionBy(key).orderBy("_by", "pos"))
    return candidates.withColumn("_start", start).where("_start IS NOT NULL").withColumn("_by", by).withColumn("time_rank", n).where(F.col("time_rank") <= _keeps()).drop("_start", "_by")


def constrained(plans: DataFrame, candidates: DataFrame, anchors: DataFrame, cap: int = EVIDENCE, tested: DataFrame | None = None) -> DataFrame:
    """The evidence of each question: candidates that meet all constraints (without repeats once there is any), ranked if asked, ``cap`` at most. ``tested``: the candidates' tests, if they were made before."""
    return _evidence(apply_constraints(plans, candidates, anchors) if tested is None else tested, cap)


def _evidence(tested: DataFrame, cap: int) -> DataFrame:
    tested = tested.where(F.col("passed") == F.size("constraints"))
    same = Window.partitionBy("qid", "head", "relation", "tail", "timestamp").orderBy("pos")
    distinct = tested.withColumn("_n", F.row_number().over(same)).where("_n = 1 OR size(constraints) = 0").drop("_n")
    plain, ordered = distinct.where("ranking.rank IS NULL").withColumn("time_rank", F.lit(None).cast("int")), rank_candidates(distinct.where("ranking.rank IS NOT NULL"))
    order = Window.partitionBy("qid").orderBy(F.col("time_rank").asc_nulls_last(), "pos")
    out = plain.unionByName(ordered).withColumn("evidence_rank", F.row_number().over(order))
    return out.where(F.col("evidence_rank") <= cap).drop("_t")


def evidence_stats(plans: DataFrame, candidates: DataFrame, anchors: DataFrame, cap: int = EVIDENCE, tested: DataFrame | None = None) -> DataFrame:
    """One row for each question: retrieved, survivors after each executed constraint, how many were executed, final count and reduction ratios.

    The step that empties the set counts as executed, later ones do not. Counts before the first constraint include repeats, those after it do not.
    All of it is counted from one row for each fact of a question, in one pass and without ranking anything.
    """
    tested = apply_constraints(plans, candidates, anchors) if tested is None else tested
    ranked = F.col("ranking.rank").isNotNull()
    most = F.when(ranked, F.least(F.lit(cap), _keeps())).otherwise(F.lit(cap))
    stays = (F.col("passed") == F.size("constraints")) & (~ranked | F.col("_t.start").isNotNull())
    # Rows of a fact agree in their time and so in how far they get: rows become facts once, whatever the number of steps.
    facts = tested.groupBy("qid", "head", "relation", "tail", "timestamp").agg(F.max("passed").alias("passed"), F.max(F.size("constraints")).alias("n"), F.max(most).alias("most"), F.max(stays).alias("stays"), F.count(F.lit(1)).alias("rows"))
    left = F.when(F.col("stays"), F.when(F.col("n") == 0, F.col("rows")).otherwise(1)).otherwise(0)
    far = facts.groupBy("qid", "passed").agg(F.max("n").alias("n"), F.max("most").alias("most"), F.sum("rows").alias("rows"), F.sum(left).alias("left"), F.count(F.lit(1)).alias("facts"))
    per = far.groupBy("qid").agg(F.max("n").alias("n"), F.max("most").alias("most"), F.sum("rows").alias("rows"), F.sum("left").alias("left"), F.collect_list(F.struct("passed", "facts")).alias("s"))
    reached = lambda k: F.aggregate("s", F.lit(0).cast("long"), lambda total, x: total + F.when(x["passed"] >= k, x["facts"]).otherwise(0))
    after = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), reached)).otherwise(F.array().cast("array<bigint>"))
    executed = F.when(F.array_position("after", 0) > 0, F.array_position("after", 0)).otherwise(F.size("after"))
    ratio = lambda a, b: F.when(b > 0, (b - a) / b)
    final = F.greatest(F.lit(0).cast("long"), F.least("most", "left"))
    out = per.select("qid", F.col("rows").alias("retrieved_count"), after.alias("after"), final.alias("final_count")).withColumn("executed_constraint_count", executed.cast("int"))
    out = out.withColumn("after_counts", F.slice("after", F.lit(1), F.col("executed_constraint_count"))).drop("after")
    constrained_count = F.when(F.col("executed_constraint_count") > 0, F.element_at("after_counts", -1)).otherwise(F.col("retrieved_count"))
    return out.withColumn("constrained_count", constrained_count).withColumn("reduction_ratio", ratio(F.col("constrained_count"), F.col("retrieved_count"))).withColumn("final_reduction_ratio_from_retrieval", ratio(F.col("final_count"), F.col("retrieved_count")))


def anchors_only(candidates: DataFrame, cap: int = EVIDENCE) -> DataFrame:
    """For questions without a search triple: the first ``cap`` of each anchor's list."""
    order = Window.partitionBy("qid", "anchor_index").orderBy("pos")
    return candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def parseable(candidates: DataFrame, *keys: str) -> DataFrame:
    """How many candidates have a time."""
    return candidates.groupBy(*keys).agg(F.count_if(normalize_time(F.col("timestamp")).isNotNull()).alias("parseable_count"))


def _days(c: Column) -> Column:
    return F.unix_date(c).cast("long")


def _holding(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """Candidates that hold one of their question's ``points`` (qid, point): the first point that is not before the start must not be behind the end."""
    p = points.select("qid", (-_days(F.col("point"))).alias("_at")).where("_at IS NOT NULL").withColumn("_v", F.col("_at"))
    asked = candidates.withColumn("_at", -_days(F.col("start"))).where("_at IS NOT NULL")
    found = segments.best_before(asked, p, ["qid"], "_at", "_v", "_best")
    return found.where(F.col("_best") >= -_days(F.col("end"))).select(*candidates.columns)


def any_match(candidates: DataFrame, anchors: DataFrame, relation: str, granularity: str | None = None, offset_days: int | None = None) -> DataFrame:
    """Candidates (qid, start, end, others) that meet a relation with any anchor (qid, start, end) of their question, whatever the number of anchors.

    No pairs are made. Only the anchors that can decide take part: for before and after the latest start and the earliest end; else, where a candidate needs an anchor
    with ``start`` up to one day and ``end`` from another on, the anchor with the latest end among those that start early enough, found for all candidates
    by one sorted scan over parts of the questions (``segments.best_before``). With ``offset_days`` the anchors' ends, moved, are points that a candidate must hold.

    Candidates and anchors without a start or an end match nothing; repeated candidates stay repeated. Relations without a rule match nothing.
    """
    known = F.col("start").isNotNull() & F.col("end").isNotNull()
    x, y = candidates.where(known), anchors.where(known).select("qid", "start", "end")
    if offset_days is not None:
        if relation not in ("before", "after"):
            return x.limit(0)
        move = offset_days if relation == "after" else -offset_days
        return _holding(x, y.select("qid", F.explode(F.array(F.date_add("start", move), F.date_add("end", move))).alias("point")))
    if relation in ("before", "after"):
        ends = y.groupBy(F.col("qid").alias("_q")).agg(F.max("start").alias("_late"), F.min("end").alias("_early"))
        test = F.col("end") < F.col("_late") if relation == "before" else F.col("start") > F.col("_early")
        return x.join(ends, (F.col("qid") == F.col("_q")) & test).select(*candidates.columns)
    xs, xe, ys, ye = F.col("start"), F.col("end"), F.col("start"), F.col("end")
    if relation == "equal":
        if granularity is None:
            return x.limit(0)
        (xs, xe), (ys, ye) = coarsen(xs, xe, F.lit(granularity)), coarsen(ys, ye, F.lit(granularity))
    inside = relation in ("during", "inside", "in")
    if not inside and relation not in ("overlap", "overlaps", "equal"):
        return x.limit(0)
    frontier = y.select("qid", _days(ys).alias("_at"), _days(ye).alias("_v"))
    asked = x.withColumn("_at", _days(xs if inside else xe))
    found = segments.best_before(asked.where("_at IS NOT NULL"), frontier.where("_at IS NOT NULL"), ["qid"], "_at", "_v", "_best")
    return found.where(F.col("_best") >= _days(xe if inside else xs)).select(*candidates.columns)


def any_offset_match(candidates: DataFrame, anchors: DataFrame, relation: str, days: int, question: Column) -> DataFrame:
    """Candidates that hold the boundary of any anchor, moved by the offset; ``question``: a column or literal of ``anchors`` that tells which boundary counts."""
    known = F.col("start").isNotNull() & F.col("end").isNotNull()
    base = F.when(P.offset_boundary(question, F.lit(relation), F.col("start"), F.col("end")) == "end", F.col("end")).otherwise(F.col("start"))
    move = {"after": days, "before": -days}.get(relation)
    if move is None:
        return candidates.limit(0)
    return _holding(candidates.where(known), anchors.where(known).select("qid", F.date_add(base, move).alias("point")))


def any_interval_match(candidates: DataFrame, anchors: DataFrame, relation: str) -> DataFrame:
    """Candidates that stand in one of the 13 interval relations to any anchor of their question: those whose count of partners (``intervals.relation_counts``) is not 0."""
    met = intervals.relation_counts(candidates, "qid", relation, anchors).where("matches > 0").select("qid", "start", "end")
    same = [candidates[c].eqNullSafe(met[c]) for c in ("qid", "start", "end")]
    return candidates.join(met, same[0] & same[1] & same[2], "left_semi")


def semi_join(candidates: DataFrame, anchors: DataFrame, relation: str, granularity: str | None = None, offset_days: int | None = None) -> DataFrame:
    """``any_match`` for one anchor or few of a question: a semi join on qid with the relation as its condition, which compares a candidate with its question's anchors until one fits."""
    a = anchors.select(F.col("qid").alias("_q"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    x = (F.col("start"), F.col("end"), F.col("_s"), F.col("_e"))
    test = P.offset_matches_any(*x, F.lit(relation), F.lit(offset_days)) if offset_days is not None else P.matches(*x, F.lit(relation), F.lit(granularity).cast("string"))
    return candidates.join(a, (F.col("qid") == F.col("_q")) & test, "left_semi")
