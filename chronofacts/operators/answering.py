"""Answers computed from evidence facts: the rules that are otherwise left to a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals


def at_granularity(day: Column, granularity: Column) -> Column:
    return F.when(granularity == "year", F.date_format(day, "yyyy")).when(granularity == "month", F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy-MM-dd"))


def period(start: Column, end: Column) -> Column:
    """``START to END``; a point is ``d to d``."""
    return F.concat(start.cast("string"), F.lit(" to "), end.cast("string"))


def ordered_answers(rows: DataFrame, answer: Column, start: Column, key: str = "qid") -> DataFrame:
    """Distinct answers of each question by start, then text."""
    pairs = rows.select(key, F.struct(start.alias("s"), answer.alias("a")).alias("p")).where("p.a IS NOT NULL")
    return pairs.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_set("p")), lambda p: p["a"])).alias("answers"))


def answer(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers for each question (qid, kind, granularity) from its evidence (qid, head, relation, tail, start, end, role).

    kind: head, tail, start, end, periods, combined, total, average, first, last. Search facts are preferred, anchors serve where there are none. No evidence: no answers.
    """
    best = evidence.withColumn("_p", F.when(F.col("role") == "search", 0).otherwise(1))
    least = best.groupBy("qid").agg(F.min("_p").alias("_least"))
    used = best.join(least, "qid").where("_p = _least").drop("_p", "_least").join(questions, "qid")
    start, end = F.col("start"), F.col("end")
    plain = (
        F.when(F.col("kind") == "head", F.col("head")).when(F.col("kind") == "tail", F.col("tail")).when(F.col("kind") == "start", at_granularity(start, F.col("granularity")))
        .when(F.col("kind") == "end", at_granularity(end, F.col("granularity"))).when(F.col("kind") == "periods", period(start, end))
    )
    direct = ordered_answers(used.where(F.col("kind").isin("head", "tail", "start", "end", "periods")), plain, start)
    islands = intervals.union(used.where("kind = 'combined'"), "qid")
    combined = ordered_answers(islands, period(start, end), start)
    days = lambda df: df.select("qid", F.array(F.concat(F.col("days").cast("string"), F.lit(" days"))).alias("answers"))
    total = days(intervals.total_duration(used.where("kind = 'total'"), "qid", "head", "relation", "tail"))
    mean = days(intervals.average_duration(used.where("kind = 'average'"), "qid", "head", "relation", "tail"))
    pick = lambda kind, f: used.where(F.col("kind") == kind).groupBy("qid").agg(F.array(f(F.col("tail"), F.struct("start", "tail"))).alias("answers"))
    parts = [direct, combined, total, mean, pick("first", F.min_by), pick("last", F.max_by)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return questions.select("qid").join(out, "qid", "left").select("qid", F.coalesce("answers", F.array().cast("array<string>")).alias("answers"))


def membership(facts: DataFrame, start: Column, end: Column) -> DataFrame:
    """Only facts with exactly the asked interval."""
    return facts.where((F.col("start") == start) & (F.col("end") == end))
