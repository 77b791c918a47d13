"""Dataset curation: repair, filters, duplicates, ordering, balancing, splits and samples."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.timeparse import flexible_date, sort_date, strip
from ..sources.facts import stored
from . import ranks

#: Answers that say nothing. Fixed values.
INVALID = ("", "noanswer", "no answer", "0 days")
#: Levels of questions, and the kind that changes its level. Fixed values.
LEVELS = ("simple", "medium", "complex")
SPLITS = (("train", 8), ("validation", 1), ("test", 1))

# Filters


def invalid_answers(answers: Column) -> Column:
    return (F.size(F.coalesce(answers, F.array().cast("array<string>"))) == 0) | F.forall(answers, lambda x: F.lower(strip(F.coalesce(x, F.lit("")))).isin(*INVALID))


def small_answers(answers: Column, most: int = 10) -> Column:
    return F.size(answers) <= most


def mentioned(name: Column, question: Column) -> Column:
    return F.coalesce((X.mention_text(name) != "") & X.mention_text(question).contains(X.mention_text(name)), F.lit(False))


def mentioned_events(events: Column, question: Column) -> Column:
    """Event strings whose head or tail stands in the question; malformed ones stay."""
    def keep(s: Column) -> Column:
        e = X.parse_event(s)
        return e.isNull() | mentioned(e["head"], question) | mentioned(e["tail"], question)

    return F.filter(events, keep)


def all_points(events: Column) -> Column:
    return F.forall(events, lambda s: F.coalesce(X.parse_event(s)["start"] == X.parse_event(s)["end"], F.lit(False)))


def simple_duration(cases: DataFrame) -> Column:
    return (cases["question_level"] == "simple") & (cases["answer_type"] == "duration") & (cases["temporal_relation"] == "timeline")


def complex_to_medium(cases: DataFrame) -> DataFrame:
    """Union questions over three timelines become medium; the old level is kept."""
    test = (F.col("question_level") == "complex") & (F.col("question_type") == "timeline_position_retrieval*3") & (F.col("answer_type") == "relation_union_or_intersection") & (F.col("temporal_relation") == "union")
    hit = F.coalesce(test, F.lit(False))
    return cases.withColumn("question_level_original", F.when(hit, F.col("question_level"))).withColumn("question_level", F.when(hit, "medium").otherwise(F.col("question_level")))


def answer_change_error(answer_type: Column, before: Column, after: Column) -> Column:
    """Why a rewritten answer is not allowed, or null: the count must stay, entities, ranks and comparisons are frozen, changed values must be temporal."""
    frozen = answer_type.isin("subject", "object", "relation_ranking") | F.exists(before, lambda x: X.answer_form(x, "is_comparison"))
    changed = F.filter(F.arrays_zip(before.alias("b"), after.alias("a")), lambda z: ~z["b"].eqNullSafe(z["a"]))
    return (
        F.when(F.size(before) != F.size(after), "answer_count_changed").when((F.size(changed) > 0) & frozen, "answer_must_not_change")
        .when(F.exists(changed, lambda z: ~F.coalesce(X.is_temporal(z["a"]), F.lit(False))), "answer_not_temporal")
    )


# Question repair


def ensure_question_mark(question: Column) -> Column:
    text = X.collapse(question)
    return F.when(text.endswith("?"), text).otherwise(F.concat(F.regexp_replace(text, r"[.!\s]+$", ""), F.lit("?")))


def normalize_durations(answers: Column) -> Column:
    """``A to B`` answers as whole days; other answers stay."""
    p = r"(?i)^(\d{3,4}-\d{2}-\d{2})\s+to\s+(\d{3,4}-\d{2}-\d{2})$"
    days = lambda a: F.datediff(flexible_date(F.regexp_extract(a, p, 2)), flexible_date(F.regexp_extract(a, p, 1)))
    return F.transform(answers, lambda a: F.when(a.rlike(p), F.concat(days(a).cast("string"), F.lit(" days"))).otherwise(a))


# Duplicates


def first_by(rows: DataFrame, keys: list[str], *order, keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= keep).drop("_n")


def best_triples(facts: DataFrame, top: int, either_way: bool = False) -> DataFrame:
    """The best-scored row of each triple of a question (head and tail in any order with ``either_way``), then the ``top`` best of the question."""
    a, b = (F.least("head", "tail"), F.greatest("head", "tail")) if either_way else (F.col("head"), F.col("tail"))
    one = first_by(facts.withColumns({"_a": a, "_b": b}), ["qid", "_a", "relation", "_b"], F.desc("score_sum"), "pos").drop("_a", "_b")
    return first_by(one, ["qid"], F.desc("score_sum"), "pos", keep=top)


def distinct_facts(facts: DataFrame, top: int = 50) -> DataFrame:
    """First occurrences of whole facts, ``top`` for each question."""
    return first_by(first_by(facts, ["qid", "head", "relation", "tail", "timestamp", "start", "end"], "pos"), ["qid"], "pos", keep=top)


def sorted_candidates(facts: DataFrame) -> DataFrame:
    """Distinct facts of a question numbered by start, end, head, relation and tail."""
    order = Window.partitionBy("qid").orderBy("start", "end", "head", "relation", "tail")
    return facts.dropDuplicates(["qid", "head", "relation", "tail", "start", "end"]).withColumn("pos", F.row_number().over(order) - 1)


def first_event_of_answers(facts: DataFrame, answer: str) -> DataFrame:
    return first_by(facts, ["qid", answer], "start", "end", "head", "relation", "tail")


def earliest_start(events: DataFrame, answer: str) -> DataFrame:
    return events.groupBy(answer).agg(F.min("start").alias("start"))


def merge_duplicates(records: DataFrame, question: str = "question", level: str = "question_level") -> DataFrame:
    """Simple questions with one text become one record with all answers and events; of medium and complex ones, repeated texts go altogether.

    Other levels stay. Null questions are no duplicates of each other. The first record by id gives the metadata; ``inconsistent`` tells if others differ.
    """
    key = F.coalesce(F.col(question), F.concat(F.lit("\0"), F.col("id").cast("string")))
    keyed = records.withColumn("_key", key).withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy("_key", level)))
    lists = [c for c in ("answer", "events") if c in records.columns]
    meta = [c for c in records.columns if c not in lists and c != "split"]
    simple = keyed.where(F.coalesce(F.col(level) == "simple", F.lit(False))).groupBy("_key").agg(
        *(F.min_by(c, "id").alias(c) for c in meta), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists),
        F.count(F.lit(1)).alias("merged"), F.greatest(*(F.size(F.collect_set(c)) for c in meta if c != "id"), F.lit(0)).alias("_kinds"),
    )
    rest = keyed.where(~F.coalesce(F.col(level) == "simple", F.lit(False)) & ((F.col("_copies") == 1) | ~F.coalesce(F.col(level).isin(*LEVELS), F.lit(False))))
    shaped = rest.select(*meta, *lists, F.lit(1).cast("long").alias("merged"), F.lit(False).alias("inconsistent"))
    return simple.select(*meta, *lists, "merged", (F.col("_kinds") > 1).alias("inconsistent")).unionByName(shaped)


def duplicate_groups(records: DataFrame, *keys: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def metadata_flags(records: DataFrame, key: str, *fields: str) -> DataFrame:
    return records.groupBy(key).agg(*((F.size(F.collect_set(f)) > 1).alias(f"{f}_differs") for f in fields))


# Order


def sorted_events(events: Column) -> Column:
    """Event strings by start date, then text; those without a date last."""
    rank = lambda s: F.struct(F.coalesce(flexible_date(X.parse_event(s)["start"]), F.lit("9999-12-31").cast("date")).alias("d"), F.lower(s).alias("t"), s.alias("s"))
    return F.transform(F.array_sort(F.transform(events, rank)), lambda x: x["s"])


def answers_by_event_order(answers: Column, events: Column) -> Column:
    """Answers in the order in which they stand in the events, if all of them do; else unchanged."""
    names = F.flatten(F.transform(events, lambda s: F.array(X.parse_event(s)["head"], X.parse_event(s)["relation"], X.parse_event(s)["tail"])))
    placed = F.transform(F.array_sort(F.transform(answers, lambda a: F.struct(F.array_position(names, a).alias("at"), a.alias("a")))), lambda x: x["a"])
    return F.when(F.forall(answers, lambda a: F.array_contains(names, a)), placed).otherwise(answers)


def answers_by_start(answers: Column, events: Column) -> Column:
    """Answers by the earliest start of an event that names them; others last."""
    start = lambda a: F.array_min(F.transform(F.filter(events, lambda s: (X.parse_event(s)["head"] == a) | (X.parse_event(s)["tail"] == a)), lambda s: sort_date(X.parse_event(s)["start"])))
    return F.transform(F.array_sort(F.transform(answers, lambda a: F.struct(F.coalesce(start(a), F.lit("9999-12-31").cast("date")).alias("d"), a.alias("a")))), lambda x: x["a"])


def evidence_order(query: Column, anchors: Column, support: Column, operator: Column) -> Column:
    """Query event, anchors, support; operator cases show their support only. Without repeats."""
    return F.when(operator.isNotNull(), F.array_distinct(support)).otherwise(F.array_distinct(F.concat(F.array(query), anchors, support)))


# Balancing


def water_level(records: DataFrame, level: str, kind: str, order: str, target: int) -> DataFrame:
    """Each ``level`` cut to ``target`` rows by taking from its largest kinds; within a kind, the smallest ``order`` stay.

    Closed form of taking one row from the largest kind again and again (the first by name on ties): with L the largest height at which the kinds'
    cut sizes sum to the target at most, every kind keeps L rows, and of those with more, the last by name keep one more each. Works on counts of kinds only.
    """
    sizes = records.groupBy(level, kind).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(level)
    # Sorted by size: at height h between neighbours, the sum is (rows of smaller kinds) + h * (number of larger ones).
    s = sizes.withColumn("_total", F.sum("n").over(w)).withColumn("_below", F.sum("n").over(w.orderBy("n", kind).rowsBetween(Window.unboundedPreceding, -1))).withColumn("_above", F.count(F.lit(1)).over(w.orderBy(F.desc("n"), F.desc(kind)).rowsBetween(Window.unboundedPreceding, 0)))
    height = F.floor((F.lit(target) - F.coalesce("_below", F.lit(0))) / F.col("_above"))
    # The first kind, by size, that a height of its own share would cut, sets the level.
    s = s.withColumn("_h", F.when((height < F.col("n")) & (F.col("_total") > target), height)).withColumn("L", F.min(F.when(F.col("_h").isNotNull(), F.struct("n", kind, "_h"))).over(w)["_h"])
    s = s.withColumn("_spare", F.lit(target) - F.sum(F.least("n", F.coalesce("L", F.col("n")))).over(w))
    s = s.withColumn("_last", F.row_number().over(Window.partitionBy(level, F.col("n") > F.col("L")).orderBy(F.desc(kind))))
    keep = F.when(F.col("L").isNull(), F.col("n")).otherwise(F.least("n", "L") + F.when((F.col("n") > F.col("L")) & (F.col("_last") <= F.col("_spare")), 1).otherwise(0))
    return ranks.first(records, [level, kind], order, s.select(level, kind, keep.cast("long").alias("rank")))


def balance_levels(records: DataFrame, level: str, kind: str, order: str, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The given levels cut to the size of the smallest; other levels pass. An empty level is an error."""
    counts = {r[0]: r[1] for r in records.where(F.col(level).isin(*levels)).groupBy(level).count().collect()}
    if missing := [x for x in levels if not counts.get(x)]:
        raise ValueError(f"empty levels: {', '.join(missing)}")
    cut = water_level(records.where(F.col(level).isin(*levels)), level, kind, order, min(counts.values()))
    return cut.unionByName(records.where(~F.coalesce(F.col(level).isin(*levels), F.lit(False))).select(*cut.columns))


def largest_remainder(n: Column, weights: tuple[tuple[str, int], ...] = SPLITS, ties: tuple[str, ...] | None = None) -> Column:
    """array of struct(name, count): ``n`` dealt by integer weights; what is left goes to the largest remainders, ties in the order given."""
    total = sum(w for _, w in weights)
    ties = ties or tuple(k for k, _ in weights)
    parts = F.array(*(F.struct(F.lit(k).alias("name"), F.floor(n * w / total).cast("long").alias("floor"), (n * w % total).cast("long").alias("rest"), F.lit(ties.index(k)).alias("tie")) for k, w in weights))
    left = n - F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x["floor"])
    ahead = lambda x: F.size(F.filter(parts, lambda y: (y["rest"] > x["rest"]) | ((y["rest"] == x["rest"]) & (y["tie"] < x["tie"]))))
    return F.transform(parts, lambda x: F.struct(x["name"].alias("name"), (x["floor"] + F.when(ahead(x) < left, 1).otherwise(0)).alias("count")))


def allocate_strata(sizes: list[tuple[tuple, int]], weights: tuple[tuple[str, int], ...] = SPLITS) -> dict[tuple, dict[str, int]]:
    """Counts by stratum and split such that every stratum is dealt by its largest remainders as far as possible and the totals are exactly those of all rows.

    Works on the table of stratum sizes (tens of rows): floors first, then each leftover row of a stratum goes to the split with the largest remainder that still lacks rows.
    """
    total_weight, names = sum(w for _, w in weights), [k for k, _ in weights]
    n = sum(c for _, c in sizes)
    want = {k: n * w // total_weight for k, w in weights}
    for k in sorted(names, key=lambda k: (-(n * dict(weights)[k] % total_weight), names.index(k)))[: n - sum(want.values())]:
        want[k] += 1
    out = {s: {k: c * w // total_weight for k, w in weights} for s, c in sizes}
    lack = {k: want[k] - sum(x[k] for x in out.values()) for k in names}
    for s, c in sorted(sizes, key=lambda x: (-x[1], x[0])):
        for _ in range(c - sum(out[s].values())):
            k = max((k for k in names if lack[k] > 0), key=lambda k: (c * dict(weights)[k] / total_weight - out[s][k], -names.index(k)))
            out[s][k] += 1
            lack[k] -= 1
    if any(lack.values()):
        raise RuntimeError("the splits do not add up")
    return out


def stratified_split(records: DataFrame, strata: list[str], order: str, weights: tuple[tuple[str, int], ...] = SPLITS) -> DataFrame:
    """``split``: exact shares overall and nearly so in each stratum; rows of a stratum are dealt in the order of a hash."""
    spark: SparkSession = records.sparkSession
    key = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in strata))
    keyed = records.drop("split").withColumn("_s", key)
    sizes = [((r[0],), r[1]) for r in keyed.groupBy("_s").count().collect()]
    cuts = [(s, k, at) for (s,), counts in allocate_strata(sizes, weights).items() for k, at in enumerate(list(accumulate(counts[name] for name, _ in weights))[:-1])]
    banded = ranks.bands(keyed, ["_s"], order, spark.createDataFrame(cuts, "_s string, cut int, rank long"), "_band")
    return banded.withColumn("split", _named(F.col("_band"), weights)).drop("_s", "_band")


def _named(band: Column, weights: tuple[tuple[str, int], ...]) -> Column:
    return F.element_at(F.array(*(F.lit(name) for name, _ in weights)), band + 1)


def hash_split(records: DataFrame, order: Column, weights: tuple[tuple[str, int], ...] = SPLITS, ties: tuple[str, ...] = ("validation", "test", "train")) -> DataFrame:
    """``split`` by ranges of a hash order, cut at exact ranks (``ranks.bands``): nothing is sorted but the rows around the cuts."""
    n = records.count()
    spark = records.sparkSession
    counts = {r.name: r["count"] for r in spark.range(1).select(F.explode(largest_remainder(F.lit(n), weights, ties)).alias("x")).select("x.*").collect()}
    at = list(accumulate(counts[name] for name, _ in weights))[:-1]
    cuts = spark.createDataFrame([(k, x) for k, x in enumerate(at)], "cut int, rank long")
    banded = ranks.bands(records.drop("split").withColumn("_h", order), [], "_h", cuts, "_band")
    return banded.withColumn("split", _named(F.col("_band"), weights)).drop("_h", "_band")


def stratified_sample(records: DataFrame, strata: list[str], order: Column, n: int, mode: str = "bround") -> DataFrame:
    """Exactly ``min(n, all)`` rows: each stratum gives its share, rounded half to even (or down: ``floor``), in hash order; then the next rows by hash fill up, or the last are dropped."""
    hashed = records.withColumn("_h", order)
    sizes = stored(hashed.groupBy(*strata).agg(F.count(F.lit(1)).alias("_c")))
    total = sizes.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    n = min(n, total)
    share = F.col("_c") * F.lit(n) / F.lit(max(total, 1))
    quotas = sizes.select(*strata, (F.bround(share, 0) if mode == "bround" else F.floor(share)).cast("long").alias("rank"))
    given = quotas.agg(F.coalesce(F.sum("rank"), F.lit(0))).first()[0]
    banded = ranks.bands(hashed, strata, "_h", quotas.withColumn("cut", F.lit(0)), "_band")
    quota, rest = banded.where("_band = 0").drop("_band"), banded.where("_band = 1").drop("_band")
    cut = lambda df, k: ranks.first(df, [], "_h", records.sparkSession.createDataFrame([(k,)], "rank long"))
    if given > n:
        quota = cut(quota, n)
    elif given < n:
        quota = quota.unionByName(cut(rest, n - given))
    return quota.drop("_h")


def count_by(records: DataFrame, key: str, missing: str) -> DataFrame:
    return records.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(missing)).alias(key)).agg(F.count(F.lit(1)).alias("n"))


def summary(records: DataFrame, *keys: str) -> DataFrame:
    """Counts of each value of each key and of all rows, in one pass."""
    return records.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*keys).alias("grouping"))


def clean_records(records: DataFrame, most: int = 10) -> DataFrame:
    """Relabel, normalise answers, drop invalid and oversized ones, order events and answers: in this order."""
    out = complex_to_medium(records).withColumn("answer", F.transform("answer", X.answer_item))
    out = out.where(~invalid_answers(F.col("answer")) & small_answers(F.col("answer"), most)).withColumn("events", sorted_events(F.col("events")))
    return out.withColumn("answer", answers_by_event_order(F.col("answer"), F.col("events")))
