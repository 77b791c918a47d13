"""Evaluation: Hits@k, evidence compression, answer coverage and event retention, by level, type and overall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def clean_list(values: Column, norm: Callable[[Column], Column] = X.hit_text) -> Column:
    """Normalised items without empty ones."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), norm), lambda x: x != "")


def hit_at(pred: Column, gold: Column, k: int, norm: Callable[[Column], Column] = X.hit_text) -> Column:
    """1 if one of the first k non-empty predictions is a gold answer."""
    return F.coalesce(F.arrays_overlap(F.slice(clean_list(pred, norm), 1, k), clean_list(gold, norm)), F.lit(False)).cast("int")


def hits(records: DataFrame, pred: str, gold: str, keys: list[str], ks: tuple[int, ...] = (1, 10), skip_without_gold: bool = False) -> DataFrame:
    """n and hits@k for each key and overall (null keys). Records without gold count as misses unless they are skipped."""
    rows = records.where(F.size(clean_list(F.col(gold))) > 0) if skip_without_gold else records
    named = rows.withColumns({k: F.coalesce(F.trim(F.col(k)), F.lit("_OTHER_")) for k in keys})
    named = named.withColumns({f"_h{k}": hit_at(F.col(pred), F.col(gold), k) for k in ks})
    return named.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"_h{k}").alias(f"hits_{k}") for k in ks)).withColumns({f"hit_rate_{k}": F.col(f"hits_{k}") / F.col("n") for k in ks})


def baseline_hit(pred: Column, gold: Column, compat: bool = False) -> Column:
    """Hit@1 of the retrieval baselines: two no-answers are a hit; null where either is missing."""
    nothing = lambda xs: F.forall(xs, lambda x: X.no_answer(x, compat))
    return F.when(pred.isNull() | gold.isNull(), F.lit(None).cast("int")).when(nothing(pred) & nothing(gold), 1).otherwise(hit_at(pred, gold, 1, X.squeezed_text))


def by_groups(records: DataFrame, level: str, kind: str, *metrics: Column) -> DataFrame:
    """Metrics for each level, each kind and all rows, with a column that tells which."""
    out = records.groupingSets([[level], [kind], []], level, kind).agg(F.grouping(level).alias("_l"), F.grouping(kind).alias("_k"), F.count(F.lit(1)).alias("n"), *metrics)
    scope = F.when(F.col("_l") == 0, "level").when(F.col("_k") == 0, "type").otherwise("overall")
    name = F.when(F.col("_l") == 0, X.label(F.col(level))).when(F.col("_k") == 0, X.label(F.col(kind))).otherwise("overall")
    return out.withColumn("scope", scope).withColumn("name", name).drop("_l", "_k", level, kind)


def compression(before: str, after: str) -> list[Column]:
    """Sums, their reduction as a ratio of sums, and averages, over rows where both counts are known."""
    ok = F.col(before).isNotNull() & F.col(after).isNotNull() & (F.col(before) > 0)
    b, a = F.sum(F.when(ok, F.col(before))), F.sum(F.when(ok, F.col(after)))
    return [b.alias("before"), a.alias("after"), F.round(F.when(b > 0, (b - a) / b * 100), 3).alias("reduction_percent"), F.count_if(ok).alias("evaluated")]


def coverage(gold: Column, found: Column, failed: Column | None = None) -> Column:
    """struct(evaluable, any, full, recall) of gold answers among the evidence's entities and times, as sets; a failed retrieval covers nothing."""
    g = F.array_distinct(gold)
    hit = F.size(F.array_intersect(g, F.coalesce(found, F.array().cast("array<string>"))))
    hit = F.when(failed, 0).otherwise(hit) if failed is not None else hit
    n = F.size(g)
    return F.when(n > 0, F.struct(F.lit(True).alias("evaluable"), (hit > 0).alias("any"), (hit == n).alias("full"), (hit / n).alias("recall"))).otherwise(F.struct(F.lit(False).alias("evaluable"), F.lit(None).cast("boolean").alias("any"), F.lit(None).cast("boolean").alias("full"), F.lit(None).cast("double").alias("recall")))


def coverage_metrics(column: str) -> list[Column]:
    c = lambda f: F.col(f"{column}.{f}")
    pct = lambda x: F.round(F.avg(x.cast("double")) * 100, 3)
    return [F.count_if(c("evaluable")).alias("evaluated"), pct(c("any")).alias("any_percent"), pct(c("full")).alias("full_percent"), pct(c("recall")).alias("recall_percent")]


def event_key(head: Column, tail: Column, start: Column, end: Column) -> Column:
    """Equal for an event and its reverse."""
    return F.struct(F.least(head, tail).alias("a"), F.greatest(head, tail).alias("b"), start.alias("start"), end.alias("end"))


def fits_slots(head: Column, tail: Column, q_head: Column, q_tail: Column) -> Column:
    """Whether an event has a search triple's known entities, one way or the other."""
    fit = lambda a, b: (X.is_unknown(q_head) | (a == q_head)) & (X.is_unknown(q_tail) | (b == q_tail))
    return fit(head, tail) | fit(tail, head)


def event_retention(gold: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid and the coverage struct of gold events (qid, head, tail, start, end) among evidence events, reverses allowed."""
    keyed = lambda df, name: df.groupBy("qid").agg(F.collect_set(event_key(F.col("head"), F.col("tail"), F.col("start"), F.col("end"))).alias(name))
    joined = keyed(gold, "_g").join(keyed(evidence, "_e"), "qid", "left")
    n, hit = F.size("_g"), F.coalesce(F.size(F.array_intersect("_g", "_e")), F.lit(0))
    hit = F.when(F.col("_e").isNull(), 0).otherwise(hit)
    return joined.select("qid", F.struct(F.lit(True).alias("evaluable"), (hit > 0).alias("any"), (hit == n).alias("full"), (hit / n).alias("recall")).alias("retention"))


def evidence_counts(has_search: Column, search_before: Column, search_after: Column, anchors_before: Column, anchors_after: Column) -> Column:
    """Counts of a question's evidence: those of the search if it has one, else sums over its anchors."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(has_search, F.struct(search_before.alias("before"), search_after.alias("after"))).otherwise(F.struct(total(anchors_before).alias("before"), total(anchors_after).alias("after")))
