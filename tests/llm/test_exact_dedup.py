"""Exact duplicates against grouping in plain Python."""

import hashlib
import random
import re

from chronofacts.llm import exact_dedup


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def wanted(rows, keep):
    groups = {}
    for ident, text in rows:
        groups.setdefault(lowered(text), []).append(ident)
    pick = max if keep == "largest" else min
    best = {t: pick((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((repr(i), repr(best[lowered(t)]), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows), best


def judged(spark, rows, keep="largest"):
    got = exact_dedup.duplicate_report(spark.createDataFrame(rows, "doc_id long, text string"), keep).collect()
    want, best = wanted(rows, keep)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(best) and all(repr(r.doc_id) == repr(r.keep_id) for r in kept)
    return got


def test_groups_nulls_cases_and_long_texts(spark):
    long = "Wort für Wort " * 30_000
    rows = [(1, None), (2, ""), (3, "Été"), (4, "été"), (5, "ÉTé"), (6, "A b"), (7, "a B"), (8, long), (9, long.upper()), (10, long + "x"), (11, long.lower()), (12, "\0"), (None, "a b"), (None, "only"), (None, "ONLY"), (7, "A B")]
    for keep in ("largest", "smallest"):
        judged(spark, rows, keep)
    assert exact_dedup.duplicate_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_hot_text_is_cut_over_ranges(spark):
    """A third of the rows have one text, with equal and null identifiers; no range holds them all."""
    rnd = random.Random(5)
    rows = [(k if k % 5 else None, "Same text" if k % 2 else "same TEXT") for k in range(3000)] + [(rnd.randrange(4000), f"t{rnd.randrange(2000)} tail") for _ in range(6000)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        judged(spark, rows)
        judged(spark, rows, "smallest")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_runs_over_small_batches(spark):
    """Runs that begin, end and go on at the borders of Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        judged(spark, [(k, f"text {k * k % 23 // 2}") for k in range(400)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_deduplicate_keeps_columns_whatever_their_names(spark):
    rows = [(2, "b", "x", 1), (1, "B", "y", 2), (None, "c", None, 3), (None, "C", "z", 4), (3, None, "n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sha string, row_number int")
    got = exact_dedup.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(tuple(r)[:3:2] for r in got.where("doc_id IS NOT NULL").collect()) == [(1, "y"), (3, "n")] and got.count() == 3
    assert {r.sha for r in exact_dedup.deduplicate(df, "largest").where("doc_id IS NOT NULL").collect()} == {"x", "n"}
