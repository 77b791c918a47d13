"""Every registered query with an oracle against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from chronofacts.plans import files, workload

SF = "/root/testdata/sf0.001"
#: One of each family; the driver compares all of them.
NAMES = ["flagship_overlap", "fact_view", "vocab_ids", "pattern_exact_head_unknown", "time_equal_month", "allen_overlaps", "constraint_chain_counts", "rank_last", "interval_intersection", "interval_average", "time_normalize", "similarity_triple_join", "balance_levels", "hash_split", "stratified_sample", "hits_at_k", "event_retention", "session_events", "rule_edge_time", "rule_gold_answer", "rule_texts", "rule_answer_change", "rule_question_order", "relation_parse", "stratified_split", "shop_meets_any", "answer_kinds", "wrapped_records", "record_hashes", "program_event_operators", "question_repair_audit"]


def plain(x):
    return round(x, 6) if isinstance(x, float) else str(x) if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = workload.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(workload.ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(plain(x) for x in r) for r in df.select(*columns).collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_name_is_registered_once():
    assert set(workload.ORACLE) <= set(workload.QUERIES)
