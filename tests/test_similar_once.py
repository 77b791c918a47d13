"""``exact_or_similar``: facts are made once, and joins that no pattern asks for are left out, with the same result."""

from collections import Counter

from pyspark.sql import functions as F

from chronofacts.operators import match, rank_scan
from chronofacts.plans import workload

SF = "/root/testdata/sf0.001"


def test_facts_are_stored_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(rank_scan, "stored_table", lambda df: made.append(df.columns) or df)
    found = workload.QUERIES["exact_or_similar"](spark, SF)
    assert not made
    assert found.where("approximate").count() and found.where("NOT approximate").count()


def test_stored_patterns_find_the_same(spark):
    facts = spark.createDataFrame([("a", "r", "b"), ("a", "s", "c"), ("d", "r", "b")], "head string, relation string, tail string")
    p = spark.createDataFrame([(1, "a", "r", None), (2, "d", None, None), (3, "x", "r", None)], "qid int, head string, relation string, tail string")
    similar = lambda left: left.select("qid", F.lit("a").alias("head"), F.lit("r").alias("relation"), F.lit("b").alias("tail"))
    rows = [Counter(map(tuple, match.exact_or_similar(p, facts, similar, stored_patterns=s).select("qid", "head", "relation", "tail", "approximate").collect())) for s in (False, True)]
    assert rows[0] == rows[1] == Counter([(1, "a", "r", "b", False), (2, "d", "r", "b", False), (3, "a", "r", "b", True)])


def test_shipments_are_distinct_by_key(spark):
    s = workload.shipments(spark, SF)
    assert s.count() == s.distinct().count() > 0
