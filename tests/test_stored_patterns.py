"""Patterns that are stored are joined only the ways that arise, with the same result."""

from collections import Counter

from chronofacts.operators import match

FACTS = [("a", "part of", "b", 1), ("b", "has part", "c", 2), ("d", "winner", "e", 3), ("a", "likes", "b", 4)]
SETS = [
    [("1", "a", "likes", None), ("2", "a", None, "b")],
    [("1", "a", "likes", None), ("2", None, "likes", "b"), ("3", None, "likes", None), ("4", None, None, None)],
    [("1", "b", "has part", "a"), ("2", "e", "winner", None), ("3", "?", "part of", "b")],
    [],
]


def test_stored_patterns_find_the_same(spark):
    facts = spark.createDataFrame(FACTS, "head string, relation string, tail string, at int")
    for rows in SETS:
        p = spark.createDataFrame(rows, "qid string, head string, relation string, tail string")
        both = [match.exact_with_fallback(p, facts, stored_patterns=s).select("qid", "head", "relation", "tail", "at", "branch") for s in (False, True)]
        assert Counter(map(tuple, both[0].collect())) == Counter(map(tuple, both[1].collect()))


def test_one_kind_of_pattern_is_one_join(spark):
    facts = spark.createDataFrame(FACTS, "head string, relation string, tail string, at int")
    p = spark.createDataFrame(SETS[0], "qid string, head string, relation string, tail string")
    plan = match.exact_with_fallback(p, facts, stored_patterns=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Window" not in plan
