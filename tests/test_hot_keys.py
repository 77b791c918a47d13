"""Operators whose key may hold nine tenths of all rows: results against brute force, and a bound on the rows of one part."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronofacts.operators import constraints, intervals, segments

DAY0 = dt.date(2020, 1, 1)


def day(k):
    return None if k is None else DAY0 + dt.timedelta(k)


@pytest.fixture(scope="module")
def spans():
    """(key, start, end) as day numbers: one key holds nine tenths; nulls, repeats, points."""
    rnd = random.Random(9)
    rows = []
    for i in range(1200):
        a = rnd.randrange(400)
        rows.append(("hot" if i % 10 else rnd.choice(["a", "b", "c", None]), a, a + rnd.choice([0, 0, 1, 2, 5, 40 if i % 97 == 0 else 3])))
    return rows + rows[:50] + [("a", None, 3), ("hot", 5, None), ("b", None, None)]


@pytest.fixture(scope="module")
def facts(spark, spans):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame([(k, day(a), day(b)) for k, a, b in spans], "qid string, start date, end date").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_key_has_many_parts(facts):
    ranged = segments.ranged(facts.distinct(), ["qid"], ["start", "end"])
    sizes = [r["count"] for r in ranged.groupBy("_part").count().collect()]
    assert max(sizes) < 0.4 * sum(sizes) and ranged.where("_key.qid = 'hot'").select("_part").distinct().count() >= 5


def test_union_of_a_hot_key(facts, spans):
    by = defaultdict(list)
    for k, a, b in spans:
        if a is not None and b is not None:
            by[k].append((a, b))
    want = []
    for k, own in by.items():
        islands = []
        for a, b in sorted(own):
            if islands and a <= islands[-1][1]:
                islands[-1][1] = max(b, islands[-1][1])
            else:
                islands.append([a, b])
        want += [(k, day(a), day(b)) for a, b in islands]
    got = intervals.union(facts, "qid").select("qid", "start", "end")
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert intervals.union(facts.limit(0), "qid").count() == 0


def test_intersection_of_a_hot_key(spark, facts, spans):
    members = spark.createDataFrame([(k, i % 3, day(a), day(b)) for i, (k, a, b) in enumerate(spans) if a is not None and b is not None], "qid string, m int, start date, end date")
    held = defaultdict(lambda: defaultdict(set))
    for i, (k, a, b) in enumerate(spans):
        if a is not None and b is not None:
            held[k][i % 3] |= set(range(a, b + 1))
    got = defaultdict(set)
    for r in intervals.intersection(members, "qid", "m").collect():
        got[r.qid] |= {(r.start - DAY0).days + x for x in range((r.end - r.start).days + 1)}
    assert {k: d for k, d in got.items() if k} == {k: d for k, m in held.items() if k and (d := set.intersection(*m.values()))}


def test_row_numbers_and_running_sums_of_a_hot_key(spark):
    rows = spark.createDataFrame([("hot" if k % 10 else f"k{k % 7}", k * 7919 % 1201) for k in range(1200)], "g string, x int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    by = defaultdict(list)
    for g, x in (tuple(r) for r in rows.collect()):
        by[g].append(x)
    want = {(g, x): i + 1 for g, xs in by.items() for i, x in enumerate(sorted(xs))}
    assert {(r.g, r.x): r.n for r in segments.row_number(rows, ["g"], ["x"], "n").collect()} == want
    sums = segments.running(segments.ranged(rows, ["g"], ["x"]), ["x"], inclusive=False, s=("sum", F.col("x")), m=("max", F.col("x")))
    following = {(r.g, r.x): r.nxt for r in segments.bare(segments.following(segments.ranged(rows, ["g"], ["x"]), "x", "nxt")).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in segments.bare(sums).collect():
        before = [x for x in by[r.g] if x < r.x]
        assert (r.s, r.m) == ((sum(before), max(before)) if before else (None, None))
        assert following[r.g, r.x] == min((x for x in by[r.g] if x > r.x), default=None)


def month(k):
    d = day(k)
    return d.year * 12 + d.month


RULES = {
    "before": lambda a, b, c, d: b < c, "after": lambda a, b, c, d: a > d, "inside": lambda a, b, c, d: a >= c and b <= d, "during": lambda a, b, c, d: a >= c and b <= d,
    "overlap": lambda a, b, c, d: a <= d and b >= c, "equal": lambda a, b, c, d: month(a) <= month(d) and month(b) >= month(c),
}


def matched(frame):
    return Counter((r.qid, r.start, r.end) for r in frame.collect())


def all_pairs(spans, anchors, test):
    full = [(k, c, d) for k, c, d in anchors if k is not None and c is not None and d is not None]
    return Counter((k, day(a), day(b)) for k, a, b in spans if a is not None and b is not None and any(k == q and test(a, b, c, d) for q, c, d in full))


@pytest.fixture(scope="module")
def anchors(spark, facts, spans):
    some = [(k, a, b) for i, (k, a, b) in enumerate(spans) if i % 11 == 0 or a is None or b is None]
    return some, spark.createDataFrame([(k, day(a), day(b)) for k, a, b in some], "qid string, start date, end date")


@pytest.mark.parametrize("relation", RULES)
def test_any_match_against_all_pairs(facts, spans, anchors, relation):
    got = constraints.any_match(facts.where("qid IS NOT NULL"), anchors[1].where("qid IS NOT NULL"), relation, "month" if relation == "equal" else None)
    assert matched(got) == all_pairs([s for s in spans if s[0]], anchors[0], RULES[relation])


def test_any_match_with_offsets_and_without_rules(facts, spans, anchors):
    c, a = facts.where("qid IS NOT NULL"), anchors[1].where("qid IS NOT NULL")
    own = [s for s in spans if s[0]]
    assert matched(constraints.any_match(c, a, "after", offset_days=30)) == all_pairs(own, anchors[0], lambda x, y, s, e: x <= s + 30 <= y or x <= e + 30 <= y)
    assert matched(constraints.any_match(c, a, "before", offset_days=9)) == all_pairs(own, anchors[0], lambda x, y, s, e: x <= s - 9 <= y or x <= e - 9 <= y)
    assert matched(constraints.any_offset_match(c, a, "after", 30, F.lit("30 days after"))) == all_pairs(own, anchors[0], lambda x, y, s, e: x <= e + 30 <= y)
    assert matched(constraints.any_offset_match(c, a, "before", 3, F.lit("before it ended"))) == all_pairs(own, anchors[0], lambda x, y, s, e: x <= e - 3 <= y)
    for nothing in (constraints.any_match(c, a, "equal"), constraints.any_match(c, a, "near"), constraints.any_match(c, a, "overlap", offset_days=1), constraints.any_match(c, a.limit(0), "overlap"), constraints.any_match(c.limit(0), a, "inside")):
        assert nothing.count() == 0


ALLEN = {
    "before": lambda a, b, c, d: b < c, "after": lambda a, b, c, d: a > d, "equal": lambda a, b, c, d: a == c and b == d, "during": lambda a, b, c, d: a >= c and b <= d,
    "contains": lambda a, b, c, d: a <= c and b >= d, "overlaps": lambda a, b, c, d: a < c <= b < d, "overlapped_by": lambda a, b, c, d: c < a <= d < b, "starts": lambda a, b, c, d: a == c and b <= d,
    "started_by": lambda a, b, c, d: a == c and b >= d, "finishes": lambda a, b, c, d: a >= c and b == d, "finished_by": lambda a, b, c, d: a <= c and b == d, "meets": lambda a, b, c, d: b == c, "metby": lambda a, b, c, d: a == d,
}


#: One of each shape of region; test_core.py has all of them on small keys.
@pytest.mark.parametrize("relation", ["before", "equal", "during", "overlaps", "overlapped_by", "started_by", "meets"])
def test_counts_of_a_hot_key(facts, spans, relation):
    whole = facts.where("start IS NOT NULL AND end IS NOT NULL")
    counted = Counter(s for s in spans if s[0] is not None and s[1] is not None and s[2] is not None)
    by = defaultdict(list)
    for (k, a, b), n in counted.items():
        by[k].append((a, b, n))
    want = {(k, day(a), day(b)): (n, sum(m for c, d, m in by[k] if ALLEN[relation](a, b, c, d))) for (k, a, b), n in counted.items()}
    got = {(r.qid, r.start, r.end): (r.n, r.matches) for r in intervals.relation_counts(whole, "qid", relation).collect()}
    assert got == want


def test_counts_with_null_days_and_other_partners(facts, spans, anchors):
    """A day that a relation does not ask for may be null: before asks for x's end and y's start."""
    got = {(r.qid, r.start, r.end): r.matches for r in intervals.relation_counts(facts, "qid", "before", anchors[1]).collect()}
    want = {(k, day(a), day(b)): 0 if b is None else sum(1 for q, c, d in anchors[0] if q == k and c is not None and b < c) for k, a, b in spans if k is not None}
    assert got == want
    met = constraints.any_interval_match(facts.where("qid IS NOT NULL"), anchors[1], "overlaps")
    assert matched(met) == all_pairs([s for s in spans if s[0]], anchors[0], ALLEN["overlaps"])
