"""Unit tables, properties and plain models of the fact operators."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofacts.functions import predicates as P
from chronofacts.functions import text as X
from chronofacts.functions import timeparse as D
from chronofacts.operators import curate, intervals, programs, similarity
from chronofacts.sources import facts as S

TIMES = [
    ("2015-12-31", "2015-12-31", "2015-12-31", "day"), ("2013-11", "2013-11-01", "2013-11-30", "month"), ("2015", "2015-01-01", "2015-12-31", "year"), ("Apr 2011", "2011-04-01", "2011-04-30", "month"),
    ("27 October 2006", "2006-10-27", "2006-10-27", "day"), ("January 1st, 1981", "1981-01-01", "1981-01-01", "day"), ("1992-1998", "1992-01-01", "1998-12-31", None), ("1977-01-01 to 1983-01-01", "1977-01-01", "1983-01-01", None),
    ("1977-01-01-1983-01-01", "1977-01-01", "1983-01-01", None), ("308-01-01", None, None, None), ("soon", None, None, None), ("", None, None, None), ("2011 to present", None, None, None), ("2013-02-30", None, None, None),
]


def test_time_table(spark):
    rows = spark.createDataFrame([(t,) for t, *_ in TIMES], "t string").select("t", D.normalize_time(F.col("t")).alias("n"), D.time_error(F.col("t")).alias("e")).collect()
    for r, (t, start, end, kind) in zip(rows, TIMES):
        got = r.n and (str(r.n.start), str(r.n.end), r.n.granularity)
        assert got == ((start, end, kind) if start else None), t
        assert r.e == (t == "2011 to present")


def test_flexible_dates(spark):
    rows = [("308-01-05", "0308-01-05"), ("1999", "1999-01-01"), ("1999-3", "1999-03-01"), ("x", None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(D.flexible_date(F.col("t")).cast("string")).collect()
    assert [r[0] for r in got] == [b for _, b in rows]


def _ranges(spark, n=300, seed=1):
    rnd = random.Random(seed)
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(k)
    rows = []
    for k in range(n):
        a, b = sorted(rnd.choices(range(12), k=2))
        c, d = sorted(rnd.choices(range(12), k=2))
        rows.append((k, day(a), day(b), day(c), day(d)))
    return spark.createDataFrame(rows, "id int, xs date, xe date, ys date, ye date")


def test_allen_laws(spark):
    df = _ranges(spark)
    x = (F.col("xs"), F.col("xe"), F.col("ys"), F.col("ye"))
    y = (x[2], x[3], x[0], x[1])
    pairs = [("before", "after"), ("during", "contains"), ("overlaps", "overlapped_by"), ("starts", "started_by"), ("finishes", "finished_by"), ("meets", "metby"), ("equal", "equal")]
    bad = [F.count_if(P.ALLEN[a](*x) != P.ALLEN[b](*y)).alias(a) for a, b in pairs]
    assert set(df.agg(*bad).first()) == {0}


def test_two_offset_rules_differ(spark):
    df = spark.sql("SELECT date'2000-01-11' xs, date'2000-01-11' xe, date'2000-01-01' ys, date'2000-01-05' ye")
    x = (F.col("xs"), F.col("xe"), F.col("ys"), F.col("ye"))
    r = df.select(P.offset_matches_any(*x, F.lit("after"), F.lit(10)), P.offset_matches(*x, F.lit("after"), F.lit(10), F.lit("")), P.offset_matches(*x, F.lit("after"), F.lit(10), F.lit("10 days after it began"))).first()
    assert tuple(r) == (True, False, True)


def _merge(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return sorted(map(tuple, out))


def test_union_and_intersection_match_plain_models(spark):
    df = _ranges(spark, 200, 3).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("m"), F.col("xs").alias("start"), F.col("xe").alias("end"))
    rows = df.collect()
    for k in range(7):
        own = [(r.start, r.end) for r in rows if r.k == k]
        got = sorted((r.start, r.end) for r in intervals.union(df.where(F.col("k") == k), "k").collect())
        assert got == _merge(own)
    got = {(r.k, r.start + dt.timedelta(n)) for r in intervals.intersection(df, "k", "m").collect() for n in range((r.end - r.start).days + 1)}
    days = lambda k, m: {r.start + dt.timedelta(n) for r in rows if r.k == k and r.m == m for n in range((r.end - r.start).days + 1)}
    assert got == {(k, d) for k in range(7) for d in set.intersection(*(days(k, m) for m in range(3)))}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8))
def test_strata_add_up(sizes):
    got = curate.allocate_strata([((str(k),), n) for k, n in enumerate(sizes)])
    assert [sum(got[str(k),].values()) for k in range(len(sizes))] == sizes
    total = sum(sizes)
    assert all(abs(sum(x[name] for x in got.values()) - total * w / 10) < 1 for name, w in curate.SPLITS)


@pytest.mark.parametrize("target", [1, 5, 9, 14, 15, 29, 30, 40])
def test_water_level_equals_the_loop(spark, target):
    sizes = {"a": 10, "b": 3, "c": 10, "d": 7}
    rows = [("l", k, f"{i:03d}") for k, n in sizes.items() for i in range(n)]
    left = dict(sizes)
    while sum(left.values()) > target:
        top = max(left.values())
        left[min(k for k, n in left.items() if n == top)] -= 1
    got = curate.water_level(spark.createDataFrame(rows, "level string, kind string, h string"), "level", "kind", "h", target).collect()
    assert sorted((r.kind, r.h) for r in got) == sorted((k, f"{i:03d}") for k, n in left.items() for i in range(n))


def test_relation_grammar(spark):
    got = spark.createDataFrame([("X < Y & duration_10 days after",), ("duration_before",), ("union",), ("X q Y",), (None,)], "r string").select(programs.parse_relation(F.col("r")).alias("p")).collect()
    assert [(c.relation, c.anchor_index, c.offset_days) for c in got[0].p.constraints] == [("before", 0, None), ("after", 1, 10)]
    assert got[1].p.constraints[0].needs_question_offset and got[2].p.operator == "union"
    assert got[3].p.unsupported[0].reason == "unknown_allen_symbol:q" and got[4].p.operator is None


def test_answers_from_events(spark):
    events = [("alpha", "held", "ivory", dt.date(2000, 1, 1), dt.date(2000, 1, 11)), ("bravo", "held", "amber", dt.date(2000, 1, 5), dt.date(2000, 1, 25)), ("gamma", "held", "olive", dt.date(2001, 1, 1), dt.date(2001, 1, 11))]
    df = spark.createDataFrame([(events,)], f"e array<{programs.EVENT}>")
    cases = [
        ("union", "", ["2000-01-01 to 2000-01-25", "2001-01-01 to 2001-01-11"]), ("intersection", "", []), ("sum", "", ["40 days"]), ("average", "", ["13 days"]), ("rank_start_time", "event where bravo held amber among all", ["2"]),
        ("duration_compare", "Which one lasted the longest among gamma, bravo, alpha?", ["2"]), ("duration_compare", "Which one lasted the shortest among gamma, bravo, alpha?", ["1", "3"]),
        ("duration_compare", "Which one is the 2nd longest among alpha, bravo, gamma?", ["1"]), ("duration_compare", "Is the duration of alpha longer than that of bravo?", ["shorter"]),
    ]
    for operator, question, want in cases:
        got = df.select(programs.answer_from_events(F.lit(operator), F.col("e"), F.lit(question)).alias("a")).first().a
        assert got == want, (operator, question, got)


def test_fact_lines(spark):
    lines = ["# note", "", "A_b\tr_x\tC\t2009-05-11", "A\tr\tC\t2000\t2001", "A\tr\tC\t2009-13-11", "A\tr"]
    got = S.parse_facts(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.head, r.timestamp, r.parse_error is None) for r in got] == [("A b", "2009-05-11", True), ("A", "2000-2001", True), ("A", "2009-13-11", False), ("A", None, False)]


def test_vocabulary_ranks(spark):
    names = spark.createDataFrame([(x,) for x in ["b", "a", "é", "a", "Z", None]], "n string")
    assert sorted((r.id, r.name) for r in S.vocabulary(names, "n", "id").collect()) == [(0, "Z"), (1, "a"), (2, "b"), (3, "é")]


def test_top_k_blocks_agree(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id < 9").withColumnRenamed("id", "query_id")
    one = {tuple(r) for r in similarity.scores(q, v).selectExpr("query_id", "id", "round(score, 9)").collect()}
    many = {tuple(r) for r in similarity.scores(q, v, block=2).selectExpr("query_id", "id", "round(score, 9)").collect()}
    assert one == many and len(one) == 360


def test_short_ids_and_texts(spark):
    r = spark.range(1).select(X.short_id(F.lit("a"), "ent_"), X.squeezed_text(F.lit(" A b\tC ")), X.canonical_answer(F.lit("1999-01-01 - 2000-01-01")), X.folded_text(F.lit("Straße  Ａ")), X.ordinal(F.lit("2nd"))).first()
    assert tuple(r) == ("ent_hvfkN_qlp_zhXR3c", "abc", "1999-01-01 to 2000-01-01", "strasse a", 2)


@pytest.mark.parametrize("name", list(P.ALLEN))
def test_relation_counts_take_every_pair_of_a_key(spark, name):
    rnd = random.Random(name)
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(k)
    rows = [(rnd.choice("ab"), *(day(x) for x in rnd.choices(range(-9, 9), k=2))) for _ in range(60)]  # some end before they start
    rows += rows[:9] + [("d", day(k), day(k + k % 7)) for k in range(90)] + [("a", None, day(1)), ("a", day(1), None), (None, day(1), day(1)), ("c", day(3), day(3))]
    df = spark.createDataFrame(rows, "head string, start date, end date")
    got = {(r.head, r.start, r.end): (r.n, r.matches) for r in intervals.relation_counts(df, "head", name).collect()}
    side = lambda a: df.select("head", F.col("start").alias(f"{a}s"), F.col("end").alias(f"{a}e"))
    pairs = side("x").join(side("y"), "head").where(P.ALLEN[name](F.col("xs"), F.col("xe"), F.col("ys"), F.col("ye"))).groupBy("head", "xs", "xe").count().collect()
    assert {k: n * m for k, (n, m) in got.items() if m} == {(r.head, r.xs, r.xe): r["count"] for r in pairs}
