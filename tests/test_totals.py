"""Totals of interval relations: keys that lie inside a strip are finished there, and the grid gets the few that a strip may cut."""

import datetime as dt
import random

import pytest

from chronofacts.operators import dominance, intervals
from chronofacts.plans import workload

RULES = {
    "before": lambda a, b, c, d: b < c, "after": lambda a, b, c, d: a > d, "equal": lambda a, b, c, d: a == c and b == d, "during": lambda a, b, c, d: a >= c and b <= d, "contains": lambda a, b, c, d: a <= c and b >= d,
    "overlaps": lambda a, b, c, d: a < c <= b < d, "overlapped_by": lambda a, b, c, d: c < a <= d < b, "starts": lambda a, b, c, d: a == c and b <= d, "started_by": lambda a, b, c, d: a == c and b >= d,
    "finishes": lambda a, b, c, d: a >= c and b == d, "finished_by": lambda a, b, c, d: a <= c and b == d, "meets": lambda a, b, c, d: b == c, "metby": lambda a, b, c, d: a == d,
}


def _day(k):
    return None if k is None else dt.date(2000, 1, 1) + dt.timedelta(k)


@pytest.fixture(scope="module")
def facts():
    """Small keys, a hot one, ends before starts, equal facts, and keys, tails and days that are null."""
    dice = random.Random(11)
    rows = [("hot" if k % 4 == 0 else f"k{dice.randrange(30)}", f"t{dice.randrange(9)}" if k % 17 else None, s, s + dice.randrange(-2, 9)) for k, s in ((k, dice.randrange(25)) for k in range(600))]
    return rows + rows[:20] + [("k3", "t1", None, 4), ("k4", "t1", 4, None), (None, "t1", 3, 4), ("alone", "t1", 9, 2)]


@pytest.mark.parametrize("relation", list(RULES))
def test_totals_equal_all_pairs(spark, monkeypatch, facts, relation):
    monkeypatch.setattr(dominance, "STRIP_ROWS", 60)
    want = {}
    # A null day stands in no comparison, like nan; where it is not asked for, it does not matter.
    known = [(k, t, *(float("nan") if x is None else x for x in days)) for k, t, *days in facts]
    for k, t, a, b in known:
        n = sum(RULES[relation](a, b, c, d) for q, _, c, d in known if q == k and k is not None)
        if n:
            pairs, tails = want.get(k, (0, set()))
            want[k] = (pairs + n, tails | ({t} - {None}))
    df = spark.createDataFrame([(k, t, _day(a), _day(b)) for k, t, a, b in facts], "name string, what string, start date, end date")
    got = intervals.relation_totals(df, "name", "what", relation).collect()
    assert {r.name: (r.pairs, r.tails) for r in got} == {k: (n, len(t)) for k, (n, t) in want.items()} and len(got) == len(want)


def test_the_grid_gets_cut_keys_only(spark, monkeypatch):
    """Scratch disk went to all facts that were dealt over and over: 100 keys of 600 facts, of which at most two for each strip may be dealt again."""
    seen, counts = [], intervals.relation_counts
    monkeypatch.setattr(intervals, "relation_counts", lambda df, *rest: (seen.append(df.count()), counts(df, *rest))[1])
    found = workload.QUERIES["allen_during"](spark, "/root/testdata/sf0.01")
    assert found.count() == 100
    strips = spark.sparkContext.defaultParallelism
    whole = workload.supplies(spark, "/root/testdata/sf0.01").count()
    assert seen[0] < whole * (2 * strips + 2) / 100 and whole > 40_000


def test_numbers_stand_for_names(spark, tmp_path):
    """Suppliers and parts that share a name are one head and one tail, as in the SQL; without a name they are no head, and no tail that counts."""
    for name, rows, kinds in (
        ("supplier", [(1, "a"), (2, "a"), (3, None), (4, "b")], "s_suppkey long, s_name string"), ("part", [(1, "p"), (2, "p"), (3, None)], "p_partkey long, p_name string"),
        ("lineitem", [(s, p, dt.datetime(1998, 1, d)) for s, p, d in [(1, 1, 3), (1, 1, 5), (2, 1, 9), (1, 2, 3), (2, 3, 4), (3, 1, 3), (4, 9, 3), (4, 3, 7)]], "l_suppkey long, l_partkey long, l_shipdate timestamp_ntz"),
    ):
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    # a: part 1 from day 3 to 9, part 2 on day 3, part 3 on day 4. b: part 3 on day 7.
    found = workload.QUERIES["allen_during"](spark, str(tmp_path))
    assert sorted(map(tuple, found.select("head", "pairs", "tails").collect())) == [("a", 5, 1), ("b", 1, 0)]
