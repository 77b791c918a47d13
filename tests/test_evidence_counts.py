"""Evidence counts from one row for each fact agree with the evidence itself."""

import pytest

from chronofacts.operators import constraints

PLANS = "qid int, constraints array<struct<anchor_kind:string,relation:string,anchor_index:int,time_text:string,interval_start:string,interval_end:string,granularity:string,offset_days:int>>, ranking struct<rank:string,rank_k:int>"
BEFORE, AFTER = [("explicit", r, None, t, None, None, None, None) for r, t in (("before", "2001"), ("after", "1990"))]


@pytest.fixture(scope="module")
def case(spark):
    kinds = [[], [BEFORE], [BEFORE, AFTER], [("explicit", "before", None, "1900", None, None, None, None), AFTER]]
    plans = [(10 * k + r, c, ranking) for k, c in enumerate(kinds) for r, ranking in enumerate((None, ("asc", 1), ("desc", 4), ("asc", 0), ("asc", 99)))]
    times = ["1980-01-01", "1995-05-05", "1995-05-05-1996-01-01", "2005-01-01", "May 1999", "soon", None]
    rows = [(q, pos, f"h{pos % 3}", "r", f"t{pos % 5}", times[pos % 7]) for q, *_ in plans for pos in range(60)]
    return spark.createDataFrame(plans, PLANS), spark.createDataFrame(rows, "qid int, pos int, head string, relation string, tail string, timestamp string"), spark.createDataFrame([], "qid int, anchor_index int, timestamp string")


def test_counts_agree_with_the_evidence(case):
    plans, candidates, anchors = case
    got = {r.qid: r for r in constraints.evidence_stats(plans, candidates, anchors, cap=10).collect()}
    kept = {r.qid: r["count"] for r in constraints.constrained(plans, candidates, anchors, cap=10).groupBy("qid").count().collect()}
    assert {q: r.final_count for q, r in got.items()} == {q: kept.get(q, 0) for q in got} and len(got) == 20
    facts = {}
    for r in constraints.apply_constraints(plans, candidates, anchors).collect():
        facts.setdefault(r.qid, {})[r.head, r.tail, r.timestamp] = r.passed
    for q, r in got.items():
        after = [sum(p >= k for p in facts[q].values()) for k in range(1, [0, 1, 2, 2][q // 10] + 1)]
        want = after[: after.index(0) + 1] if 0 in after else after
        assert (r.retrieved_count, list(r.after_counts), r.executed_constraint_count) == (60, want, len(want))


def test_counts_read_the_candidates_in_one_pass(case, spark):
    """Without a window, a generated row for each step or a second read of the tested candidates."""
    plan = constraints.evidence_stats(*case)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Window", "Generate", "Expand", "Checkpoint"))
