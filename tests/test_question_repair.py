"""Question repair: every reason and status, each rule, and audit rows, by cases written by hand."""

import pytest

from chronofacts.operators import repair

SCHEMA = "id int, question string, question_level string, question_type string, answer_type string, temporal_relation string, events array<string>, extra string"
ASKED, ANCHOR = "Bob|led|Acme|2000-01-01|2000-12-31", "Ann|joined|Org|1999-06-01|1999-06-30"
M, C = repair.OFFSET_KIND, repair.PREFIX_KIND


def case(question, answer="object", relation="duration_after", events=(ASKED, ANCHOR), level="medium", kind=M):
    return question, level, kind, answer, relation, events and list(events)


CASES = [
    # question, reason, status, new question
    (case("200 days Bob led Acme, in which organisation, Bob led?"), "ok", "repaired", "200 days after Ann joined Org, in which organisation, Bob led?"),
    (case("200 days  Bob  led Acme, in which organisation, Bob led? "), "ok", "repaired", "200 days  after Ann joined Org, in which organisation, Bob led? "),
    (case("200 days Ann joined Org, in which organisation, Bob led?"), "ok", "object_after_first_clause_not_query_event", None),
    (case("7 days Ann joined Org, in which organisation, x?", relation="duration_before", events=(ASKED, "Ann|joined|Org|2000-02-01|2001")), "ok", "repaired", "7 days before Ann joined Org, in which organisation, x?"),
    (case("7 days Bob led Acme, in which organisation, x?", relation="duration_before", events=(ASKED, "Ann|joined|Org|2000-02-01|2001")), "ok", "object_before_first_clause_not_anchor_event", None),
    (case("200 days after Ann joined Org, in which organisation, Bob led?"), "ok", "already_has_connector", None),
    (case("Where was Bob 200 days Ann joined Org?"), "ok", "object_pattern_not_matched", None),
    (case("Who led Acme 200 days Ann joined Org?", "subject"), "ok", "repaired", "Who led Acme 200 days after Ann joined Org?"),
    (case("Who led Acme 200 days Ann joined Org", "subject"), "ok", "subject_pattern_not_matched", None),
    (case("Who led Acme 200 days Ann left Org?", "subject"), "ok", "subject_anchor_clause_not_anchor_event", None),
    (case("9 days x?", events=(ASKED, ANCHOR)), "target_not_in_query_interval", "offset_invalid", None),
    (case("200 days x?", events=(ASKED,)), "events_lt_2", "offset_invalid", None),
    (case("200 days x?", events=None), "events_lt_2", "offset_invalid", None),
    (case("200 days x?", events=("Bob|led", ANCHOR)), "bad_query_event_format", "offset_invalid", None),
    (case("200 days x?", events=(ASKED, "Ann|joined|Org|1999")), "bad_anchor_event_format", "offset_invalid", None),
    (case("some days x?"), "offset_not_found_in_question", "offset_invalid", None),
    (case(None), "offset_not_found_in_question", "offset_invalid", None),
    (case("200 days x?", events=("Bob|led|Acme|soon|2000", ANCHOR)), "bad_query_date", "offset_invalid", None),
    (case("200 days x?", events=(ASKED, "Ann|joined|Org|1999|2000-13-01")), "bad_anchor_date", "offset_invalid", None),
    (case("200 days x?", events=("Bob|led|Acme|2001|2000", ANCHOR)), "query_interval_start_after_end", "offset_invalid", None),
    (case("200 days x?", events=(ASKED, "Ann|joined|Org|1999-07|1999-06")), "anchor_interval_start_after_end", "offset_invalid", None),
]
OTHERS = [
    (case("Who Bob Acme, when?", "subject", "x", level="complex", kind=C), "Who led Acme, when?"), (case("Who is Bob Acme, when?", "subject", "x", level="complex", kind=C), None), (case("200 days x?", level="simple"), None),
    (case("200 days x?", "timestamp"), None), (case("200 days x?", relation="before"), None), (case("200 days x?", kind="other"), None), (case("200 days x?", relation=None), None),
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [c for c, *_ in CASES] + [c for c, _ in OTHERS]
    return spark.createDataFrame([(k, *r, "kept") for k, r in enumerate(rows)], SCHEMA)


def test_audit_rows_tell_reason_status_and_rule(frame):
    got = {r.id: r for r in repair.audit(frame).collect()}
    assert len(got) == len(CASES) + 1
    for k, ((question, *_), reason, status, new) in enumerate(CASES):
        r = got[k]
        assert (r.reason, r.status, r.offset_valid, r.old_question, r.new_question) == (reason, status, reason == "ok", question, new or question), k
        assert (r.rule is None) == (new is None)
        assert r.note == (None if new else f"offset_invalid_skip_repair:{reason}" if reason != "ok" else f"offset_valid_but_not_repaired:{status}")
    assert got[0].rule.startswith("M1A") and got[3].rule.startswith("M1B") and got[7].rule.startswith("M2") and got[len(CASES)].rule == repair.PREFIX_RULE
    assert (got[0].boundary_kind, str(got[0].boundary_date), str(got[0].target_date)) == ("anchor_end", "1999-06-30", "2000-01-16") and got[3].boundary_kind == "anchor_start"


def test_repaired_changes_questions_only(frame):
    before, after = ({r.id: r for r in df.collect()} for df in (frame, repair.repaired(frame)))
    wanted = [new for *_, new in CASES] + [new for _, new in OTHERS]
    for k, new in enumerate(wanted):
        assert after[k].question == (new or before[k].question)
        assert after[k][2:] == before[k][2:]


def test_counts_and_empty_tables(frame):
    n = {r.counter: r.n for r in repair.counts(repair.audit(frame)).collect()}
    assert n["target_total"] == len(CASES) and n["offset_valid"] == sum(r == "ok" for _, r, *_ in CASES)
    assert n["changed_total"] == 5 and n["offset_invalid::events_lt_2"] == 2 and n["status::repaired"] == 4
    assert repair.audit(frame.limit(0)).count() == 0 and repair.counts(repair.audit(frame.limit(0))).count() == 0
