"""One function each over inputs written by hand, and the results that the rules state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofacts.functions import predicates as P
from chronofacts.functions import text as X
from chronofacts.functions import timeparse as D
from chronofacts.operators import curate, programs

RULES: dict[str, tuple] = {}


def rule(name: str, inputs: str, outputs: str, rows: Sequence[tuple], *results: Callable[..., Column]) -> None:
    """``rows`` are inputs followed by expected outputs; each result function takes the input columns. ``inputs`` and ``outputs`` are schemas."""
    RULES[name] = inputs, outputs, rows, results


# Times

rule("rule_explicit_interval", "a string, b string", "first date, last date", [
    ("2011", "2013-11", "2011-01-01", "2013-11-30"), ("Apr 2011", "27 October 2016", "2011-04-01", "2016-10-27"), ("2011", "soon", None, None), ("1992", "1992", "1992-01-01", "1992-12-31"),
], lambda a, b: D.explicit_interval(a, b)["start"], lambda a, b: D.explicit_interval(a, b)["end"])
_COARSE = lambda k: lambda a, b, g: D.coarsen(a.cast("date"), b.cast("date"), g)[k]
rule("rule_coarsen", "a string, b string, g string", "first date, last date", [
    ("2015-02-10", "2016-02-10", "day", "2015-02-10", "2016-02-10"), ("2015-02-10", "2016-02-10", "month", "2015-02-01", "2016-02-29"),
    ("2015-02-10", "2016-02-10", "year", "2015-01-01", "2016-12-31"), ("2015-02-10", "2016-02-10", None, "2015-02-10", "2016-02-10"),
], _COARSE(0), _COARSE(1))
rule("rule_dates", "x string", "flexible date, iso date", [
    ("1999", "1999-01-01", None), ("1999-7", "1999-07-01", None), ("1999-07-05", "1999-07-05", "1999-07-05"), ("1999-13-05", None, None), ("308-01-02", "0308-01-02", "0308-01-02"), ("soon", None, None), ("", None, None), (None, None, None),
], D.flexible_date, D.iso_date)
rule("rule_sort_date", "x string", "d date", [
    ("1999-07-05", "1999-07-05"), ("1999-07", "1999-07-01"), ("1999", "1999-01-01"), ("soon", "9999-12-31"), (None, "9999-12-31"), ("1999-02-30", "9999-12-31"),
], D.sort_date)
rule("rule_interval_text", "a string, b string", "text string, duration string, raw string, granularity string, is_interval boolean", [
    ("2000-01-01", "2000-01-31", "2000-01-01 to 2000-01-31", "30 days", "2000-01-01 to 2000-01-31", None, True),
    ("2000-01-01", "2000-01-01", "2000-01-01 to 2000-01-01", "0 days", "2000-01-01 to 2000-01-01", "day", False),
], D.interval_text, lambda a, b: D.duration_text(a.cast("date"), b.cast("date")), *(lambda a, b, f=f: D.event_time(a.cast("date"), b.cast("date"))[f] for f in ("raw", "granularity", "is_interval")))
_EDGE = lambda f: lambda t, a, b: D.edge_time(t, a, b)[f]
rule("rule_edge_time", "t string, a string, b string", "first date, last date", [
    ("2001-02-03", "1990-01-01", "1991-01-01", "2001-02-03", "2001-02-03"), ("soon", "1990-01-01", "1991-01-01", "1990-01-01", "1991-01-01"), (None, "1990-01-01", "1991-01-01", "1990-01-01", "1991-01-01"), ("soon", "x", "y", None, None),
], _EDGE("start"), _EDGE("end"))
rule("rule_answer_timestamps", "x string", "forms list", [
    ("2001-02-03", ["2001-02-03-2001-02-03"]), ("2001-02-03-2004-05-06", ["2001-02-03-2004-05-06", "2001-02-03-2001-02-03", "2004-05-06-2004-05-06"]),
    ("2001-02-03-2001-02-03", ["2001-02-03-2001-02-03"]), (" January  1st, 1981", ["january 1st, 1981"]), ("", []), (None, []),
], D.answer_timestamps)
rule("rule_gold_answer", "x string", "gold string", [
    ("1999", None), ("12 days", None), ("1 day", None), ("-5", "-5"), ("3.5", "3.5"), ("2001-02-03", "2001-02-03-2001-02-03"), ("2001-02-03 to 2004-05-06", "2001-02-03-2004-05-06"), (" Some  Name ", "some name"), ("", ""), ("Ｆull", "full"), (None, None),
], D.gold_answer)
rule("rule_dates_in", "x string", "found list", [("from 2001-02-03 to 2004", ["2001-02-03", "2004"]), ("none", []), ("1999, 2000-01-01", ["1999", "2000-01-01"])], D.dates_in)

# Texts

rule("rule_texts", "x string", "slot string, folded string, squeezed string", [
    (" [A] {b} ", "a b", "[a] {b}", "[a]{b}"), ("Straße  Ａ", "straße  ａ", "strasse a", "straßeａ"), ("A\tB", "a\tb", "a b", "ab"), ("", "", "", ""),
], X.slot_text, X.folded_text, X.squeezed_text)
rule("rule_lists_and_numbers", "x string", "items list, number double, item string", [("3.5", ["3.5"], 3.5, "3.5"), ("equals", ["equals"], None, "equal"), (" equals ", [" equals "], None, "equal"), (None, [], None, None)], X.as_list, X.to_number, X.answer_item)
rule("rule_ordinal", "x string", "n int", [("second", 2), ("Tenth", 10), ("2nd", 2), ("11th", 11), ("7", 7), ("eleventh", None), ("", None), (None, None)], X.ordinal)
_OFFSET = lambda f: lambda q: X.offset_in(q)[f]
rule("rule_offset", "q string", "days int, relation string", [("What happened 12 days after x?", 12, "after"), ("3 Days Before the war, who?", 3, "before"), ("days after x", None, None), ("5 days later", None, None)], _OFFSET("days"), _OFFSET("relation"))
rule("rule_clauses", "q string", "sides list", [("After a, who b?", ["After a", "who b?"]), ("Who b?", ["Who b?", "Who b?"]), ("a, b, c", ["a", "b, c"])], X.clauses)
rule("rule_boundary_cue", "q string", "cue string", [("when did it start", "start"), ("when did it end", "end"), ("did it start or end", None), ("who", None), ("the starter finished", "end")], P.boundary_cue)
rule("rule_answer_forms", "x string", ", ".join(f"{n} boolean" for n in X.ANSWER_FORMS) + ", is_temporal boolean", [
    ("1999", True, False, False, False, True, False, True), ("99", False, False, False, False, True, False, False), ("308-01-01", False, True, False, False, False, False, True),
    ("2001-02-03  to 2004-05-06", False, False, True, False, False, False, True), ("1999 to 2001", False, False, False, False, False, False, False), ("12 days", False, False, False, True, False, False, True),
    ("1 day", False, False, False, False, False, False, False), ("Equal", False, False, False, False, False, True, False), ("equals", False, False, False, False, False, False, False),
], *(lambda x, n=n: X.answer_form(x, n) for n in X.ANSWER_FORMS), X.is_temporal)
rule("rule_no_answer", "x string", "plain boolean, compat boolean", [
    (None, True, True), ("", True, True), (" N/A ", True, True), ("None", True, True), ("no answer", True, False), ("null", False, False), ("unknown", False, False), ("x", False, False),
], X.no_answer, lambda x: X.no_answer(x, True))
rule("rule_unknown_slot", "h string, t string", "slot string", [("?", "b", "head"), ("a", "?", "tail"), ("a", "b", None), (None, "b", "head"), ("?", "?", "head")], X.unknown_slot)

# Curation

rule("rule_compare_subtype", "q string", "subtype string", [
    ("Which one is the second longest among a, b?", "which_one_ranked_longest_shortest"), ("Which one lasted the longest: a or b?", "which_one_longest_shortest"),
    ("Is the duration of a longer than b?", "binary_longer_shorter_equal"), ("How long is a?", "unsupported_duration_compare"),
], programs.compare_subtype)
_SPLIT = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ";"))
rule("rule_compare_answers", "o string, r string", "status string", [
    ("a;b", "", "NO_REPAIRED_ANSWER"), ("", "", "NO_REPAIRED_ANSWER"), ("a;b", "b;a", "ORIGINAL_EXACT"), ("a", "a;b", "ORIGINAL_SUBSET_OF_REPAIRED"), ("a;b", "b", "REPAIRED_SUBSET_OF_ORIGINAL"),
    ("a;b", "b;c", "DIFFERENT"), ("", "a", "DIFFERENT"),
], lambda o, r: programs.compare_answers(_SPLIT(o), _SPLIT(r)))
_KEEP = lambda f: lambda s, n: programs.retention(s, F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string")), 3)[f]
rule("rule_retention", "s string, n int", "keep boolean, reason string", [
    ("ORIGINAL_EXACT", 5, True, "ORIGINAL_EXACT"), ("ORIGINAL_SUBSET_OF_REPAIRED", 3, True, "ORIGINAL_SUBSET_OF_REPAIRED_SIZE_LE_3"), ("ORIGINAL_SUBSET_OF_REPAIRED", 4, False, "SUBSET_BUT_SEMANTIC_GOLD_TOO_LARGE:4>3"),
    ("REPAIRED_SUBSET_OF_ORIGINAL", 1, True, "REPAIRED_SUBSET_OF_ORIGINAL_ACCEPTED"), ("DIFFERENT", 2, False, "REPAIR_STATUS_NOT_ACCEPTED:DIFFERENT"), ("EXCEPTION", 1, False, "REPAIR_STATUS_NOT_ACCEPTED:EXCEPTION"),
], _KEEP("keep"), _KEEP("reason"))
rule("rule_small_answers", "x string, n int", "small boolean", [("a;b", 2, True), ("a;b;c", 3, False), ("", 0, True)], lambda x, n: curate.small_answers(_SPLIT(x), 2))
rule("rule_mentioned", "name string, q string", "found boolean", [("Jean-Luc", "did JEAN–LUC  win?", True), ("Anna", "did Ann win?", False), ("", "any", False), (None, "any", False)], curate.mentioned)
_EVENTS = lambda x: F.split(x, ";")
rule("rule_mentioned_events", "events string, q string", "kept list", [
    ("a b|r|c|1|2;d|r|e|1|2;broken", "who is A  B?", ["a b|r|c|1|2", "broken"]), ("d|r|e|1|2", "nothing", []), ("d|r|e|1|2", "the e", ["d|r|e|1|2"]),
], lambda x, q: curate.mentioned_events(_EVENTS(x), q))
rule("rule_all_points", "events string", "points boolean", [("a|r|b|1|1;c|r|d|2|2", True), ("a|r|b|1|1;c|r|d|2|3", False), ("broken", False)], lambda x: curate.all_points(_EVENTS(x)))
rule("rule_answer_change", "t string, b string, a string", "error string", [
    ("timestamp", "1999", "1999-01-01", None), ("timestamp", "1999", "soon", "answer_not_temporal"), ("timestamp", "1999", "1999;2000", "answer_count_changed"), ("subject", "Ann", "Bob", "answer_must_not_change"), ("subject", "Ann", "Ann", None),
    ("duration", "longer", "12 days", "answer_must_not_change"),
], lambda t, b, a: curate.answer_change_error(t, _SPLIT(b), _SPLIT(a)))
rule("rule_normalize_durations", "x string", "days list", [("2000-01-01 to 2000-01-31", ["30 days"]), ("308-01-01 to 309-01-01;x", ["366 days", "x"]), ("12 days", ["12 days"])], lambda x: curate.normalize_durations(_SPLIT(x)))
rule("rule_question_mark", "q string", "text string", [("Who  is it", "Who is it?"), ("Who is it?", "Who is it?"), ("Who is it.", "Who is it?"), (" Who! ", "Who?")], curate.ensure_question_mark)

# Orders

rule("rule_sorted_events", "events string", "ordered list", [
    ("b|r|c|2001-01-01|2002-01-01;a|r|c|1999|2000;x|r|y|soon|z", ["a|r|c|1999|2000", "b|r|c|2001-01-01|2002-01-01", "x|r|y|soon|z"]), ("b|r|c|2001|2;a|r|c|2001|2", ["a|r|c|2001|2", "b|r|c|2001|2"]),
], lambda x: curate.sorted_events(_EVENTS(x)))
rule("rule_answers_by_event", "answers string, events string", "ordered list", [
    ("c;a", "a|r|b|1|2;c|r|d|3|4", ["a", "c"]), ("c;z", "a|r|b|1|2;c|r|d|3|4", ["c", "z"]), ("d;b", "a|r|b|1|2;c|r|d|3|4", ["b", "d"]),
], lambda a, e: curate.answers_by_event_order(_SPLIT(a), _EVENTS(e)))
rule("rule_answers_by_start", "answers string, events string", "ordered list", [
    ("a;c", "a|r|b|2005-01-01|2006;c|r|d|1999-01-01|2000", ["c", "a"]), ("z;d;a", "a|r|b|2005-01-01|2006;c|r|d|1999-01-01|2000", ["d", "a", "z"]),
], lambda a, e: curate.answers_by_start(_SPLIT(a), _EVENTS(e)))
rule("rule_evidence_order", "q string, a string, s string, o string", "ordered list", [
    ("q", "a;b", "s;a", None, ["q", "a", "b", "s"]), ("q", "a", "s;t;s", "union", ["s", "t"]),
], lambda q, a, s, o: curate.evidence_order(q, _SPLIT(a), _SPLIT(s), o))
_PARSED = lambda e: programs.parse_events(_EVENTS(e))
rule("rule_question_order", "q string, e string", "ordered list", [
    ("Did Bob come before Ann?", "Ann|r|x|2000-01-01|2000-01-01;Bob|r|y|2001-01-01|2001-01-01;Cid|r|z|2002-01-01|2002-01-01", ["1", "0", "2"]),
], lambda q, e: F.transform(programs.question_order(q, _PARSED(e)), lambda i: i.cast("string")))


@pytest.mark.parametrize("name", RULES)
def test_rule(spark, name):
    inputs, outputs, rows, results = RULES[name]
    names, kinds = [f.split()[0] for f in inputs.split(",")], [f.split()[1] for f in outputs.split(",")]
    table = spark.createDataFrame([(k, *r[: len(names)]) for k, r in enumerate(rows)], "k int, " + inputs)
    columns = [f(*(F.col(n) for n in names)) for f in results]
    got = [tuple(r)[1:] for r in table.select("k", *(c if kind == "list" else c.cast("string" if kind == "date" else kind) for c, kind in zip(columns, kinds, strict=True))).orderBy("k").collect()]
    assert got == [tuple(r[len(names) :]) for r in rows]
