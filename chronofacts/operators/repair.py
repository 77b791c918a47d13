"""Repair of question texts that lost their temporal connector, with an audit row for each rule that applied.

The rules are a decision table: rows of (reason, condition) that are tried in order, then rows of (rule, condition, new text). A case passes them once, as column expressions; its
audit rows say what was found and why, and every step of the outcome can be counted from them.

``cases``: id, question, question_level, question_type, answer_type, temporal_relation and events (strings ``head|relation|tail|start|end``; the first is the event asked for, the
second the anchor). Null texts are no match of any condition that names a value; null events count as none. Repeated cases are judged each; other columns stay in ``repaired``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.timeparse import flexible_date

#: Which cases the offset rules are for, and how offsets, connectors and the two kinds of questions are worded in the data. Fixed values.
OFFSET_KIND, PREFIX_KIND = "timeline_position_retrieval_temporal_constrained_retrieval", "timeline_position_retrieval*2+temporal_constrained_retrieval"
CONNECTORS = {"duration_after": "after", "duration_before": "before"}
OFFSET, CONNECTED = r"(?i)(?<!\d)(\d+)\s+days\b", r"(?i)\bdays\s+(after|before)\b"
OBJECT_FORM, SUBJECT_FORM = r"^(\s*\d+\s+days\s+)(.+?)(,\s*in which organisation,\s*.+\?\s*)$", r"^(.+?)\s+(\d+)\s+days\s+(.+?)\s*\?\s*$"
#: Names of the rules, as the data's reports have them. Fixed values.
RULES = {
    ("object", "after"): "M1A_medium_object_duration_after_swap_anchor_and_add_after", ("object", "before"): "M1B_medium_object_duration_before_add_before",
    ("subject", "after"): "M2_medium_subject_duration_after_add_after", ("subject", "before"): "M2_medium_subject_duration_before_add_before",
}
PREFIX_RULE = "C1_complex_subject_prefix_relation"


def _is(name: str, *values: str) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def _first(table: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first row whose condition holds."""
    return reduce(lambda out, row: out.when(F.coalesce(row[1], F.lit(False)), row[0]), table[1:], F.when(F.coalesce(table[0][1], F.lit(False)), table[0][0])).otherwise(otherwise)


def _phrase(event: str) -> Column:
    return X.event_phrase(F.col(f"{event}.head"), F.col(f"{event}.relation"), F.col(f"{event}.tail"))


def _facts(cases: DataFrame) -> DataFrame:
    """``cases`` with what the conditions read, step by step, so that no expression holds another's copy."""
    events = F.coalesce("events", F.array().cast("array<string>"))
    out = cases.withColumns({"_n": F.size(events), "_query": X.parse_event(F.get(events, F.lit(0))), "_anchor": X.parse_event(F.get(events, F.lit(1))), "_text": F.coalesce("question", F.lit(""))})
    out = out.withColumns({"_word": F.when(_is("temporal_relation", "duration_after"), "after").when(_is("temporal_relation", "duration_before"), "before"), "_days": F.nullif(F.regexp_extract("_text", OFFSET, 1), F.lit("")).try_cast("int")})
    out = out.withColumns({f"_{e}_{end}": flexible_date(F.col(f"_{e}.{end}")) for e in ("query", "anchor") for end in ("start", "end")})
    point = F.col("_anchor_start") == F.col("_anchor_end")
    out = out.withColumns({"_kind": F.when(point, "anchor_point").when(F.col("_word") == "after", "anchor_end").otherwise("anchor_start"), "_boundary": F.when(F.col("_word") == "after", F.col("_anchor_end")).otherwise(F.col("_anchor_start"))})
    return out.withColumn("_target", F.date_add("_boundary", F.when(F.col("_word") == "after", F.col("_days")).otherwise(-F.col("_days"))))


def checked(cases: DataFrame) -> DataFrame:
    """``_facts`` with ``_reason``: ``ok``, or the first reason for which a case's offset does not fit its events. Reasons are fixed values, in the data's order."""
    table = [
        ("not_medium", ~_is("question_level", "medium")), ("not_target_question_type", ~_is("question_type", OFFSET_KIND)), ("not_target_answer_type", ~_is("answer_type", "object", "subject")),
        ("not_duration_before_after", F.col("_word").isNull()), ("events_lt_2", F.col("_n") < 2), ("bad_query_event_format", F.col("_query").isNull()), ("bad_anchor_event_format", F.col("_anchor").isNull()),
        ("offset_not_found_in_question", F.col("_days").isNull()), ("bad_query_date", F.col("_query_start").isNull() | F.col("_query_end").isNull()), ("bad_anchor_date", F.col("_anchor_start").isNull() | F.col("_anchor_end").isNull()),
        ("query_interval_start_after_end", F.col("_query_start") > F.col("_query_end")), ("anchor_interval_start_after_end", F.col("_anchor_start") > F.col("_anchor_end")),
        ("target_not_in_query_interval", ~F.col("_target").between(F.col("_query_start"), F.col("_query_end"))),
    ]
    return _facts(cases).withColumn("_reason", _first(table, "ok"))


def _rewritten(cases: DataFrame) -> DataFrame:
    """``checked`` with ``_status``, ``_rule`` and ``_new``: what became of each case of the offset rules, and of the prefix rule."""
    out = checked(cases)
    for_object, after = _is("answer_type", "object"), F.col("_word") == "after"
    part = lambda form, k: F.regexp_extract("_text", form, k)
    out = out.withColumns({"_object": F.col("_text").rlike(OBJECT_FORM), "_subject": F.col("_text").rlike(SUBJECT_FORM), "_asked": X.collapse(_phrase("_query")), "_anchored": X.collapse(_phrase("_anchor"))})
    out = out.withColumns({"_clause": X.collapse(F.when(for_object, part(OBJECT_FORM, 2)).otherwise(part(SUBJECT_FORM, 3)))})
    # Statuses are fixed values.
    table = [
        ("offset_invalid", F.col("_reason") != "ok"), ("already_has_connector", F.col("_text").rlike(CONNECTED)),
        ("object_pattern_not_matched", for_object & ~F.col("_object")), ("subject_pattern_not_matched", ~for_object & ~F.col("_subject")),
        ("object_after_first_clause_not_query_event", for_object & after & (F.col("_clause") != F.col("_asked"))), ("object_before_first_clause_not_anchor_event", for_object & ~after & (F.col("_clause") != F.col("_anchored"))),
        ("subject_anchor_clause_not_anchor_event", ~for_object & (F.col("_clause") != F.col("_anchored"))),
    ]
    target = _is("question_level", "medium") & _is("question_type", OFFSET_KIND) & _is("answer_type", "object", "subject") & F.col("_word").isNotNull()
    out = out.withColumns({"_target_case": target, "_status": F.when(target, _first(table, "repaired"))})
    fixed = F.coalesce(F.col("_status") == "repaired", F.lit(False))
    of_object = F.concat(part(OBJECT_FORM, 1), F.col("_word"), F.lit(" "), _phrase("_anchor"), part(OBJECT_FORM, 3))
    of_subject = F.concat(part(SUBJECT_FORM, 1), F.lit(" "), part(SUBJECT_FORM, 2), F.lit(" days "), F.col("_word"), F.lit(" "), _phrase("_anchor"), F.lit("?"))
    old = F.concat(F.lit("Who "), F.col("_query.head"), F.lit(" "), F.col("_query.tail"), F.lit(","))
    prefixed = _is("question_level", "complex") & _is("question_type", PREFIX_KIND) & _is("answer_type", "subject") & F.coalesce(F.col("_text").startswith(old), F.lit(False))
    of_prefix = F.concat(F.lit("Who "), F.col("_query.relation"), F.lit(" "), F.col("_query.tail"), F.lit(","), F.substring("_text", F.length(old) + 1, F.length("_text")))
    name = reduce(lambda o, kv: o.when(fixed & _is("answer_type", kv[0][0]) & (F.col("_word") == kv[0][1]), kv[1]), RULES.items(), F.when(prefixed, PREFIX_RULE))
    return out.withColumns({"_rule": name, "_new": F.when(fixed & for_object, of_object).when(fixed, of_subject).when(prefixed, of_prefix)})


def repaired(cases: DataFrame) -> DataFrame:
    """``cases`` with repaired questions; nothing else changes."""
    return _rewritten(cases).withColumn("question", F.coalesce("_new", "question")).select(*cases.columns)


def audit(cases: DataFrame) -> DataFrame:
    """A row for each rule that applied, and for each case that the offset rules are for and left as it was (``rule`` null, ``note`` why).

    The offset's fields are null where its check did not get that far: kind, boundary and target only with both intervals in order.
    """
    # A generator instead of a filter: the optimizer would write a filter's condition out into the facts that it rests on, over and over.
    once = F.when(F.col("_target_case") | F.col("_rule").isNotNull(), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    out = _rewritten(cases).withColumn("_row", F.explode(once))
    valid = F.col("_reason") == "ok"
    note = F.when(F.col("_target_case") & ~valid, F.concat(F.lit("offset_invalid_skip_repair:"), F.col("_reason"))).when(F.col("_target_case") & F.col("_rule").isNull(), F.concat(F.lit("offset_valid_but_not_repaired:"), F.col("_status")))
    placed = F.col("_target_case") & F.col("_reason").isin("ok", "target_not_in_query_interval")
    mine = lambda c: F.when(F.col("_target_case"), F.col(c))
    at = lambda c: F.when(placed, F.col(c))
    return out.select(
        "id", "question_level", "question_type", "answer_type", "temporal_relation", F.col("question").alias("old_question"), F.coalesce("_new", "question").alias("new_question"), F.col("_rule").alias("rule"), note.alias("note"),
        F.when(F.col("_target_case"), valid).alias("offset_valid"), mine("_reason").alias("reason"), F.col("_status").alias("status"), mine("_days").alias("offset_days"), at("_kind").alias("boundary_kind"), at("_boundary").alias("boundary_date"), at("_target").alias("target_date"),
    )


def counts(audited: DataFrame) -> DataFrame:
    """(counter, n): targets, valid and invalid offsets by reason, statuses, rules, and changed cases, from audit rows."""
    target = F.col("status").isNotNull()
    names = F.array(
        F.when(target, "target_total"), F.when(F.col("offset_valid"), "offset_valid"), F.when(target & ~F.col("offset_valid"), F.concat(F.lit("offset_invalid::"), F.col("reason"))),
        F.when(target, F.concat(F.lit("status::"), F.col("status"))), F.when(F.col("rule").isNotNull(), F.concat(F.lit("rule::"), F.col("rule"))), F.when(F.col("rule").isNotNull(), "changed_total"),
    )
    return audited.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("counter")).groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
