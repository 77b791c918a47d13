"""Registered queries that run one function each over every order: texts are made from its key, days and priority, and SQL states what the function must give.

``k`` is the order's key, which picks the case; ``d`` is its day, ``e`` a day up to 89 days later, ``pr`` its priority, ``n`` a number from 1 to 40.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..functions import timeparse as D
from ..operators import curate, programs, repair
from .shop import ORACLE, QUERIES
from .workload import table

_BASE = """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS DATE) AS e, o_orderpriority AS pr, o_orderkey % 40 + 1 AS n FROM orders),
b AS (SELECT *, CAST(d AS VARCHAR) AS dt, CAST(e AS VARCHAR) AS et, strftime(d, '%Y') AS y, lower(pr) AS lp FROM o)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_orderkey").alias("k"), day.alias("d"), F.date_add(day, (F.col("o_orderkey") % 90).cast("int")).alias("e"), F.col("o_orderpriority").alias("pr"), (F.col("o_orderkey") % 40 + 1).alias("n"))


def _inputs() -> SimpleNamespace:
    """Columns of ``cases``, texts of them, and a word for a number from 1 to 10."""
    k, d, e, pr, n = (F.col(c) for c in ("k", "d", "e", "pr", "n"))
    i = (F.floor(k / 6) % 10).cast("int")
    return SimpleNamespace(
        k=k, d=d, e=e, pr=pr, n=n, dt=d.cast("string"), et=e.cast("string"), nt=n.cast("string"), y=F.date_format(d, "yyyy"), m=F.date_format(d, "yyyy-MM"), ye=F.date_format(e, "yyyy"),
        i=(i + 1).cast("string"), word=F.element_at(F.array(*map(F.lit, X.ORDINALS)), i + 1),
    )


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def pick(*choices: Column | str | None | list) -> Column:
    """The choice whose place is k modulo their number; lists are arrays of texts."""
    plain = lambda c: c if isinstance(c, Column) else F.array(*map(plain, c)).cast("array<string>") if isinstance(c, list) else F.lit(c)
    out = None
    for i, c in enumerate(choices[:-1]):
        hit = F.col("k") % len(choices) == i
        out = F.when(hit, plain(c)) if out is None else out.when(hit, plain(c))
    return out.otherwise(plain(choices[-1]))


def strings(*xs: Column | str) -> Column:
    return F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs))


def sql_pick(*choices: str) -> str:
    return f"CASE k % {len(choices)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices)) + " END"


def rule(name: str, make: Callable[[SimpleNamespace], Column | Sequence[Column]], **sql: str) -> None:
    """Register ``name``: the columns that ``make`` gives, with the SQL of each in the same order. Arrays come out as text, so that both engines write them alike."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        made = make(_inputs())
        columns = [made] if isinstance(made, Column) else made
        got = cases(spark, sf).select("k", *(c.alias(x) for c, x in zip(columns, sql, strict=True)))
        return got.select(*(F.array_join(f.name, ";", "NULL").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in got.schema))

    QUERIES[name] = run
    ORACLE[name] = f"{_BASE} SELECT k, " + ", ".join(f"{text} AS {x}" for x, text in sql.items()) + " FROM b"


def _fields(struct: Column, *names: str) -> list[Column]:
    return [struct[n] for n in names]


# Times

_MONTH, _YEAR = "CAST(date_trunc('month', d) AS DATE)", "CAST(date_trunc('year', d) AS DATE)"
rule("rule_explicit_interval", lambda c: _fields(D.explicit_interval(c.m, pick(c.ye, c.et, "soon")), "start", "end"), first=f"CASE WHEN k % 3 < 2 THEN {_MONTH} END", last=sql_pick("make_date(year(e), 12, 31)", "e", "NULL"))
rule("rule_coarsen", lambda c: D.coarsen(c.d, c.e, pick("day", "month", "year", None)), first=sql_pick("d", _MONTH, _YEAR, "d"), last=sql_pick("e", "last_day(e)", "make_date(year(e), 12, 31)", "e"))


def _dates(c: SimpleNamespace) -> list[Column]:
    x = pick(c.y, text(c.y, "-", F.month(c.d).cast("string")), c.dt, "soon", "", None)
    return [D.flexible_date(x), D.iso_date(x)]


rule("rule_dates", _dates, flexible=sql_pick(_YEAR, _MONTH, "d", "NULL", "NULL", "NULL"), iso="CASE WHEN k % 6 = 2 THEN d END")
rule("rule_sort_date", lambda c: D.sort_date(pick(c.dt, c.m, c.y, "soon", None)), day=sql_pick("d", _MONTH, _YEAR, "DATE '9999-12-31'", "DATE '9999-12-31'"))
rule(
    "rule_interval_text", lambda c: [D.interval_text(c.dt, c.et), D.duration_text(c.d, c.e), *_fields(D.event_time(c.d, c.e), "raw", "granularity", "is_interval")],
    text="dt || ' to ' || et", duration="CAST(e - d AS VARCHAR) || ' days'", raw="dt || ' to ' || et", granularity="CASE WHEN d = e THEN 'day' END", is_interval="d <> e",
)
rule("rule_edge_time", lambda c: _fields(D.edge_time(pick(c.dt, "soon", None, "soon"), pick(c.dt, c.dt, c.dt, "x"), c.et), "start", "end"), first="CASE WHEN k % 4 < 3 THEN d END", last=sql_pick("d", "e", "e", "NULL"))
rule(
    "rule_answer_timestamps", lambda c: D.answer_timestamps(pick(c.dt, text(c.dt, "-", c.et), text(" ", c.pr, "  Zz"), "", None)),
    forms=sql_pick("dt || '-' || dt", "CASE WHEN d = e THEN dt || '-' || dt ELSE dt || '-' || et || ';' || dt || '-' || dt || ';' || et || '-' || et END", "lp || ' zz'", "''", "''"),
)
rule("rule_gold_answer", lambda c: D.gold_answer(pick(c.y, text(c.nt, " days"), text("-", c.nt), c.dt, text(c.dt, " to ", c.et), text(" ", c.pr, "  Ｆull "), None)), gold=sql_pick("NULL", "NULL", "'-' || n", "dt || '-' || dt", "dt || '-' || et", "lp || ' full'", "NULL"))
rule("rule_dates_in", lambda c: D.dates_in(pick(text("from ", c.dt, " to ", c.ye), "none", text(c.y, ", ", c.et))), found=sql_pick("dt || ';' || strftime(e, '%Y')", "''", "y || ';' || et"))

# Texts


def _texts(c: SimpleNamespace) -> list[Column]:
    x = pick(text(" [", c.pr, "] {b}  "), text(c.pr, "  Ａ Straße"), text(c.pr, "\tB"))
    return [X.slot_text(x), X.folded_text(x), X.squeezed_text(x)]


rule(
    "rule_texts", _texts, slot=sql_pick("lp || ' b'", "lp || '  ａ straße'", "lp || chr(9) || 'b'"), folded=sql_pick("'[' || lp || '] {b}'", "lp || ' a strasse'", "lp || ' b'"),
    squeezed="replace(" + sql_pick("'[' || lp || ']{b}'", "lp || 'ａstraße'", "lp || 'b'") + ", ' ', '')",
)


def _items(c: SimpleNamespace) -> list[Column]:
    x = pick(text(c.nt, ".5"), "equals", " equals ", None)
    return [X.as_list(x), X.to_number(x), X.answer_item(x)]


rule("rule_lists_and_numbers", _items, items=sql_pick("n || '.5'", "'equals'", "' equals '", "''"), number="CASE WHEN k % 4 = 0 THEN n + CAST(0.5 AS DOUBLE) END", item=sql_pick("n || '.5'", "'equal'", "'equal'", "NULL"))
rule("rule_ordinal", lambda c: X.ordinal(pick(c.word, text(c.i, "th"), c.i, text("x", c.nt), "", None)), number="CASE WHEN k % 6 < 3 THEN CAST(k // 6 % 10 + 1 AS INTEGER) END")
rule(
    "rule_offset", lambda c: _fields(X.offset_in(pick(text("What happened ", c.nt, " days after ", c.pr, "?"), text(c.nt, " Days Before ", c.pr, ", who?"), text("days after ", c.pr), text(c.nt, " days later"))), "days", "relation"),
    days="CASE WHEN k % 4 < 2 THEN CAST(n AS INTEGER) END", relation=sql_pick("'after'", "'before'", "NULL", "NULL"),
)
rule("rule_clauses", lambda c: X.clauses(pick(text("After ", c.pr, ", who b?"), text("Who ", c.pr, "?"), text("a", c.nt, ", b, c"))), sides=sql_pick("'After ' || pr || ';who b?'", "'Who ' || pr || '?;Who ' || pr || '?'", "'a' || n || ';b, c'"))
rule(
    "rule_boundary_cue", lambda c: P.boundary_cue(pick(text("when did ", c.pr, " start"), text("when did ", c.pr, " end"), text("did ", c.pr, " start or end"), text("who was ", c.pr), text("the starter finished ", c.pr))),
    cue=sql_pick("'start'", "'end'", "NULL", "NULL", "'end'"),
)


def _forms(c: SimpleNamespace) -> list[Column]:
    x = pick(c.y, c.nt, c.dt, text(c.dt, "  to ", c.et), text(c.nt, " days"), "Equal")
    return [*(X.answer_form(x, f) for f in X.ANSWER_FORMS), X.is_temporal(x)]


_FORM = {"is_year": "(0)", "is_date": "(2)", "is_interval": "(3)", "is_duration": "(4)", "is_integer": "(0, 1)", "is_comparison": "(5)"}
rule("rule_answer_forms", _forms, **{f: f"k % 6 IN {_FORM[f]}" for f in X.ANSWER_FORMS}, is_temporal="k % 6 IN (0, 2, 3, 4)")
rule("rule_no_answer", lambda c: [X.no_answer(x := pick(None, "", " N/A ", "None", "no answer", c.pr)), X.no_answer(x, True)], plain="k % 6 < 5", compat="k % 6 < 4")
rule("rule_unknown_slot", lambda c: X.unknown_slot(pick("?", c.pr, c.pr, None), pick(c.pr, "?", c.pr, c.pr)), slot=sql_pick("'head'", "'tail'", "NULL", "'head'"))

# Curation

rule(
    "rule_compare_subtype", lambda c: programs.compare_subtype(pick(text("Which one is the ", c.word, " longest among ", c.pr, ", b?"), text("Which one lasted the longest: ", c.pr, " or b?"), text("Is the duration of ", c.pr, " longer than b?"), text("How long is ", c.pr, "?"))),
    subtype=sql_pick("'which_one_ranked_longest_shortest'", "'which_one_longest_shortest'", "'binary_longer_shorter_equal'", "'unsupported_duration_compare'"),
)
rule(
    "rule_compare_answers", lambda c: programs.compare_answers(pick([c.pr, c.dt], [c.pr, c.dt], [c.pr], [c.pr, c.dt], [c.pr, c.dt], []), pick([], [c.dt, c.pr], [c.pr, c.dt], [c.dt], [c.dt, "z"], [c.pr])),
    status=sql_pick("'NO_REPAIRED_ANSWER'", "'ORIGINAL_EXACT'", "'ORIGINAL_SUBSET_OF_REPAIRED'", "'REPAIRED_SUBSET_OF_ORIGINAL'", "'DIFFERENT'", "'DIFFERENT'"),
)
rule(
    "rule_retention",
    lambda c: _fields(programs.retention(pick("ORIGINAL_EXACT", "ORIGINAL_SUBSET_OF_REPAIRED", "REPAIRED_SUBSET_OF_ORIGINAL", "DIFFERENT", "EXCEPTION"), F.transform(F.sequence(F.lit(1).cast("long"), c.n), lambda i: i.cast("string")), 20), "keep", "reason"),
    keep=sql_pick("true", "n <= 20", "true", "false", "false"),
    reason=sql_pick("'ORIGINAL_EXACT'", "CASE WHEN n <= 20 THEN 'ORIGINAL_SUBSET_OF_REPAIRED_SIZE_LE_20' ELSE 'SUBSET_BUT_SEMANTIC_GOLD_TOO_LARGE:' || n || '>20' END", "'REPAIRED_SUBSET_OF_ORIGINAL_ACCEPTED'", "'REPAIR_STATUS_NOT_ACCEPTED:DIFFERENT'", "'REPAIR_STATUS_NOT_ACCEPTED:EXCEPTION'"),
)
rule("rule_small_answers", lambda c: curate.small_answers(F.array_repeat(c.pr, (c.k % 23).cast("int"))), small="k % 23 <= 10")
rule("rule_mentioned", lambda c: curate.mentioned(pick(c.pr, F.translate(c.pr, "-", "–"), text("absent ", c.nt), None), text("Did ", F.lower(c.pr), "  win?")), found="k % 4 < 2")
rule("rule_mentioned_events", lambda c: curate.mentioned_events(strings(text(c.pr, "|r|qqq|1|2"), "zzz|r|yyy|1|2", "broken"), pick(text("who is ", c.pr, "?"), "nothing")), kept=sql_pick("pr || '|r|qqq|1|2;broken'", "'broken'"))
rule("rule_all_points", lambda c: curate.all_points(pick([text(c.pr, "|r|b|", c.dt, "|", c.dt)], [text(c.pr, "|r|b|", c.dt, "|", c.et)], ["broken"])), points="k % 3 = 0 OR k % 3 = 1 AND d = e")
rule(
    "rule_answer_change",
    lambda c: curate.answer_change_error(pick("timestamp", "timestamp", "timestamp", "subject", "subject", "duration"), pick([c.y], [c.y], [c.y], [c.pr], [c.pr], ["longer"]), pick([c.dt], ["soon"], [c.y, c.dt], ["Bob"], [c.pr], [text(c.nt, " days")])),
    error=sql_pick("NULL", "'answer_not_temporal'", "'answer_count_changed'", "'answer_must_not_change'", "NULL", "'answer_must_not_change'"),
)
rule("rule_normalize_durations", lambda c: curate.normalize_durations(strings(text(c.dt, " to ", c.et), c.pr)), days="CAST(e - d AS VARCHAR) || ' days;' || pr")
rule("rule_question_mark", lambda c: curate.ensure_question_mark(pick(text("Who  is ", c.pr), text("Who is ", c.pr, "?"), text("Who is ", c.pr, "."), text(" Who is ", c.pr, "! "))), asked="'Who is ' || pr || '?'")

# Orders

rule(
    "rule_sorted_events", lambda c: curate.sorted_events(strings("x|r|y|soon|z", text("b|r|c|", pick(c.et, c.dt), "|2"), text("a|r|c|", pick(c.dt, c.et), "|2"))),
    ordered="CASE WHEN k % 2 = 0 OR d = e THEN 'a|r|c|' || dt || '|2;b|r|c|' || et || '|2' ELSE 'b|r|c|' || dt || '|2;a|r|c|' || et || '|2' END || ';x|r|y|soon|z'",
)
rule("rule_answers_by_event", lambda c: curate.answers_by_event_order(pick(["zc", c.pr], ["zc", "none"]), strings(text(c.pr, "|r|b|1|2"), "zc|r|d|3|4")), ordered=sql_pick("pr || ';zc'", "'zc;none'"))
rule("rule_answers_by_start", lambda c: curate.answers_by_start(strings("z", "a", "c"), strings(text("a|r|b|", c.et, "|2"), text("c|r|d|", c.dt, "|2"))), ordered="CASE WHEN d = e THEN 'a;c;z' ELSE 'c;a;z' END")
rule("rule_evidence_order", lambda c: curate.evidence_order(c.pr, strings("a", "b"), strings("s", "a", "s"), pick(None, "union")), ordered=sql_pick("pr || ';a;b;s'", "'s;a'"))
rule(
    "rule_question_order",
    lambda c: F.transform(programs.question_order(pick(text("Did ", c.pr, " come before Ann?"), text("Did Ann come before ", c.pr, "?")), programs.parse_events(strings("Ann|r|xxx|2000-01-01|2000-01-01", text(c.pr, "|r|yyy|2001-01-01|2001-01-01"), "Cid|r|zzz|2002-01-01|2002-01-01"))), lambda i: i.cast("string")),
    ordered=sql_pick("'1;0;2'", "'0;1;2'"),
)

# Relation texts

#: A relation text for each remainder of the key: its kind of question, operator, relations of its constraints, and unsupported units.
RELATIONS = (
    ("timeline", "timeline_structure", "timeline", "", 0), ("union", "temporal_operation", "union", "", 0), ("duration_before", "relative_temporal", None, "before", 0), ("X di Y", "interval_relation", None, "contains", 0),
    ("duration_{n} days after", "quantitative_temporal", None, "after", 0), ("X < Y & X > Y", "temporal_order", None, "before,after", 0), ("X zz Y", "unknown", None, "", 1), ("duration_finishes", "unknown", None, "finishes", 0),
    (" X o Y & average ", "interval_relation", "average", "overlaps", 0), ("", "unknown", None, "", 0), ("nonsense & X m Y", "unknown", None, "meets", 1),
)


def _relation(c: SimpleNamespace) -> Column:
    return F.replace(pick(*(r for r, *_ in RELATIONS)), F.lit("{n}"), c.nt)


def _parsed(c: SimpleNamespace) -> list[Column]:
    p = programs.parse_relation(_relation(c))
    return [p["operator"], F.array_join(F.transform(p["constraints"], lambda x: x["relation"]), ","), F.get(p["constraints"], F.lit(0))["offset_days"], F.size(p["unsupported"])]


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


rule("qtype_classify", lambda c: programs.question_type(_relation(c)), qtype=sql_pick(*(_quoted(r[1]) for r in RELATIONS)))
rule(
    "relation_parse", _parsed, operator=sql_pick(*(_quoted(r[2]) for r in RELATIONS)), relations=sql_pick(*(_quoted(r[3]) for r in RELATIONS)),
    days=sql_pick(*("CAST(n AS INTEGER)" if "{n}" in r[0] else "NULL" for r in RELATIONS)), unsupported=f"CAST({sql_pick(*(str(r[4]) for r in RELATIONS))} AS INTEGER)",
)

# Programs: each order is a case of three events, of which some make its status, and an operator that is answered from the given events

_ASKS = (
    ("", "NO_PROGRAM", ""), ("X zz Y", "UNSUPPORTED_TEMPORAL_RELATION", ""), ("duration_after", "OFFSET_NOT_FOUND", "What came after Gamma?"), ("X < Y & X > Y", "ANCHOR_LINK_FAILED", "What came before Alpha?"), ("X < Y", "QUERY_INFER_FAILED", "What came before Alpha?"),
    ("X < Y & X > Y", "OK", "What came before Alpha and after Beta?"), ("timeline", "OK", ""), ("X < Y", "NO_EVENTS", "What came before Alpha?"), ("duration_before", "OK_WITH_HIDDEN_ANCHOR", "{n} days before it began, what did Alpha do?"),
)


def _three_events(c: SimpleNamespace) -> Column:
    """Alpha for a while from d, Beta and Gamma from later days: lengths of k % 90, k % 7 and k % 3 days."""
    event = lambda name, start, days: F.struct(F.lit(name).alias("head"), F.lit("did").alias("relation"), text("task ", c.nt).alias("tail"), start.alias("start"), F.date_add(start, days.cast("int")).alias("end"))
    return F.array(event("Alpha", c.d, c.k % 90), event("Beta", F.date_add(c.d, (c.k % 5).cast("int")), c.k % 7), event("Gamma", F.date_add(c.d, (c.k % 4 + 1).cast("int")), c.k % 3))


def program_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """The status of every case: which program it is, whether its anchors are named and one event is left to be asked for."""
    c = _inputs()
    at = c.k % len(_ASKS)
    events = _three_events(c)
    given = F.when(at == 7, F.slice(events, 1, 0)).when(at == 8, F.slice(events, 1, 2)).otherwise(events)
    rows = cases(spark, sf).select(c.k.alias("id"), F.replace(pick(*(q for *_, q in _ASKS)), F.lit("{n}"), c.nt).alias("question"), pick(*(r for r, *_ in _ASKS)).alias("temporal_relation"), F.lit("object").alias("answer_type"), given.alias("event_list"))
    return programs.compile_cases(rows).select("id", "status")


QUERIES["program_statuses"] = program_statuses
ORACLE["program_statuses"] = f"{_BASE} SELECT k AS id, {sql_pick(*(_quoted(x[1]) for x in _ASKS))} AS status FROM b"

#: Operator, question and tie mode of ``program_event_operators``, by the remainder of the key.
_OPERATORS = (
    ("rank_start_time", "Which rank has the event in which Beta did among these?"), ("rank_end_time", "Which rank has the event in which Beta did among these?"), ("duration_compare", "Is the duration of Alpha longer than Beta?"),
    ("duration_compare", "Which one lasted the longest: Alpha, Beta or Gamma?"), ("duration_compare", "Which one is the second shortest among Alpha, Beta, Gamma?"), ("duration", ""), ("intersection", ""), ("sum", ""), ("average", ""), ("union", ""),
)


def program_event_operators(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of every operator from the given events, with each tie mode: all, the first, or none."""
    c = _inputs()
    rows = cases(spark, sf).select(c.k.alias("id"), pick(*(o for o, _ in _OPERATORS)).alias("o"), pick(*(q for _, q in _OPERATORS)).alias("q"), _three_events(c).alias("e"))
    answers = {ties: F.array_join(programs.answer_from_events(F.col("o"), F.col("e"), F.col("q"), ties), ";") for ties in ("all", "first", "exception")}
    return rows.select("id", *(a.alias(f"ties_{ties}") for ties, a in answers.items()))


QUERIES["program_event_operators"] = program_event_operators
_LONGEST = "CASE WHEN {0} >= {1} AND {0} >= {2} THEN {3} END"
_TIED = "concat_ws(';', " + ", ".join(_LONGEST.format(*x) for x in (("la", "lb", "lg", "'1'"), ("lb", "la", "lg", "'2'"), ("lg", "la", "lb", "'3'"))) + ")"
_DAY_SPAN = "CAST({} AS VARCHAR) || ' to ' || CAST({} AS VARCHAR)"


def _operator_sql(longest: str) -> str:
    return sql_pick(
        "CAST(1 + CAST(sa <= sb AS INTEGER) + CAST(sg < sb AS INTEGER) AS VARCHAR)", "CAST(1 + CAST(ea <= eb AS INTEGER) + CAST(eg < eb AS INTEGER) AS VARCHAR)",
        "CASE WHEN la > lb THEN 'longer' WHEN la < lb THEN 'shorter' ELSE 'equals' END", longest, "CAST(list_sort([(la, 1), (lb, 2), (lg, 3)])[2][2] AS VARCHAR)",
        "array_to_string(list_transform(list_filter([(la, 1), (lb, 2), (lg, 3)], lambda x: NOT (x[2] = 2 AND lb = la) AND NOT (x[2] = 3 AND (lg = la OR lg = lb))), lambda x: CAST(x[1] AS VARCHAR) || ' days'), ';')",
        f"CASE WHEN greatest(sa, sb, sg) <= least(ea, eb, eg) THEN {_DAY_SPAN.format('greatest(sa, sb, sg)', 'least(ea, eb, eg)')} ELSE '' END", "CAST(la + lb + lg AS VARCHAR) || ' days'", "CAST((la + lb + lg) // 3 AS VARCHAR) || ' days'", "islands",
    )


ORACLE["program_event_operators"] = f"""{_BASE},
t AS (SELECT k, CAST(k % 90 AS INTEGER) AS la, CAST(k % 7 AS INTEGER) AS lb, CAST(k % 3 AS INTEGER) AS lg, d AS sa, CAST(d + CAST(k % 5 AS INTEGER) AS DATE) AS sb, CAST(d + CAST(k % 4 + 1 AS INTEGER) AS DATE) AS sg FROM b),
v AS (SELECT *, CAST(sa + la AS DATE) AS ea, CAST(sb + lb AS DATE) AS eb, CAST(sg + lg AS DATE) AS eg FROM t),
x AS (SELECT k, unnest([{{'s': sa, 'e': ea}}, {{'s': sb, 'e': eb}}, {{'s': sg, 'e': eg}}], recursive := true) FROM v),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM x), n AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m),
u AS (SELECT k, string_agg({_DAY_SPAN.format('s', 'e')}, ';' ORDER BY s) AS islands FROM (SELECT k, i, min(s) AS s, max(e) AS e FROM n GROUP BY k, i) GROUP BY k), w AS (SELECT v.*, islands, {_TIED} AS tied FROM v JOIN u USING (k))
SELECT k AS id, {_operator_sql('tied')} AS ties_all, {_operator_sql('tied[1:1]')} AS ties_first, {_operator_sql("CASE WHEN length(tied) = 1 THEN tied ELSE '' END")} AS ties_exception FROM w"""

# Question repair: each order is a case; its offset of n days, moved by k % 7 - 2, falls into the event asked for or not

_CASES = f"""{_BASE},
q AS (SELECT *, k % 8 AS v, CAST(n AS INTEGER) AS days, CAST(k % 7 - 2 AS INTEGER) AS off, 'buyer ' || n AS s, 'A' || k % 5 || ' met B' AS anchored FROM b),
c AS (
  SELECT *, 'buyer ' || n || ' ordered ' || pr AS asked, off >= 0 AND off <= e - d AS valid, v IN (1, 3) AS is_before, v IN (2, 3, 7) AS of_subject, CAST(d + CASE WHEN v IN (1, 3) THEN days ELSE -days END + off AS DATE) AS edge,
    CASE v WHEN 0 THEN days || ' days ' || s || ' ordered ' || pr || ', in which organisation, ' || s || ' ordered?' WHEN 1 THEN ' ' || days || ' days  ' || anchored || ', in which organisation, x?' WHEN 2 THEN 'Who ordered ' || pr || ' ' || days || ' days ' || anchored || ' ?'
      WHEN 3 THEN 'Who ordered ' || pr || ' ' || days || ' days before ' || anchored || '?' WHEN 4 THEN 'Who ' || s || ' ' || pr || ', when?' WHEN 5 THEN days || ' days ' || s || '?' WHEN 6 THEN 'Who?' ELSE 'Who ordered ' || pr || ' ' || days || ' days nobody?' END AS question
  FROM q
)"""


def repair_cases(spark: SparkSession, sf: str) -> DataFrame:
    c = _inputs()
    v, days, off = c.k % 8, c.n.cast("int"), (c.k % 7 - 2).cast("int")
    s, anchored = text("buyer ", c.nt), text("A", (c.k % 5).cast("string"), " met B")
    ordered = text("Who ordered ", c.pr, " ", c.nt, " days ")
    question = pick(
        text(c.nt, " days ", s, " ordered ", c.pr, ", in which organisation, ", s, " ordered?"), text(" ", c.nt, " days  ", anchored, ", in which organisation, x?"), text(ordered, anchored, " ?"), text(ordered, "before ", anchored, "?"),
        text("Who ", s, " ", c.pr, ", when?"), text(c.nt, " days ", s, "?"), "Who?", text(ordered, "nobody?"),
    )
    edge = F.date_add(c.d, F.when(v.isin(1, 3), days).otherwise(-days) + off)
    wide = c.k % 3 == 0
    first, last = F.when(wide & ~v.isin(1, 3), F.date_sub(edge, 3)).otherwise(edge), F.when(wide & v.isin(1, 3), F.date_add(edge, 3)).otherwise(edge)
    asked = text(s, "|ordered|", c.pr, "|", F.when(v == 5, "soon").otherwise(c.dt), "|", c.et)
    anchor = text("A", (c.k % 5).cast("string"), "|met|B|", first.cast("string"), "|", last.cast("string"))
    medium, complex_ = repair.OFFSET_KIND, repair.PREFIX_KIND
    return cases(spark, sf).select(
        c.k.alias("id"), question.alias("question"), pick("medium", "medium", "medium", "medium", "complex", "medium", "simple", "medium").alias("question_level"), pick(medium, medium, medium, medium, complex_, medium, medium, medium).alias("question_type"),
        pick("object", "object", "subject", "subject", "subject", "object", "object", "subject").alias("answer_type"), pick(*["duration_after", "duration_before"] * 2, *["duration_after"] * 4).alias("temporal_relation"), F.array(asked, anchor).alias("events"),
    )


QUERIES["question_repair"] = lambda spark, sf: repair.repaired(repair_cases(spark, sf)).select("id", "question")
_NEW = """CASE WHEN v = 0 AND valid THEN days || ' days after ' || anchored || ', in which organisation, ' || s || ' ordered?' WHEN v = 1 AND valid THEN ' ' || days || ' days  before ' || anchored || ', in which organisation, x?'
  WHEN v = 2 AND valid THEN 'Who ordered ' || pr || ' ' || days || ' days after ' || anchored || '?' WHEN v = 4 THEN 'Who ordered ' || pr || ', when?' ELSE question END"""
ORACLE["question_repair"] = f"{_CASES} SELECT k AS id, {_NEW} AS question FROM c"
QUERIES["question_repair_audit"] = lambda spark, sf: repair.audit(repair_cases(spark, sf)).drop("question_level", "question_type", "answer_type", "temporal_relation")
ORACLE["question_repair_audit"] = f"""{_CASES},
a AS (SELECT *, CASE WHEN v = 5 THEN 'bad_query_date' WHEN valid THEN 'ok' ELSE 'target_not_in_query_interval' END AS reason, {_NEW} AS new_question FROM c WHERE v <> 6),
t AS (
  SELECT *, CASE WHEN v = 4 THEN NULL WHEN reason <> 'ok' THEN 'offset_invalid' WHEN v = 3 THEN 'already_has_connector' WHEN v = 7 THEN 'subject_anchor_clause_not_anchor_event' ELSE 'repaired' END AS status FROM a
)
SELECT k AS id, question AS old_question, new_question, CASE WHEN v = 4 THEN 'C1_complex_subject_prefix_relation' WHEN status = 'repaired' THEN CASE v WHEN 0 THEN 'M1A_medium_object_duration_after_swap_anchor_and_add_after' WHEN 1 THEN 'M1B_medium_object_duration_before_add_before' ELSE 'M2_medium_subject_duration_after_add_after' END END AS rule,
  CASE WHEN v = 4 OR status = 'repaired' THEN NULL WHEN reason <> 'ok' THEN 'offset_invalid_skip_repair:' || reason ELSE 'offset_valid_but_not_repaired:' || status END AS note,
  CASE WHEN v <> 4 THEN reason = 'ok' END AS offset_valid, CASE WHEN v <> 4 THEN reason END AS reason, status, CASE WHEN v <> 4 THEN days END AS offset_days,
  CASE WHEN v NOT IN (4, 5) THEN CASE WHEN k % 3 <> 0 THEN 'anchor_point' WHEN is_before THEN 'anchor_start' ELSE 'anchor_end' END END AS boundary_kind, CASE WHEN v NOT IN (4, 5) THEN edge END AS boundary_date, CASE WHEN v NOT IN (4, 5) THEN CAST(d + off AS DATE) END AS target_date
FROM t"""
QUERIES["question_repair_counts"] = lambda spark, sf: repair.counts(repair.audit(repair_cases(spark, sf)))
ORACLE["question_repair_counts"] = f"""{_CASES},
t AS (SELECT *, CASE WHEN v = 4 THEN NULL WHEN v = 5 OR NOT valid THEN 'offset_invalid' WHEN v = 3 THEN 'already_has_connector' WHEN v = 7 THEN 'subject_anchor_clause_not_anchor_event' ELSE 'repaired' END AS status FROM c WHERE v <> 6),
r AS (SELECT *, CASE WHEN v = 4 THEN 'C1_complex_subject_prefix_relation' WHEN status = 'repaired' THEN CASE v WHEN 0 THEN 'M1A_medium_object_duration_after_swap_anchor_and_add_after' WHEN 1 THEN 'M1B_medium_object_duration_before_add_before' ELSE 'M2_medium_subject_duration_after_add_after' END END AS rule FROM t),
n AS (SELECT unnest([CASE WHEN v <> 4 THEN 'target_total' END, CASE WHEN status <> 'offset_invalid' THEN 'offset_valid' END, CASE WHEN status = 'offset_invalid' THEN 'offset_invalid::' || CASE WHEN v = 5 THEN 'bad_query_date' ELSE 'target_not_in_query_interval' END END,
  'status::' || status, 'rule::' || rule, CASE WHEN rule IS NOT NULL THEN 'changed_total' END]) AS counter FROM r)
SELECT counter, count(*) AS n FROM n WHERE counter IS NOT NULL GROUP BY counter"""

__all__ = ["ORACLE", "QUERIES"]
