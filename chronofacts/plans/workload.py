"""The registered queries over the driver's tables, and the SQL that states the same results.

Facts are derived from the tables: orders are point facts, supplies are interval facts, events are point facts with short names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..functions import timeparse as D
from ..operators import answering, constraints, curate, evaluate, intervals, match, programs, rag, rank_scan, segments, similarity
from ..sources import facts as S
from ..streaming import facts as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FACTS = """
SELECT c_name AS head, 'placed order' AS relation, o_orderpriority AS tail, CAST(o_orderdate AS DATE) AS "start", CAST(o_orderdate AS DATE) AS "end"
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT s_name, 'supplied', p_name, CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_name, l_partkey, p_name
UNION ALL
SELECT concat('user_', CAST(user_id AS VARCHAR)), event_type, concat('k', regexp_extract(props, '([0-9]+)', 1)), CAST(ts AS DATE), CAST(ts AS DATE) FROM events
"""
WITH = f"WITH facts AS ({FACTS})"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` states its result, with ``facts`` as the fact view where it starts with a comma or SELECT."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            ORACLE[name] = f"{WITH} {text}" if text.startswith((",", "SELECT")) and "facts" in text else text
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    day = F.col("o_orderdate").cast("date")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_name").alias("head"), F.lit("placed order").alias("relation"), F.col("o_orderpriority").alias("tail"), day.alias("start"), day.alias("end"))


def supplies(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregated by keys before the names are joined, so the large table is shuffled in partial aggregates only."""
    spans = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").cast("date").alias("start"), F.max("l_shipdate").cast("date").alias("end"))
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    return spans.join(s, spans["l_suppkey"] == s["s_suppkey"]).join(p, spans["l_partkey"] == p["p_partkey"]).select(F.col("s_name").alias("head"), F.lit("supplied").alias("relation"), F.col("p_name").alias("tail"), "start", "end")


def event_facts(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("ts").cast("date")
    return table(spark, sf, "events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("head"), F.col("event_type").alias("relation"), F.concat(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1)).alias("tail"), day.alias("start"), day.alias("end"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).unionByName(supplies(spark, sf)).unionByName(event_facts(spark, sf))


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", D.make_timestamp(F.col("start").cast("string"), F.col("end").cast("string")))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


_SUPPLY = "relation = 'supplied'"
_STAMP = "CASE WHEN \"start\" = \"end\" THEN CAST(\"start\" AS VARCHAR) ELSE concat(CAST(\"start\" AS VARCHAR), '-', CAST(\"end\" AS VARCHAR)) END"

# Flagship and sources


@query("flagship_overlap", """
, s AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY "start", "end", tail) AS n FROM facts WHERE relation = 'supplied'),
a AS (SELECT head, "start", "end" FROM s WHERE n = 1),
m AS (SELECT s.head, s.tail, s."start", s."end" FROM s JOIN a ON s.head = a.head WHERE s."start" <= a."end" AND s."end" >= a."start"),
d AS (SELECT DISTINCT * FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY "start", "end", tail) AS evidence_rank FROM d)
SELECT head, tail, CAST("start" AS VARCHAR) AS start_day, CAST("end" AS VARCHAR) AS end_day, evidence_rank,
  concat('[', head, ', supplied, ', tail, CASE WHEN "start" = "end" THEN concat('] on ', CAST("start" AS VARCHAR)) ELSE concat('] from ', CAST("start" AS VARCHAR), ' to ', CAST("end" AS VARCHAR)) END) AS fact
FROM r WHERE evidence_rank <= 20""")
def flagship_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Which parts did each supplier ship while its first supply interval was open, earliest first, as evidence text?"""
    s = supplies(spark, sf)
    first = Window.partitionBy("head").orderBy("start", "end", "tail")
    anchor = s.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("head").alias("qid"), "start", "end")
    kept = constraints.semi_join(s.withColumn("qid", F.col("head")), anchor, "overlap").drop("qid").distinct()
    ranked = kept.withColumn("evidence_rank", F.row_number().over(first).cast("long")).where("evidence_rank <= 20")
    day = lambda c: F.col(c).cast("string")
    text = rag.fact_text(F.col("head"), F.lit("supplied"), F.col("tail"), D.make_timestamp(day("start"), day("end")))
    fixed = F.when(F.col("start") == F.col("end"), F.regexp_replace(text, r"(\d{4}-\d{2}-\d{2})$", "$1")).otherwise(text)
    return ranked.select("head", "tail", day("start").alias("start_day"), day("end").alias("end_day"), "evidence_rank", fixed.alias("fact"))


@query("fact_view", f"""SELECT head, relation, tail, "start", "end", {_STAMP} AS timestamp, row_number() OVER (PARTITION BY head, relation, tail, "start", "end") - 1 AS occurrence FROM facts""")
def fact_view(spark: SparkSession, sf: str) -> DataFrame:
    return longs(S.occurrences(stamped(facts(spark, sf)), "timestamp"), "occurrence")


_LINE = """concat_ws(chr(9), replace(head, ' ', '_'), replace(relation, ' ', '_'), replace(tail, ' ', '_'), CAST("start" AS VARCHAR), CASE WHEN "start" <> "end" THEN CAST("end" AS VARCHAR) END)"""


@query("fact_lines", """SELECT replace(head, '_', ' ') AS head, replace(relation, '_', ' ') AS relation, replace(tail, '_', ' ') AS tail, CAST("start" AS VARCHAR) AS start_text, CAST("end" AS VARCHAR) AS end_text, CAST(NULL AS VARCHAR) AS parse_error FROM facts""")
def fact_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Facts written as lines of 4 or 5 parts and parsed again."""
    under = lambda c: F.translate(F.col(c), " ", "_")
    lines = facts(spark, sf).select(F.concat_ws("\t", under("head"), under("relation"), under("tail"), F.col("start").cast("string"), F.when(F.col("start") != F.col("end"), F.col("end").cast("string"))).alias("value"))
    return S.parse_facts(lines).select("head", "relation", "tail", F.col("start").alias("start_text"), F.col("end").alias("end_text"), "parse_error")


@query("vocab_ids", """, v AS (SELECT head AS name FROM facts UNION SELECT tail FROM facts) SELECT name, row_number() OVER (ORDER BY name) - 1 AS vid FROM v""")
def vocab_ids(spark: SparkSession, sf: str) -> DataFrame:
    return longs(S.entities(facts(spark, sf)).drop("node_id"), "vid")


@query("hash_ids", """, v AS (SELECT head AS name FROM facts UNION SELECT tail FROM facts) SELECT name, concat('ent_', substr(translate(to_base64(unhex(sha1(name))), '+/', '-_'), 1, 16)) AS node_id FROM v""")
def hash_ids(spark: SparkSession, sf: str) -> DataFrame:
    return S.entities(facts(spark, sf)).select("name", "node_id")


@query("graph_tables", """, r AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS relation_id FROM (SELECT DISTINCT relation FROM facts)) SELECT relation, relation_id, count(*) AS edges FROM facts JOIN r USING (relation) GROUP BY ALL""")
def graph_tables(spark: SparkSession, sf: str) -> DataFrame:
    graph = S.build_graph(stamped(facts(spark, sf)), "timestamp")
    return longs(graph["facts"].groupBy("relation", "relation_id").agg(F.count(F.lit(1)).alias("edges")), "relation_id")


# Patterns

_PATTERNS = """, p AS (SELECT DISTINCT head AS q_head, tail AS q_tail, dense_rank() OVER (ORDER BY head, tail) AS qid FROM facts WHERE relation = 'supplied')"""


def patterns(spark: SparkSession, sf: str, known: tuple[str, ...]) -> DataFrame:
    """One pattern for each distinct known part of the supplies."""
    d = supplies(spark, sf).select(*known).distinct()
    none = F.lit(None).cast("string")
    return d.select(F.concat_ws("|", *known).alias("qid"), *((F.col(s) if s in known else F.lit("supplied") if s == "relation" else none).alias(s) for s in match.SLOTS))


def _pattern_sql(known: tuple[str, ...]) -> str:
    key = f"concat_ws('|', {', '.join(known)})"
    return f"""SELECT {key} AS qid, head, relation, tail, "start", "end", '{'tail' if 'tail' not in known else 'head' if 'head' not in known else None}' AS anchor_type, CAST(3 AS DOUBLE) AS score_sum FROM facts WHERE {_SUPPLY}""".replace("'None'", "CAST(NULL AS VARCHAR)")


for _name, _known in (("pattern_exact_tail_unknown", ("head",)), ("pattern_exact_head_unknown", ("tail",)), ("pattern_exact_all_known", ("head", "tail"))):
    @query(_name, _pattern_sql(_known))
    def _pattern(spark: SparkSession, sf: str, known=_known) -> DataFrame:
        found = match.exact(patterns(spark, sf, known), facts(spark, sf))
        return found.select("qid", "head", "relation", "tail", "start", "end", "anchor_type", "score_sum")


@query("pattern_inverse_fallback", """
, q AS (SELECT DISTINCT head AS p_tail FROM facts WHERE relation = 'supplied')
SELECT p_tail AS qid, head, 'part of' AS relation, tail, "start", "end", 2 AS branch FROM facts JOIN q ON head = p_tail WHERE relation = 'supplied'""")
def pattern_inverse_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """``has part`` patterns that only the inverse relation answers."""
    renamed = supplies(spark, sf).withColumn("relation", F.lit("part of"))
    q = renamed.select(F.col("head").alias("qid"), F.lit(None).cast("string").alias("head"), F.lit("has part").alias("relation"), F.col("head").alias("tail")).distinct()
    return match.exact_with_fallback(q, renamed).select("qid", "head", "relation", "tail", "start", "end", F.col("branch").cast("int").alias("branch"))


@query("known_names", """, q AS (SELECT DISTINCT tail FROM facts WHERE relation = 'supplied'), e AS (SELECT head AS n FROM facts UNION SELECT tail FROM facts) SELECT tail AS qid FROM q WHERE tail IN (SELECT n FROM e) AND length(tail) % 2 = 0""")
def known_names(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns with a name outside the vocabulary have no result."""
    f = facts(spark, sf)
    q = patterns(spark, sf, ("tail",)).withColumn("tail", F.when(F.length("tail") % 2 == 0, F.col("tail")).otherwise(F.concat(F.lit("?!"), F.col("tail"))))
    return match.known_names(q, f).select("qid")


@query("timeline_completion", """
, s AS (SELECT DISTINCT head, relation, tail, "start", "end" FROM facts WHERE relation = 'placed order')
SELECT DISTINCT concat_ws('|', s.relation, s.tail, CAST(s."start" AS VARCHAR)) AS qid, f.head, f.relation, f.tail, f."start", f."end" FROM facts f JOIN s ON f.relation = s.relation AND f.tail = s.tail AND f."start" = s."start" AND f."end" = s."end" """)
def timeline_completion(spark: SparkSession, sf: str) -> DataFrame:
    seeds = orders(spark, sf).withColumn("answer_type", F.lit("subject")).withColumn("qid", F.concat_ws("|", "relation", "tail", F.col("start").cast("string")))
    return match.complete_timeline(seeds.dropDuplicates(["qid"]), facts(spark, sf)).drop("answer_type")


# Time predicates: supplies against any of many supplies of the same supplier (every fortieth in order of time)

_ANCHORED = """
, s AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY "start", "end", tail) AS n FROM facts WHERE relation = 'supplied'),
a AS (SELECT head, "start" AS ys, "end" AS ye FROM s WHERE n % 40 = 3)
SELECT s.head, tail, "start", "end" FROM s WHERE EXISTS (SELECT 1 FROM a WHERE a.head = s.head AND ({}))"""


def many_anchors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Supplies as candidates of their supplier, and its anchors."""
    s = supplies(spark, sf)
    numbered = segments.row_number(s, ["head"], ["start", "end", "tail"], "n")
    return s.withColumn("qid", F.col("head")), numbered.where("n % 40 = 3").select(F.col("head").alias("qid"), "start", "end")


def anchored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = supplies(spark, sf)
    order = Window.partitionBy("head").orderBy("start", "end", "tail")
    anchor = s.withColumn("n", F.row_number().over(order)).where("n = 3").select(F.col("head").alias("qid"), "start", "end")
    return s.withColumn("qid", F.col("head")), anchor


def _relation_query(name: str, relation: str, granularity: str | None, sql: str) -> None:
    @query(name, _ANCHORED.format(sql))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s, a = many_anchors(spark, sf)
        return constraints.any_match(s, a, relation, granularity).select("head", "tail", "start", "end")


_relation_query("time_before", "before", None, '"end" < ys')
_relation_query("time_after", "after", None, '"start" > ye')
_relation_query("time_inside", "inside", None, '"start" >= ys AND "end" <= ye')
_relation_query("time_overlap", "overlap", None, '"start" <= ye AND "end" >= ys')
for _g in ("day", "month", "year"):
    _relation_query(f"time_equal_{_g}", "equal", _g, f"""date_trunc('{_g}', "start") <= date_trunc('{_g}', ye) AND date_trunc('{_g}', "end") >= date_trunc('{_g}', ys)""")


@query("time_offset_any", _ANCHORED.format("""(ys + INTERVAL 30 DAY BETWEEN "start" AND "end") OR (ye + INTERVAL 30 DAY BETWEEN "start" AND "end")"""))
def time_offset_any(spark: SparkSession, sf: str) -> DataFrame:
    s, a = many_anchors(spark, sf)
    return constraints.any_match(s, a, "after", offset_days=30).select("head", "tail", "start", "end")


@query("time_offset_boundary", _ANCHORED.format("""CASE WHEN ys = ye THEN ys ELSE ye END + INTERVAL 30 DAY BETWEEN "start" AND "end" """))
def time_offset_boundary(spark: SparkSession, sf: str) -> DataFrame:
    s, a = many_anchors(spark, sf)
    return constraints.any_offset_match(s, a, "after", 30, F.lit("30 days after it")).select("head", "tail", "start", "end")


_ALLEN_SQL = {
    "before": "xe < ys", "after": "xs > ye", "equal": "xs = ys AND xe = ye", "during": "xs >= ys AND xe <= ye", "contains": "xs <= ys AND xe >= ye", "overlaps": "xs < ys AND ys <= xe AND xe < ye",
    "overlapped_by": "ys < xs AND xs <= ye AND ye < xe", "starts": "xs = ys AND xe <= ye", "started_by": "xs = ys AND xe >= ye", "finishes": "xs >= ys AND xe = ye", "finished_by": "xs <= ys AND xe = ye", "meets": "xe = ys", "metby": "xs = ye",
}


def numbered_supplies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Supplies (_head, _tail, start, end) with a number for each name, its smallest key, and the heads' names (_head, head). Long names would be most of what is exchanged.

    The part is joined before the lines are grouped, so that one exchange by part does for both.
    """
    def numbers(name: str, key: str, called: str, number: str) -> tuple[DataFrame, DataFrame]:
        rows = table(spark, sf, name).select(key, called)
        first = rows.where(F.col(called).isNotNull()).groupBy(called).agg(F.min(key).alias(number))
        return S.stored_table(rows.join(first, called, "left").select(key, number)), first

    heads, names = numbers("supplier", "s_suppkey", "s_name", "_head")
    tails, _ = numbers("part", "p_partkey", "p_name", "_tail")
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", F.col("l_shipdate").alias("at"))
    lines = lines.join(heads.where("_head IS NOT NULL"), F.col("l_suppkey") == F.col("s_suppkey")).join(tails, F.col("l_partkey") == F.col("p_partkey"))
    spans = lines.groupBy("_head", "l_partkey", "_tail").agg(F.min("at").cast("date").alias("start"), F.max("at").cast("date").alias("end"))
    return spans.select("_head", "_tail", "start", "end"), names.withColumnRenamed("s_name", "head")


def _allen_query(name: str) -> None:
    @query(f"allen_{name}", f"""
    , s AS (SELECT * FROM facts WHERE relation = 'supplied'),
    j AS (SELECT x.head, x.tail, x."start" AS xs, x."end" AS xe, y."start" AS ys, y."end" AS ye FROM s x JOIN s y ON x.head = y.head)
    SELECT head, count(*) AS pairs, count(DISTINCT tail) AS tails FROM j WHERE {_ALLEN_SQL[name]} GROUP BY head""")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """All supplies of a supplier against all of it, by counts."""
        s, heads = numbered_supplies(spark, sf)
        return intervals.relation_totals(s, "_head", "_tail", name).join(heads, "_head").select("head", "pairs", "tails")


for _name in _ALLEN_SQL:
    _allen_query(_name)


@query("overlap_join", """
SELECT a.head, count(*) AS pairs FROM facts a JOIN facts b ON a.head = b.head AND a."start" <= b."end" AND a."end" >= b."start" AND a.tail < b.tail WHERE a.relation = 'supplied' AND b.relation = 'supplied' GROUP BY a.head""")
def overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    s = supplies(spark, sf)
    side = lambda k: s.select("head", F.col("tail").alias(f"{k}_tail"), F.col("start").alias(f"{k}_start"), F.col("end").alias(f"{k}_end"))
    return intervals.overlap_join(side("l"), side("r"), "head").where("l_tail < r_tail").groupBy("head").agg(F.count(F.lit(1)).alias("pairs"))


# Constrained retrieval


def plan_rows(spark: SparkSession, sf: str, items: str, ranking: str = "null") -> DataFrame:
    kinds = "array<struct<anchor_kind:string,relation:string,anchor_index:int,time_text:string,interval_start:string,interval_end:string,granularity:string,offset_days:int>>"
    heads = supplies(spark, sf).select(F.col("head").alias("qid")).distinct()
    return heads.withColumn("constraints", F.from_json(F.lit(items), kinds)).withColumn("ranking", F.from_json(F.lit(ranking), "rank string, rank_k int"))


_CHAIN = '[{"anchor_kind":"event","relation":"after","anchor_index":0},{"anchor_kind":"explicit","relation":"before","time_text":"1998"}]'


def retrieval(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s, a = anchored(spark, sf)
    cands = match.positions(stamped(s), "timestamp", "tail", "start", "end")
    return cands.drop("start", "end"), stamped(a).withColumn("anchor_index", F.lit(0)).select("qid", "anchor_index", "timestamp")


_CHAIN_SQL = """
, s AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY "start", "end", tail) AS n FROM facts WHERE relation = 'supplied'),
a AS (SELECT head, "start" AS ys, "end" AS ye FROM s WHERE n = 3),
t AS (SELECT s.head, tail, "start", "end", "start" > ye AS c1, "end" < DATE '1998-01-01' AS c2 FROM s JOIN a ON s.head = a.head)"""


@query("constraint_chain_counts", _CHAIN_SQL + """
, k AS (SELECT head AS qid, count(*) AS retrieved_count, count(DISTINCT (tail, "start", "end")) FILTER (c1) AS first_count, count(DISTINCT (tail, "start", "end")) FILTER (c1 AND c2) AS second_count FROM t GROUP BY head)
SELECT qid, retrieved_count, CASE WHEN first_count = 0 THEN 1 ELSE 2 END AS executed_constraint_count, first_count, CASE WHEN first_count = 0 THEN NULL ELSE second_count END AS second_count, least(20, second_count) AS final_count FROM k""")
def constraint_chain_counts(spark: SparkSession, sf: str) -> DataFrame:
    c, a = retrieval(spark, sf)
    got = constraints.evidence_stats(plan_rows(spark, sf, _CHAIN), c, a)
    return got.select("qid", F.col("retrieved_count").cast("long").alias("retrieved_count"), F.col("executed_constraint_count").cast("int").alias("executed_constraint_count"), F.get("after_counts", F.lit(0)).alias("first_count"), F.get("after_counts", F.lit(1)).alias("second_count"), F.col("final_count").cast("long").alias("final_count"))


@query("constraint_evidence", _CHAIN_SQL + """
, d AS (SELECT DISTINCT head, tail, "start", "end" FROM t WHERE c1 AND c2), r AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY CASE WHEN "start" = "end" THEN CAST("start" AS VARCHAR) ELSE concat(CAST("start" AS VARCHAR), '-', CAST("end" AS VARCHAR)) END, tail) AS evidence_rank FROM d)
SELECT head AS qid, tail, evidence_rank FROM r WHERE evidence_rank <= 20""")
def constraint_evidence(spark: SparkSession, sf: str) -> DataFrame:
    c, a = retrieval(spark, sf)
    return longs(constraints.constrained(plan_rows(spark, sf, _CHAIN), c, a).select("qid", "tail", "evidence_rank"), "evidence_rank")


def _rank_query(name: str, direction: str, k: int) -> None:
    order = "ASC" if direction == "asc" else "DESC"

    @query(name, f"""
    , s AS (SELECT DISTINCT head, tail, "start", "end", {_STAMP} AS timestamp FROM facts WHERE relation = 'supplied'),
    p AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY timestamp, tail, "start", "end") AS pos FROM s),
    r AS (SELECT head AS qid, tail, row_number() OVER (PARTITION BY head ORDER BY "start" {order}, pos) AS time_rank FROM p)
    SELECT qid, tail, time_rank FROM r WHERE time_rank <= {3 if k == 1 else k}""")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c, _ = retrieval(spark, sf)
        plan = plan_rows(spark, sf, "[]", f'{{"rank":"{direction}","rank_k":{k}}}')
        distinct = match.positions(c.drop("pos").distinct(), "timestamp", "tail")
        return longs(constraints.rank_candidates(distinct.join(plan, "qid")).select("qid", "tail", "time_rank"), "time_rank")


_rank_query("rank_first", "asc", 1)
_rank_query("rank_last", "desc", 1)
_rank_query("rank_nth", "asc", 5)

# Interval algebra

_ISLANDS = """
, o AS (SELECT {keys}, "start", "end", max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM facts WHERE {where}),
g AS (SELECT *, sum(CASE WHEN "start" <= seen THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM o),
u AS (SELECT {keys}, min("start") AS "start", max("end") AS "end" FROM g GROUP BY {keys}, island)"""


@query("interval_union", _ISLANDS.format(keys="head", where=_SUPPLY) + ' SELECT head, "start", "end" FROM u')
def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.union(supplies(spark, sf), "head")


@query("interval_intersection", _ISLANDS.format(keys="tail, head", where=_SUPPLY) + """
, e AS (SELECT tail, "start" AS day, 1 AS step FROM u UNION ALL SELECT tail, "end" + 1, -1 FROM u), st AS (SELECT tail, day, sum(step) AS step FROM e GROUP BY ALL),
c AS (SELECT tail, day, sum(step) OVER (PARTITION BY tail ORDER BY day) AS cover, lead(day) OVER (PARTITION BY tail ORDER BY day) AS next_day FROM st), n AS (SELECT tail, count(DISTINCT head) AS heads FROM u GROUP BY tail)
SELECT tail, day AS "start", CAST(next_day - 1 AS DATE) AS "end" FROM c JOIN n USING (tail) WHERE cover = heads AND next_day IS NOT NULL""")
def interval_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """When do all suppliers of a part supply it at once?"""
    return intervals.intersection(supplies(spark, sf), "tail", "head")


@query("interval_common", f"""SELECT tail, max("start") AS "start", min("end") AS "end" FROM facts WHERE {_SUPPLY} GROUP BY tail HAVING max("start") <= min("end")""")
def interval_common(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.common_interval(supplies(spark, sf), "tail")


@query("interval_sum", _ISLANDS.format(keys="head, tail", where=_SUPPLY) + """ SELECT head, CAST(sum("end" - "start") AS BIGINT) AS days FROM u GROUP BY head""")
def interval_sum(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.total_duration(supplies(spark, sf), "head", "tail")


@query("interval_average", _ISLANDS.format(keys="head, tail", where=_SUPPLY) + """, d AS (SELECT head, tail, sum("end" - "start") AS days FROM u GROUP BY ALL) SELECT head, CAST(floor(sum(days) / count(*)) AS BIGINT) AS days FROM d GROUP BY head""")
def interval_average(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.average_duration(supplies(spark, sf), "head", "tail")


_DAYS = 'CAST("end" - "start" AS BIGINT)'


@query("duration_days", f"""SELECT head, tail, {_DAYS} AS days, concat({_DAYS}, ' days') AS answer FROM facts WHERE {_SUPPLY}""")
def duration_days(spark: SparkSession, sf: str) -> DataFrame:
    return supplies(spark, sf).select("head", "tail", D.duration_days(F.col("start"), F.col("end")).cast("long").alias("days"), D.duration_text(F.col("start"), F.col("end")).alias("answer"))


def longest(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    return supplies(spark, sf).distinct(), F.datediff("end", "start")


@query("duration_compare", f""", s AS (SELECT DISTINCT head, tail, "start", "end", {_DAYS} AS days FROM facts WHERE {_SUPPLY}), n AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY tail, "start", "end") AS n FROM s)
SELECT a.head, CASE WHEN a.days > b.days THEN 'longer' WHEN a.days < b.days THEN 'shorter' ELSE 'equals' END AS answer FROM n a JOIN n b ON a.head = b.head AND a.n = 1 AND b.n = 2""")
def duration_compare(spark: SparkSession, sf: str) -> DataFrame:
    s, days = longest(spark, sf)
    n = s.withColumn("n", F.row_number().over(Window.partitionBy("head").orderBy("tail", "start", "end"))).withColumn("days", days)
    at = lambda k: F.max(F.when(F.col("n") == k, F.col("days")))
    return n.where("n <= 2").groupBy("head").agg(at(1).alias("a"), at(2).alias("b")).where("b IS NOT NULL").select("head", intervals.compare(F.col("a"), F.col("b")).alias("answer"))


@query("duration_ranked", f""", s AS (SELECT DISTINCT head, tail, "start", "end", {_DAYS} AS days FROM facts WHERE {_SUPPLY}), p AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY tail, "start", "end") AS pos FROM s),
r AS (SELECT head, tail, days, row_number() OVER (PARTITION BY head ORDER BY days DESC, pos) AS duration_rank FROM p) SELECT * FROM r WHERE duration_rank <= 3""")
def duration_ranked(spark: SparkSession, sf: str) -> DataFrame:
    s, days = longest(spark, sf)
    p = s.withColumn("pos", F.row_number().over(Window.partitionBy("head").orderBy("tail", "start", "end"))).withColumn("days", days.cast("long"))
    return longs(intervals.ranked(p, "head", F.col("days"), "pos").where("duration_rank <= 3").select("head", "tail", "days", "duration_rank"), "duration_rank")


@query("duration_extremes", f""", s AS (SELECT DISTINCT head, tail, "start", "end", {_DAYS} AS days FROM facts WHERE {_SUPPLY}), r AS (SELECT *, rank() OVER (PARTITION BY head ORDER BY days DESC) AS r FROM s) SELECT head, tail, "start", "end", days FROM r WHERE r = 1""")
def duration_extremes(spark: SparkSession, sf: str) -> DataFrame:
    s, days = longest(spark, sf)
    return intervals.extremes(s.withColumn("days", days.cast("long")), "head", F.col("days"), "tail").drop("relation")


for _field in ("start", "end"):
    @query(f"rank_{_field}_time", f""", s AS (SELECT DISTINCT head, tail, "start", "end" FROM facts WHERE {_SUPPLY}), r AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY "{_field}", concat(tail, CAST("start" AS VARCHAR), CAST("end" AS VARCHAR))) AS time_rank FROM s) SELECT head, tail, "start", "end", time_rank FROM r WHERE time_rank <= 5""")
    def _rank_time(spark: SparkSession, sf: str, field=_field) -> DataFrame:
        s = supplies(spark, sf).distinct().withColumn("pos", F.concat("tail", F.col("start").cast("string"), F.col("end").cast("string")))
        return longs(intervals.rank_by_time(s, "head", field, "pos").where("time_rank <= 5").drop("pos", "relation"), "time_rank")


@query("answer_rules", _ISLANDS.format(keys="head", where=_SUPPLY) + """, p AS (SELECT DISTINCT head, "start" AS s, concat(CAST("start" AS VARCHAR), ' to ', CAST("end" AS VARCHAR)) AS a FROM u) SELECT head AS qid, string_agg(a, ';' ORDER BY s, a) AS answers FROM p GROUP BY head""")
def answer_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Combined periods of each supplier by the answering rules."""
    evidence = supplies(spark, sf).withColumn("qid", F.col("head")).withColumn("role", F.lit("search"))
    questions = evidence.select("qid").distinct().withColumn("kind", F.lit("combined")).withColumn("granularity", F.lit("day"))
    return answering.answer(questions, evidence).select("qid", F.array_join("answers", ";").alias("answers"))


# Parsing


@query("time_normalize", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), m AS (SELECT *, o_orderkey % 5 AS kind FROM o)
SELECT o_orderkey, CASE kind WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN date_trunc('year', d) WHEN 3 THEN date_trunc('year', d) ELSE d END::DATE AS "start",
  CASE kind WHEN 1 THEN last_day(d) WHEN 2 THEN (date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY) WHEN 3 THEN (date_trunc('year', d) + INTERVAL 2 YEAR - INTERVAL 1 DAY) WHEN 4 THEN d + 10 ELSE d END::DATE AS "end",
  CASE kind WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' END AS granularity, kind >= 3 AS is_interval FROM m""")
def time_normalize(spark: SparkSession, sf: str) -> DataFrame:
    d, kind = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    year = F.year(d).cast("string")
    text = (
        F.when(kind == 0, F.date_format(d, "MMMM d'th', yyyy")).when(kind == 1, F.date_format(d, "MMM yyyy")).when(kind == 2, year)
        .when(kind == 3, F.concat(year, F.lit("-"), (F.year(d) + 1).cast("string"))).otherwise(F.concat(d.cast("string"), F.lit(" to "), F.date_add(d, 10).cast("string")))
    )
    t = D.normalize_time(text)
    return table(spark, sf, "orders").select("o_orderkey", t["start"].alias("start"), t["end"].alias("end"), t["granularity"].alias("granularity"), t["is_interval"].alias("is_interval"))


@query("sentence_linearize", """SELECT CASE WHEN "start" = "end" THEN concat(head, ' ', relation, ' ', tail, ' on ', CAST("start" AS VARCHAR)) ELSE concat(head, ' ', relation, ' ', tail, ' from ', CAST("start" AS VARCHAR), ' to ', CAST("end" AS VARCHAR)) END AS sentence FROM facts""")
def sentence_linearize(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select(rag.sentence(F.col("head"), F.col("relation"), F.col("tail"), F.col("start").cast("string"), F.col("end").cast("string")).alias("sentence"))


@query("fact_text", """SELECT concat('[', head, ', ', relation, ', ', tail, CASE WHEN "start" = "end" THEN concat('] on ', CAST("start" AS VARCHAR)) ELSE concat('] from ', CAST("start" AS VARCHAR), ' to ', CAST("end" AS VARCHAR)) END) AS fact FROM facts""")
def fact_text(spark: SparkSession, sf: str) -> DataFrame:
    return stamped(facts(spark, sf)).select(rag.fact_text(F.col("head"), F.col("relation"), F.col("tail"), F.col("timestamp")).alias("fact"))


@query("folded_documents", r"""SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS folded_sha256 FROM documents""")
def folded_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in compatibility form, case-folded, with single spaces."""
    return X.with_folded(table(spark, sf, "documents").select("doc_id", "text"), "text", "folded").select("doc_id", F.sha2("folded", 256).alias("folded_sha256"))


@query("event_string_parse", """SELECT head, relation, tail, CAST("start" AS VARCHAR) AS start_text, CAST("end" AS VARCHAR) AS end_text FROM facts""")
def event_string_parse(spark: SparkSession, sf: str) -> DataFrame:
    raw = facts(spark, sf).select(X.event_string(F.col("head"), F.col("relation"), F.col("tail"), F.col("start").cast("string"), F.col("end").cast("string")).alias("e"))
    return raw.select(X.parse_event(F.col("e")).alias("e")).select("e.head", "e.relation", "e.tail", F.col("e.start").alias("start_text"), F.col("e.end").alias("end_text"))


@query("answer_normalize", """SELECT doc_id, concat_ws(';', concat(lang, ' to ', source), CASE WHEN n_chars > 0 THEN '1999-01-01 to 2000-01-01' END) AS answers, CAST(CASE WHEN n_chars > 0 THEN 2 ELSE 1 END AS INTEGER) AS n FROM documents""")
def answer_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("lang"), F.lit(" to "), F.col("source"), F.lit(" ; ;"), F.when(F.col("n_chars") > 0, "1999-01-01 - 2000-01-01").otherwise(""))
    a = X.answer_values(raw)
    return table(spark, sf, "documents").select("doc_id", F.array_join(a, ";").alias("answers"), F.size(a).alias("n"))


@query("invalid_answer_filter", """SELECT doc_id FROM documents WHERE doc_id % 5 NOT IN (0, 1, 2)""")
def invalid_answer_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 5
    answers = F.when(k == 0, F.array(F.lit(""), F.lit("No Answer"))).when(k == 1, F.array(F.lit("0 days"))).when(k == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("0 days"), F.lit("x")))
    return table(spark, sf, "documents").where(~curate.invalid_answers(answers)).select("doc_id")


# Similarity

# Every row whose id is divisible by 100 is a query

_SCORES = """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, list_inner_product(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings)"""
_RANKS = _SCORES + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The query set grows with the table; a null id is no query."""
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("vector_topk", _RANKS + " SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return longs(similarity.top_k(*vectors(spark, sf), 10).withColumn("score", F.round("score", 6)), "rank")


@query("vector_threshold", _RANKS + " SELECT query_id, id, rank FROM r WHERE rank <= 64 AND score >= 0.25")
def vector_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return longs(similarity.top_k(*vectors(spark, sf), 64, 0.25).select("query_id", "id", "rank"), "rank")


@query("vector_range", _SCORES + " SELECT query_id, id FROM s WHERE score > 0.3")
def vector_range(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.within(*vectors(spark, sf), 0.3).select("query_id", "id")


@query("high_conf_prune", _RANKS + ", k AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM r WHERE rank <= 64) SELECT query_id, id FROM k WHERE best <= 0.9 OR score >= 0.9")
def high_conf_prune(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.prune_confident(similarity.top_k(*vectors(spark, sf), 64)).select("query_id", "id")


@query("similarity_triple_join", _RANKS + """
, n AS (SELECT query_id AS qid, concat('Supplier#', lpad(CAST(id AS VARCHAR), 9, '0')) AS name, round(score, 6) AS sim FROM r WHERE rank <= 64), facts AS (""" + FACTS + """)
SELECT qid, head, tail, sim AS h_sim, round(2.0 + sim, 6) AS score_sum FROM facts JOIN n ON head = name WHERE relation = 'supplied'""")
def similarity_triple_join(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate names from vector search, joined with all supplies."""
    near = similarity.top_k(*vectors(spark, sf), 64)
    heads = near.select(F.col("query_id").alias("qid"), F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"), F.round("score", 6).alias("sim"))
    found = similarity.similar_triples({"head": heads, "relation": None, "tail": None}, supplies(spark, sf))
    return found.select("qid", "head", "tail", "h_sim", F.round("score_sum", 6).alias("score_sum"))


# Three slots at once: names of suppliers, line states and parts have vectors; a question is three vectors. Similarities in whole millionths, so that sums tie alike everywhere.

_NAMED = f"""shipments AS (SELECT DISTINCT concat('s', l_suppkey) AS head, concat(l_returnflag, l_linestatus) AS relation, concat('p', l_partkey) AS tail FROM lineitem),
n AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
names AS (SELECT 'head' AS slot, concat('s', s_suppkey) AS name, s_suppkey % n AS id FROM supplier, n UNION ALL SELECT 'tail', concat('p', p_partkey), p_partkey % n FROM part, n UNION ALL SELECT 'relation', m, ascii(m) * 11 % n FROM (SELECT DISTINCT concat(l_returnflag, l_linestatus) AS m FROM lineitem), n),
q AS (SELECT vec_id AS qid, unnest([{{'slot': 'head', 'id': vec_id}}, {{'slot': 'relation', 'id': (vec_id * 7 + 1) % n}}, {{'slot': 'tail', 'id': (vec_id * 13 + 5) % n}}], recursive := true) FROM embeddings, n WHERE vec_id % 100 = 0),
sims AS (SELECT qid, q.slot, name, CAST(round(1000000 * list_inner_product(a.v, b.v)) AS BIGINT) AS sim FROM q JOIN e a ON q.id = a.vec_id JOIN names USING (slot) JOIN e b ON names.id = b.vec_id),
j AS (SELECT qid, f.head, f.relation, f.tail, h.sim AS h_sim, r.sim AS r_sim, t.sim AS t_sim, h.sim + r.sim + t.sim AS score_sum FROM shipments f JOIN sims h ON h.slot = 'head' AND h.name = f.head JOIN sims r USING (qid) JOIN sims t USING (qid) WHERE r.slot = 'relation' AND r.name = f.relation AND t.slot = 'tail' AND t.name = f.tail)"""


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Made distinct by their keys, which are exchanged for less than the names made of them."""
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    keys = table(spark, sf, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("relation"), "l_partkey").distinct()
    return keys.select(key("s", "l_suppkey").alias("head"), "relation", key("p", "l_partkey").alias("tail"))


def named_slots(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """For each slot the questions' vectors (qid, v) and the names with theirs (name, v)."""
    e = table(spark, sf, "embeddings")
    n = e.count()
    e = e.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").alias("v"))
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string")).alias("name")
    names = {
        "head": table(spark, sf, "supplier").select(key("s", "s_suppkey"), (F.col("s_suppkey") % n).alias("vec_id")),
        "relation": table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("name")).distinct().withColumn("vec_id", (F.ascii("name") * 11 % n).cast("long")),
        "tail": table(spark, sf, "part").select(key("p", "p_partkey"), (F.col("p_partkey") % n).alias("vec_id")),
    }
    asked = {"head": F.col("vec_id"), "relation": (F.col("vec_id") * 7 + 1) % n, "tail": (F.col("vec_id") * 13 + 5) % n}
    q = table(spark, sf, "embeddings").where("vec_id % 100 = 0")
    questions = {s: q.select(F.col("vec_id").alias("qid"), at.alias("vec_id")).join(e, "vec_id").select("qid", "v") for s, at in asked.items()}
    return questions, {s: vocabulary.join(e, "vec_id").select("name", "v") for s, vocabulary in names.items()}


@query("similarity_rank_join", f"WITH {_NAMED} SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score_sum DESC, head, relation, tail) <= 50")
def similarity_rank_join(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best facts of each question by the sum of three similarities; all names are candidates."""
    return rank_scan.best_triples(*named_slots(spark, sf), shipments(spark, sf), 50)


@query("exact_or_similar", f"""WITH {_NAMED},
p AS (SELECT vec_id AS qid, concat('s', vec_id % 10 + 1) AS head, 'RF' AS relation, CASE WHEN vec_id % 200 = 0 THEN NULL ELSE 'no such part' END AS tail FROM embeddings WHERE vec_id % 100 = 0),
x AS (SELECT qid, f.head, f.relation, f.tail FROM p JOIN shipments f ON p.head = f.head AND p.relation = f.relation AND coalesce(p.tail, f.tail) = f.tail)
SELECT qid, head, relation, tail, CAST(3 AS BIGINT) AS score_sum, false AS approximate FROM x
UNION ALL SELECT qid, head, relation, tail, score_sum, true FROM (SELECT * FROM j WHERE qid NOT IN (SELECT qid FROM x) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score_sum DESC, head, relation, tail) <= 50)""")
def exact_or_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns with a supplier and a line state; every second one asks for a part that does not exist and gets the 50 most similar facts."""
    e = table(spark, sf, "embeddings").where("vec_id % 100 = 0")
    asked = F.when(F.col("vec_id") % 200 != 0, "no such part")
    p = e.select(F.col("vec_id").alias("qid"), F.concat(F.lit("s"), (F.col("vec_id") % 10 + 1).cast("string")).alias("head"), F.lit("RF").alias("relation"), asked.alias("tail"))
    f = S.stored_table(shipments(spark, sf))
    questions, names = named_slots(spark, sf)
    similar = lambda left: rank_scan.best_triples({s: df.join(left.select("qid"), "qid") for s, df in questions.items()}, names, f, 50, stored=True)
    return match.exact_or_similar(S.stored_table(p), f, similar, stored_patterns=True).select("qid", "head", "relation", "tail", F.col("score_sum").cast("long").alias("score_sum"), "approximate")


@query("swap_relax_cascade", _SCORES + """
, f AS (SELECT query_id, id, score FROM s WHERE id % 2 = 0 AND id <> query_id), b AS (SELECT query_id, id, score FROM s WHERE id % 2 = 1 AND id <> query_id),
u AS (SELECT *, 0 AS branch FROM f WHERE score >= 0.4 UNION ALL SELECT *, 1 FROM b WHERE score >= 0.4 UNION ALL SELECT *, 2 FROM f WHERE score >= 0.2 UNION ALL SELECT *, 3 FROM b WHERE score >= 0.2)
SELECT query_id, id, CAST(branch AS INTEGER) AS branch, branch % 2 = 1 AS swapped FROM u QUALIFY branch = min(branch) OVER (PARTITION BY query_id)""")
def swap_relax_cascade(spark: SparkSession, sf: str) -> DataFrame:
    s = similarity.scores(*vectors(spark, sf), least=0.2).where("id <> query_id")
    return similarity.swap_cascade(s.where("id % 2 = 0"), s.where("id % 2 = 1")).select("query_id", "id", "branch", "swapped")


# Curation


def triples(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("qid"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("head"), F.lit("did").alias("relation"), F.concat(F.lit("u"), (F.col("event_id") % 5).cast("string")).alias("tail"), F.col("value").alias("score_sum"), F.col("event_id").alias("pos"))


_TRIPLES = "WITH t AS (SELECT event_type AS qid, concat('u', user_id % 7) AS head, concat('u', event_id % 5) AS tail, value AS score_sum, event_id AS pos FROM events)"


@query("dedup_max_score", _TRIPLES + ", f AS (SELECT *, row_number() OVER (PARTITION BY qid, head, tail ORDER BY score_sum DESC, pos) AS n FROM t), r AS (SELECT qid, head, tail, pos, row_number() OVER (PARTITION BY qid ORDER BY score_sum DESC, pos) AS k FROM f WHERE n = 1) SELECT qid, head, tail, pos FROM r WHERE k <= 10")
def dedup_max_score(spark: SparkSession, sf: str) -> DataFrame:
    return curate.best_triples(triples(spark, sf), 10).select("qid", "head", "tail", "pos")


@query("dedup_reverse_pair", _TRIPLES + ", f AS (SELECT *, row_number() OVER (PARTITION BY qid, least(head, tail), greatest(head, tail) ORDER BY score_sum DESC, pos) AS n FROM t), r AS (SELECT qid, head, tail, pos, row_number() OVER (PARTITION BY qid ORDER BY score_sum DESC, pos) AS k FROM f WHERE n = 1) SELECT qid, head, tail, pos FROM r WHERE k <= 10")
def dedup_reverse_pair(spark: SparkSession, sf: str) -> DataFrame:
    return curate.best_triples(triples(spark, sf), 10, either_way=True).select("qid", "head", "tail", "pos")


@query("dedup_first", _TRIPLES + ", f AS (SELECT *, row_number() OVER (PARTITION BY qid, head, tail ORDER BY pos) AS n FROM t) SELECT qid, head, tail, pos FROM f WHERE n = 1")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return curate.first_by(triples(spark, sf), ["qid", "head", "relation", "tail"], "pos").select("qid", "head", "tail", "pos")


@query("first_event_of_answer", f""", r AS (SELECT head, tail, "start", "end", row_number() OVER (PARTITION BY head, tail ORDER BY "start", "end") AS n FROM facts WHERE {_SUPPLY}) SELECT head AS qid, tail, "start", "end" FROM r WHERE n = 1""")
def first_event_of_answer(spark: SparkSession, sf: str) -> DataFrame:
    return curate.first_event_of_answers(supplies(spark, sf).withColumn("qid", F.col("head")), "tail").select("qid", "tail", "start", "end")


def qa(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as question records: the text is the question, the source its kind, the level goes by id."""
    d = table(spark, sf, "documents")
    level = F.when(F.col("doc_id") % 4 == 0, "medium").when(F.col("doc_id") % 7 == 0, "complex").otherwise("simple")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.array("source").alias("answer"), F.array("lang").alias("events"), level.alias("question_level"), F.col("lang").alias("question_type"))


_QA = "WITH r AS (SELECT doc_id AS id, text AS question, source, lang, CASE WHEN doc_id % 4 = 0 THEN 'medium' WHEN doc_id % 7 = 0 THEN 'complex' ELSE 'simple' END AS question_level FROM documents)"


@query("merge_duplicates", _QA + """, c AS (SELECT *, count(*) OVER (PARTITION BY question, question_level) AS copies FROM r),
m AS (SELECT min(id) AS id, question_level, string_agg(DISTINCT source, ',' ORDER BY source) AS answers, count(*) AS merged FROM c WHERE question_level = 'simple' GROUP BY question, question_level)
SELECT * FROM m UNION ALL SELECT id, question_level, source, 1 FROM c WHERE question_level <> 'simple' AND copies = 1""")
def merge_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return curate.merge_duplicates(qa(spark, sf)).select("id", "question_level", F.array_join("answer", ",").alias("answers"), "merged")


@query("duplicate_groups", "SELECT sha256(text) AS question_hash, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    hashed = table(spark, sf, "documents").select(X.text_hash(F.col("text")).alias("question_hash"))
    return curate.duplicate_groups(hashed, "question_hash")


@query("balance_levels", """WITH d AS (SELECT doc_id, lang AS question_level, source AS question_type, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents), r AS (SELECT * FROM d WHERE question_level IN ('en', 'fr', 'de')),
t AS (SELECT min(c) AS target FROM (SELECT count(*) AS c FROM r GROUP BY question_level)), n AS (SELECT *, row_number() OVER (PARTITION BY question_level, question_type ORDER BY h) AS n FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY question_level ORDER BY n, question_type DESC) AS k FROM n) SELECT doc_id, question_level, question_type FROM o, t WHERE k <= target
UNION ALL SELECT doc_id, question_level, question_type FROM d WHERE question_level IS NULL OR question_level NOT IN ('en', 'fr', 'de')""")
def balance_levels(spark: SparkSession, sf: str) -> DataFrame:
    """All documents: three languages cut to the size of the smallest, the others and those without a language pass."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("question_level"), F.col("source").alias("question_type"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return curate.balance_levels(d, "question_level", "question_type", "h", ("en", "fr", "de")).select("doc_id", "question_level", "question_type")


@query("largest_remainder", """WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), f AS (SELECT *, n * 8 // 10 AS a, n // 10 AS b, n % 10 AS rest FROM n),
p AS (SELECT lang, source, n, unnest([{'name': 'train', 'f': a, 'r': n * 8 % 10, 't': 0}, {'name': 'validation', 'f': b, 'r': rest, 't': 1}, {'name': 'test', 'f': b, 'r': rest, 't': 2}], recursive := true) FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY r DESC, t) AS k, n - sum(f) OVER (PARTITION BY lang, source) AS spare FROM p) SELECT lang, source, name AS split, CAST(f + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS n FROM k""")
def largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("c"))
    return n.select("lang", "source", F.explode(curate.largest_remainder(F.col("c"))).alias("x")).select("lang", "source", F.col("x.name").alias("split"), F.col("x.count").cast("long").alias("n"))


@query("stratified_split", """WITH RECURSIVE d AS (SELECT doc_id, lang, source, concat(coalesce(lang, '~'), chr(1), coalesce(source, '~')) AS s, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
g AS (SELECT s, count(*) AS c, count(*) * 8 // 10 AS ft, count(*) // 10 AS fv, count(*) * 8 % 10 AS rt, count(*) % 10 AS rv FROM d GROUP BY s),
n AS (SELECT sum(c) AS n, sum(ft) AS t, sum(fv) AS v FROM g), w AS (SELECT n * 8 // 10 AS wt, n // 10 AS wv, n * 8 % 10 AS ot, n % 10 AS ov, n - n * 8 // 10 - 2 * (n // 10) AS spare, t, v FROM n),
lack AS (SELECT wt + CASE WHEN spare >= 1 AND (ot >= ov OR spare > 2) THEN 1 ELSE 0 END - t AS lt, wv + CASE WHEN spare >= CASE WHEN ot >= ov THEN 2 ELSE 1 END THEN 1 ELSE 0 END - v AS lv, wv + CASE WHEN spare >= CASE WHEN ot >= ov THEN 3 ELSE 2 END THEN 1 ELSE 0 END - v AS ls FROM w),
spare AS (SELECT s, rt, rv, unnest(range(c - ft - 2 * fv)) AS j, c FROM g), step AS (SELECT *, row_number() OVER (ORDER BY c DESC, s, j) AS i FROM spare),
deal AS (
  SELECT CAST(0 AS BIGINT) AS i, '' AS s, '' AS got, '' AS pick, CAST(lt AS BIGINT) AS lt, CAST(lv AS BIGINT) AS lv, CAST(ls AS BIGINT) AS ls FROM lack
  UNION ALL
  SELECT i, s, got || pick, pick, lt - CAST(pick = 't' AS INT), lv - CAST(pick = 'v' AS INT), ls - CAST(pick = 's' AS INT) FROM (
    SELECT i, s, got, lt, lv, ls, CASE WHEN et >= ev AND et >= es THEN 't' WHEN ev >= es THEN 'v' ELSE 's' END AS pick FROM (
      SELECT i, s, got, lt, lv, ls, CASE WHEN lt > 0 THEN rt - 10 * CAST(contains(got, 't') AS INT) ELSE -99 END AS et, CASE WHEN lv > 0 THEN rv - 10 * CAST(contains(got, 'v') AS INT) ELSE -99 END AS ev, CASE WHEN ls > 0 THEN rv - 10 * CAST(contains(got, 's') AS INT) ELSE -99 END AS es
      FROM (SELECT step.i, step.s, rt, rv, lt, lv, ls, CASE WHEN j = 0 THEN '' ELSE got END AS got FROM deal JOIN step ON step.i = deal.i + 1)))
),
q AS (SELECT g.s, ft + count(*) FILTER (pick = 't') AS t, ft + count(*) FILTER (pick = 't') + fv + count(*) FILTER (pick = 'v') AS v FROM g LEFT JOIN deal ON g.s = deal.s GROUP BY g.s, ft, fv),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h) AS k FROM d)
SELECT doc_id, lang, source, CASE WHEN k <= t THEN 'train' WHEN k <= v THEN 'validation' ELSE 'test' END AS split FROM o JOIN q USING (s)""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by language and source, 8:1:1."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return curate.stratified_split(d, ["lang", "source"], "h").drop("h")


@query("hash_split", """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS k, count(*) OVER () AS n FROM documents),
c AS (SELECT *, n * 8 // 10 AS a, n // 10 AS b, n - n * 8 // 10 - 2 * (n // 10) AS spare, n * 8 % 10 AS ra, n % 10 AS rb FROM o)
SELECT doc_id, CASE WHEN k <= a + CASE WHEN spare > 0 AND (ra > rb OR spare > 2) THEN 1 ELSE 0 END THEN 'train' WHEN k <= a + CASE WHEN spare > 0 AND (ra > rb OR spare > 2) THEN 1 ELSE 0 END + b + CASE WHEN (ra <= rb AND spare >= 1) OR (ra > rb AND spare >= 2) THEN 1 ELSE 0 END THEN 'validation' ELSE 'test' END AS split FROM c""")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return curate.hash_split(table(spark, sf, "documents").select("doc_id"), F.sha2(F.col("doc_id").cast("string"), 256))


@query("stratified_sample", """WITH d AS (SELECT doc_id, lang, sha256(CAST(doc_id AS VARCHAR)) AS h, count(*) OVER (PARTITION BY lang) AS c, count(*) OVER () AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS k, floor(CAST(c AS DOUBLE) * least(100, n) / n) AS quota FROM d), o AS (SELECT *, row_number() OVER (ORDER BY k > quota, h) AS z FROM r) SELECT doc_id, lang FROM o WHERE z <= 100""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return curate.stratified_sample(d, ["lang"], F.sha2(F.col("doc_id").cast("string"), 256), 100, "floor")


@query("count_summary", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def count_summary(spark: SparkSession, sf: str) -> DataFrame:
    return curate.summary(table(spark, sf, "documents"), "lang", "source").drop("grouping")


# Programs and evaluation


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """One question for each supplier: what it supplied after its first supply; both events are given."""
    s = supplies(spark, sf).distinct().withColumn("n", F.row_number().over(Window.partitionBy("head").orderBy("start", "end", "tail")))
    e = F.struct("head", "relation", "tail", "start", "end")
    two = s.where("n IN (1, 3)").groupBy("head").agg(F.min_by(e, "n").alias("a"), F.max_by(e, "n").alias("q"), F.count(F.lit(1)).alias("c")).where("c = 2 AND a.tail <> q.tail AND NOT contains(a.tail, q.tail) AND NOT contains(q.tail, a.tail)")
    question = F.concat(F.lit("What did it supply after "), F.col("a.tail"), F.lit("?"))
    return two.select(F.col("head").alias("id"), question.alias("question"), F.lit("X > Y").alias("temporal_relation"), F.lit("object").alias("answer_type"), F.array("q", "a").alias("event_list"))


@query("program_execute", """
, s AS (SELECT DISTINCT head, tail, "start", "end" FROM facts WHERE relation = 'supplied'), n AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY "start", "end", tail) AS n FROM s),
a AS (SELECT a.head, a."end" AS ye FROM n a JOIN n q ON a.head = q.head AND a.n = 1 AND q.n = 3 WHERE a.tail <> q.tail AND NOT contains(a.tail, q.tail) AND NOT contains(q.tail, a.tail)),
t AS (SELECT DISTINCT s.head, s.tail FROM s JOIN a ON s.head = a.head WHERE s."start" > ye) SELECT a.head AS qid, count(t.tail) AS n_answers, 'OK' AS status FROM a LEFT JOIN t ON a.head = t.head GROUP BY a.head""")
def program_execute(spark: SparkSession, sf: str) -> DataFrame:
    """Link, compile and run one program for each supplier."""
    compiled = S.stored(programs.compile_cases(cases(spark, sf)))
    done = programs.execute_cases(compiled, supplies(spark, sf))
    return done.join(compiled.select(F.col("id").alias("qid"), "status"), "qid").select("qid", F.size("answers").cast("long").alias("n_answers"), "status")


@query("program_answers", """
, s AS (SELECT DISTINCT head, tail, "start", "end" FROM facts WHERE relation = 'supplied'), n AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY "start", "end", tail) AS n FROM s),
a AS (SELECT a.head, a."end" AS ye FROM n a JOIN n q ON a.head = q.head AND a.n = 1 AND q.n = 3 WHERE a.tail <> q.tail AND NOT contains(a.tail, q.tail) AND NOT contains(q.tail, a.tail)),
t AS (SELECT s.head, s.tail, min((s."start", s."end", s.tail)) AS k FROM s JOIN a ON s.head = a.head WHERE s."start" > ye GROUP BY s.head, s.tail) SELECT a.head AS qid, coalesce(string_agg(t.tail, ';' ORDER BY k) FILTER (t.tail IS NOT NULL), '') AS answers FROM a LEFT JOIN t ON a.head = t.head GROUP BY a.head""")
def program_answers(spark: SparkSession, sf: str) -> DataFrame:
    """``program_execute`` by the answers themselves, in their order."""
    return programs.execute_cases(programs.compile_cases(cases(spark, sf)), supplies(spark, sf)).select("qid", F.array_join("answers", ";").alias("answers"))


def graph_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Six questions for each supplier of two parts or more, each over the first supplies of its alphabetically first and last part."""
    s = supplies(spark, sf)
    first = s.groupBy("head", "tail").agg(F.min(F.struct("start", "end")).alias("at"))
    ends = first.groupBy("head").agg(F.min_by("at", "tail").alias("x"), F.min("tail").alias("a"), F.max_by("at", "tail").alias("y"), F.max("tail").alias("b")).where("a <> b")
    event = lambda tail, at: F.struct("head", F.lit("supplied").alias("relation"), F.col(tail).alias("tail"), F.col(f"{at}.start").alias("start"), F.col(f"{at}.end").alias("end"))
    kinds = [("timeline", "timestamp_range"), ("timeline", "object"), ("union", "timestamp_range"), ("intersection", "timestamp_range"), ("sum", "duration"), ("average", "duration")]
    kind = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(t).alias("t")) for o, t in kinds)))
    rows = ends.select("head", F.array(event("a", "x"), event("b", "y")).alias("event_list"), kind.alias("k"))
    return rows.select(F.concat_ws("/", "head", "k.o", "k.t").alias("id"), F.lit("").alias("question"), F.col("k.o").alias("temporal_relation"), F.col("k.t").alias("answer_type"), "event_list")


@query("program_operators_on_graph", """
, s AS (SELECT DISTINCT head, tail, "start", "end" FROM facts WHERE relation = 'supplied'), t AS (SELECT head, min(tail) AS a, max(tail) AS b FROM s GROUP BY head HAVING min(tail) <> max(tail)),
g AS (SELECT s.*, CAST(tail = b AS INTEGER) AS seed, concat(CAST("start" AS VARCHAR), ' to ', CAST("end" AS VARCHAR)) AS span FROM s JOIN t USING (head) WHERE tail IN (a, b)),
f AS (SELECT head, seed, min(("start", "end")) AS at FROM g GROUP BY head, seed),
m AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY head, seed ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM g),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY head, seed ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
i AS (SELECT head, seed, min("start") AS s, max("end") AS e FROM n GROUP BY head, seed, island),
um AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY head ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM g),
un AS (SELECT *, sum(fresh) OVER (PARTITION BY head ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM um),
u AS (SELECT head, min("start") AS s, max("end") AS e FROM un GROUP BY head, island),
x AS (SELECT a.head, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM i a JOIN i b ON a.head = b.head AND a.seed = 0 AND b.seed = 1 WHERE greatest(a.s, b.s) <= least(a.e, b.e)),
days AS (SELECT head, CAST(sum(e - s) AS BIGINT) AS d FROM i GROUP BY head),
one AS (SELECT head, span, min(seed) AS seed FROM g GROUP BY head, span), tails AS (SELECT s.head, s.tail, min((f.seed, s."start", s."end", s.tail)) AS k FROM s JOIN f ON s.head = f.head AND s."start" = f.at[1] AND s."end" = f.at[2] GROUP BY s.head, s.tail)
SELECT concat(head, '/timeline/timestamp_range') AS id, string_agg(span, ';' ORDER BY seed, span) AS answers FROM one GROUP BY head
UNION ALL SELECT concat(head, '/timeline/object'), string_agg(tail, ';' ORDER BY k) FROM tails GROUP BY head
UNION ALL SELECT concat(head, '/union/timestamp_range'), string_agg(concat(CAST(s AS VARCHAR), ' to ', CAST(e AS VARCHAR)), ';' ORDER BY s) FROM u GROUP BY head
UNION ALL SELECT concat(t.head, '/intersection/timestamp_range'), coalesce(string_agg(concat(CAST(s AS VARCHAR), ' to ', CAST(e AS VARCHAR)), ';' ORDER BY s) FILTER (s IS NOT NULL), '') FROM t LEFT JOIN x USING (head) GROUP BY t.head
UNION ALL SELECT concat(head, '/sum/duration'), concat(d, ' days') FROM days UNION ALL SELECT concat(head, '/average/duration'), concat(d // 2, ' days') FROM days""")
def program_operators_on_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Operators over all supplies of the named parts instead of the named supplies alone."""
    done = programs.execute_operators(programs.compile_cases(graph_cases(spark, sf)), supplies(spark, sf))
    return done.select(F.col("qid").alias("id"), F.array_join("answers", ";").alias("answers"))


@query("program_union_from_events", _ISLANDS.format(keys="head", where="relation = 'supplied'") + """ SELECT head AS id, string_agg(concat(CAST("start" AS VARCHAR), ' to ', CAST("end" AS VARCHAR)), ';' ORDER BY "start") AS answers FROM u GROUP BY head""")
def program_union_from_events(spark: SparkSession, sf: str) -> DataFrame:
    e = supplies(spark, sf).groupBy("head").agg(F.collect_list(F.struct("head", "relation", "tail", "start", "end")).alias("event_list"))
    return e.select(F.col("head").alias("id"), F.array_join(programs.answer_from_events(F.lit("union"), F.col("event_list"), F.lit("")), ";").alias("answers"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    pred = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.when((F.col("doc_id") + k) % 13 == 0, F.lit(" ")).otherwise(F.concat(F.lit("A"), ((F.col("doc_id") * 7 + k) % 23).cast("string"))))
    gold = F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a"), (F.col("doc_id") % 23).cast("string"))))
    return d.select(F.col("doc_id").alias("id"), pred.alias("predict_answer"), gold.alias("answer"), F.col("lang").alias("question_level"), F.col("source").alias("qtype"))


@query("hits_at_k", """WITH p AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 23 END AS gold, list_filter([CASE WHEN (doc_id + k) % 13 = 0 THEN NULL ELSE (doc_id * 7 + k) % 23 END for k in range(0, 12)], lambda x: x IS NOT NULL) AS pred FROM documents),
h AS (SELECT lang, CAST(coalesce(list_contains(pred[1:1], gold), false) AS BIGINT) AS h1, CAST(coalesce(list_contains(pred[1:10], gold), false) AS BIGINT) AS h10 FROM p)
SELECT lang AS question_level, count(*) AS n, CAST(sum(h1) AS BIGINT) AS hits_1, CAST(sum(h10) AS BIGINT) AS hits_10, sum(h1) / count(*) AS hit_rate_1, sum(h10) / count(*) AS hit_rate_10 FROM h GROUP BY GROUPING SETS ((lang), ())""")
def hits_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.hits(predictions(spark, sf), "predict_answer", "answer", ["question_level"])


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("lang", "source", (F.col("doc_id") % 40).alias("before"), F.least(F.col("doc_id") % 40, F.lit(20)).alias("after"))


@query("compression", """WITH e AS (SELECT lang, source, doc_id % 40 AS b, least(doc_id % 40, 20) AS a FROM documents)
SELECT CASE WHEN grouping(lang) = 0 THEN 'level' WHEN grouping(source) = 0 THEN 'type' ELSE 'overall' END AS scope, coalesce(lang, source, 'overall') AS name, count(*) AS n, CAST(sum(b) FILTER (b > 0) AS BIGINT) AS before, CAST(sum(a) FILTER (b > 0) AS BIGINT) AS after,
round((sum(b) FILTER (b > 0) - sum(a) FILTER (b > 0)) / sum(b) FILTER (b > 0) * 100, 3) AS reduction_percent, count(*) FILTER (b > 0) AS evaluated FROM e GROUP BY GROUPING SETS ((lang), (source), ())""")
def compression(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.by_groups(evidence_rows(spark, sf), "lang", "source", *evaluate.compression("before", "after"))


@query("answer_coverage", """WITH c AS (SELECT lang, source, doc_id % 3 + 1 AS n, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE least(doc_id % 3 + 1, doc_id % 2 + 1) END AS hit FROM documents)
SELECT CASE WHEN grouping(lang) = 0 THEN 'level' WHEN grouping(source) = 0 THEN 'type' ELSE 'overall' END AS scope, coalesce(lang, source, 'overall') AS name, count(*) AS n, count(*) AS evaluated, round(avg(CASE WHEN hit > 0 THEN 1.0 ELSE 0 END::DOUBLE) * 100, 3) AS any_percent,
round(avg(CASE WHEN hit = n THEN 1.0 ELSE 0 END::DOUBLE) * 100, 3) AS full_percent, round(avg(hit::DOUBLE / n) * 100, 3) AS recall_percent FROM c GROUP BY GROUPING SETS ((lang), (source), ())""")
def answer_coverage(spark: SparkSession, sf: str) -> DataFrame:
    names = lambda n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: F.concat(F.lit("e"), k.cast("string")))
    c = evaluate.coverage(names(F.col("doc_id") % 3 + 1), names(F.col("doc_id") % 2 + 1), F.col("doc_id") % 4 == 0)
    rows = table(spark, sf, "documents").select("lang", "source", c.alias("coverage"))
    return evaluate.by_groups(rows, "lang", "source", *evaluate.coverage_metrics("coverage"))


@query("event_retention", """, g AS (SELECT DISTINCT head AS qid, least(head, tail) AS a, greatest(head, tail) AS b, "start", "end" FROM facts WHERE relation = 'supplied'), e AS (SELECT DISTINCT head AS qid, least(head, tail) AS a, greatest(head, tail) AS b, "start", "end" FROM facts WHERE relation = 'supplied' AND "start" < DATE '1996-01-01')
SELECT g.qid, count(*) AS gold, count(e.a) AS kept FROM g LEFT JOIN e ON g.qid = e.qid AND g.a = e.a AND g.b = e.b AND g."start" = e."start" AND g."end" = e."end" GROUP BY g.qid""")
def event_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Gold supplies among those before 1996, stored the other way round."""
    gold = supplies(spark, sf).withColumn("qid", F.col("head"))
    evidence = gold.where("start < DATE '1996-01-01'").select("qid", F.col("tail").alias("head"), F.col("head").alias("tail"), "start", "end")
    sizes = gold.groupBy("qid").agg(F.countDistinct("head", "tail", "start", "end").alias("gold"))
    return evaluate.event_retention(gold, evidence).join(sizes, "qid").select("qid", "gold", F.round(F.col("retention.recall") * F.col("gold")).cast("long").alias("kept"))


# Windows over event time


@query("tumbling_events", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_events(spark: SparkSession, sf: str) -> DataFrame:
    return stream.tumbling(table(spark, sf, "events"), "1 day", "event_type").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("session_events", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, b ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, s""")
def session_events(spark: SparkSession, sf: str) -> DataFrame:
    return stream.sessions(table(spark, sf, "events"), "6 hours", "user_id")
