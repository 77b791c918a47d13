"""Registered queries that write files and read them back, and those over facts, records and evidence that need no files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answering, constraints, curate, evaluate, match, programs, rag
from ..sources import facts as S
from ..sources.store import scratch_folder
from .rules import ORACLE, QUERIES
from .workload import _STAMP, _SUPPLY, facts, longs, query, stamped, supplies, table

# Files


@query("fact_files", """SELECT replace(head, '_', ' ') AS head, replace(relation, '_', ' ') AS relation, replace(tail, '_', ' ') AS tail, CAST("start" AS VARCHAR) AS start_text, CAST("end" AS VARCHAR) AS end_text FROM facts""")
def fact_files(spark: SparkSession, sf: str) -> DataFrame:
    """Facts written as a text file of fact lines and scanned again."""
    folder = scratch_folder(spark)
    under = lambda c: F.translate(F.col(c), " ", "_")
    lines = facts(spark, sf).select(F.concat_ws("\t", under("head"), under("relation"), under("tail"), F.col("start").cast("string"), F.when(F.col("start") != F.col("end"), F.col("end").cast("string"))).alias("line"))
    S.write_text(lines, f"{folder}/facts", "line")
    return S.read_facts(spark, f"{folder}/facts").where("parse_error IS NULL").select("head", "relation", "tail", F.col("start").alias("start_text"), F.col("end").alias("end_text"))


@query("record_files", "SELECT o_orderkey AS id, o_orderpriority AS label, CAST(o_orderdate AS VARCHAR)[1:10] AS day FROM orders")
def record_files(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as lines of JSON, half of them appended, and scanned again."""
    folder = scratch_folder(spark)
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    S.write_jsonl(rows.where("id % 2 = 0"), f"{folder}/rows")
    S.write_jsonl(rows.where("id % 2 = 1"), f"{folder}/rows", append=True)
    return S.read_jsonl(spark, f"{folder}/rows", "id long, label string, day string")


@query("wrapped_records", "SELECT c_custkey AS id, c_name AS name FROM customer")
def wrapped_records(spark: SparkSession, sf: str) -> DataFrame:
    """JSON files of a hundred records each, as a list or under one of the container keys, scanned with one schema."""
    folder = scratch_folder(spark)
    packed = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("pack")).agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("rows"))
    kind = F.col("pack") % 3
    under = lambda k: F.to_json(F.struct(F.col("rows").alias(k)))
    packed.select("pack", F.when(kind == 0, F.to_json("rows")).when(kind == 1, under("data")).otherwise(under("items")).alias("value")).write.partitionBy("pack").text(f"{folder}/packs")
    return S.read_records(spark, f"{folder}/packs/pack=*", "id long, name string")


@query("split_files", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'validation' END AS split FROM documents")
def split_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark)
    k = F.col("doc_id") % 3
    S.write_splits(table(spark, sf, "documents").select("doc_id", F.when(k == 0, "train").when(k == 1, "test").otherwise("validation").alias("split")), f"{folder}/splits")
    return spark.read.schema("doc_id long, split string").json(f"{folder}/splits")


@query("graph_files", """, r AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS relation_id FROM (SELECT DISTINCT relation FROM facts)), e AS (SELECT head AS name FROM facts UNION SELECT tail FROM facts)
SELECT relation, relation_id, count(*) AS edges, (SELECT count(*) FROM e) AS entities FROM facts JOIN r USING (relation) GROUP BY relation, relation_id""")
def graph_files(spark: SparkSession, sf: str) -> DataFrame:
    """Artefact tables saved, found complete, and loaded again by what ``meta`` lists."""
    folder = scratch_folder(spark)
    graph = S.build_graph(stamped(facts(spark, sf)), "timestamp")
    if not S.save_graph(graph, folder) or S.save_graph(graph, folder):
        raise RuntimeError("a graph is saved once")
    held = S.load_graph(spark, folder)
    counted = held["facts"].groupBy("relation", "relation_id").agg(F.count(F.lit(1)).alias("edges"))
    return longs(counted, "relation_id").withColumn("entities", F.lit(held["entities"].count()))


# Answers from evidence: every kind of question for each supplier; every fifth supply is an anchor and serves only where there is no other

_EVIDENCE = f""", v AS (SELECT head, tail, "start" AS s, "end" AS e, CAST(right(tail, 1) IN ('0', '5') AS INTEGER) AS p FROM facts WHERE {_SUPPLY}), u AS (SELECT head, tail, s, e FROM v WHERE p = (SELECT min(p) FROM v w WHERE w.head = v.head))"""
_ANSWER = """SELECT concat(head, '/{kind}') AS qid, string_agg(a, ';' ORDER BY k, a) AS answers FROM (SELECT head, a, min(k) AS k FROM (SELECT head, {answer} AS a, s AS k FROM u) GROUP BY head, a) GROUP BY head"""
_SPAN = "CAST(s AS VARCHAR) || ' to ' || CAST(e AS VARCHAR)"
_MERGED = """m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY head{0} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM u),
i AS (SELECT head{0}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY head{0} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m) GROUP BY head{0}, n)"""


@query("answer_kinds", _EVIDENCE + ", " + _MERGED.format("") + ", " + _MERGED.format(", tail").replace("m AS", "mt AS").replace("i AS", "it AS").replace("FROM m)", "FROM mt)") + ", t AS (SELECT head, tail, sum(e - s) AS d FROM it GROUP BY head, tail) " + " UNION ALL ".join([
    _ANSWER.format(kind="tail", answer="tail"), _ANSWER.format(kind="head", answer="head"), _ANSWER.format(kind="start", answer="strftime(s, '%Y-%m')"), _ANSWER.format(kind="end", answer="strftime(e, '%Y-%m')"), _ANSWER.format(kind="periods", answer=_SPAN),
    f"SELECT concat(head, '/combined'), string_agg({_SPAN}, ';' ORDER BY s) FROM i GROUP BY head", "SELECT concat(head, '/total'), CAST(CAST(sum(d) AS BIGINT) AS VARCHAR) || ' days' FROM t GROUP BY head", "SELECT concat(head, '/average'), CAST(CAST(floor(sum(d) / count(*)) AS BIGINT) AS VARCHAR) || ' days' FROM t GROUP BY head",
    "SELECT concat(head, '/first'), min((s, tail))[2] FROM u GROUP BY head", "SELECT concat(head, '/last'), max((s, tail))[2] FROM u GROUP BY head", "SELECT DISTINCT concat(head, '/none'), '' FROM u",
]))
def answer_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("tail", "head", "start", "end", "periods", "combined", "total", "average", "first", "last", "none")
    s = supplies(spark, sf)
    role = F.when(F.substring("tail", -1, 1).isin("0", "5"), "anchor").otherwise("search")
    asked = s.withColumn("kind", F.explode(F.array(*map(F.lit, kinds)))).withColumn("qid", F.concat_ws("/", "head", "kind"))
    questions = asked.select("qid", "kind", F.lit("month").alias("granularity")).distinct()
    return answering.answer(questions, asked.where("kind <> 'none'").withColumn("role", role).drop("kind")).select("qid", F.array_join("answers", ";").alias("answers"))


@query("exact_interval_facts", f"""SELECT head, tail, "start" FROM facts WHERE {_SUPPLY} AND "start" = "end" """)
def exact_interval_facts(spark: SparkSession, sf: str) -> DataFrame:
    return answering.membership(supplies(spark, sf), F.col("start"), F.col("start")).select("head", "tail", "start")


# Facts of questions: those of a supplier, twice each, in the order of their time text

_TWICE = f""", s AS (SELECT head AS qid, head, tail, "start", "end", {_STAMP} AS timestamp FROM facts WHERE {_SUPPLY}), f AS (SELECT * FROM s UNION ALL SELECT * FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY timestamp, tail) AS pos FROM (SELECT DISTINCT * FROM f))"""


def twice(spark: SparkSession, sf: str) -> DataFrame:
    s = stamped(supplies(spark, sf)).withColumn("qid", F.col("head"))
    return match.positions(s.unionByName(s), "timestamp", "tail", "start", "end")


@query("flat_context", _TWICE + """ SELECT qid, string_agg(concat(head, ', supplied, ', tail, ', start=', CAST("start" AS VARCHAR), ', end=', CAST("end" AS VARCHAR)), chr(10) ORDER BY pos) AS context FROM p WHERE pos <= 50 GROUP BY qid""")
def flat_context(spark: SparkSession, sf: str) -> DataFrame:
    return rag.flat_facts(twice(spark, sf))


@query("distinct_candidates", _TWICE + """ SELECT qid, tail, "start", "end" FROM p WHERE pos <= 50""")
def distinct_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return curate.distinct_facts(twice(spark, sf)).select("qid", "tail", "start", "end")


@query("numbered_candidates", _TWICE + """ SELECT qid, tail, row_number() OVER (PARTITION BY qid ORDER BY "start", "end", tail) - 1 AS pos FROM p""")
def numbered_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return longs(curate.sorted_candidates(twice(spark, sf)).select("qid", "tail", "pos"), "pos")


@query("anchor_candidates", _TWICE + """, a AS (SELECT *, CAST(ascii(right(tail, 1)) % 2 AS INTEGER) AS anchor_index FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY qid, anchor_index ORDER BY pos) AS n FROM a) SELECT qid, anchor_index, tail FROM n WHERE n <= 20""")
def anchor_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty facts of each of two anchors."""
    one = curate.first_by(twice(spark, sf), ["qid", "tail", "start", "end"], "pos")
    return constraints.anchors_only(one.withColumn("anchor_index", (F.ascii(F.substring("tail", -1, 1)) % 2).cast("int"))).select("qid", "anchor_index", "tail")


@query("parseable_counts", f""", s AS (SELECT head, tail, "start" FROM facts WHERE {_SUPPLY}) SELECT head, count(*) FILTER (right(tail, 1) <> '0') AS parseable_count FROM s GROUP BY head""")
def parseable_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = stamped(supplies(spark, sf)).withColumn("timestamp", F.when(F.substring("tail", -1, 1) == "0", F.lit("some day")).otherwise(F.col("timestamp")))
    return constraints.parseable(s, "head")


@query("earliest_starts", f"""SELECT tail, min("start") AS "start" FROM facts WHERE {_SUPPLY} GROUP BY tail""")
def earliest_starts(spark: SparkSession, sf: str) -> DataFrame:
    return curate.earliest_start(supplies(spark, sf), "tail")


@query("subject_timeline", f""", d AS (SELECT DISTINCT head, tail, "start", "end" FROM facts WHERE {_SUPPLY}), q AS (SELECT head, min((tail, "start", "end")) AS k FROM d GROUP BY head)
SELECT DISTINCT q.head AS qid, d.head, d.tail, d."start", d."end" FROM q JOIN d ON d.head = q.head AND d.tail = q.k[1]""")
def subject_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """All times of the triple of each supplier's alphabetically first supply."""
    s = supplies(spark, sf)
    seeds = curate.first_by(s, ["head"], "tail", "start", "end").withColumns({"qid": F.col("head"), "answer_type": F.lit("timestamp")})
    return match.complete_timeline(seeds, s).select("qid", "head", "tail", "start", "end")


# Records and evaluation, from documents


@query("language_counts", "SELECT coalesce(lang, 'none') AS lang, count(*) AS n FROM documents GROUP BY 1")
def language_counts(spark: SparkSession, sf: str) -> DataFrame:
    return curate.count_by(table(spark, sf, "documents"), "lang", "none")


@query("metadata_differences", "SELECT source, count(DISTINCT lang) > 1 AS lang_differs, count(DISTINCT n_chars % 2) > 1 AS odd_differs FROM documents GROUP BY source")
def metadata_differences(spark: SparkSession, sf: str) -> DataFrame:
    return curate.metadata_flags(table(spark, sf, "documents").withColumn("odd", F.col("n_chars") % 2), "source", "lang", "odd")


@query("relabelled_levels", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND lang = 'en' THEN 'medium' WHEN doc_id % 2 = 0 THEN 'complex' ELSE 'simple' END AS question_level, CASE WHEN doc_id % 2 = 0 AND lang = 'en' THEN 'complex' END AS question_level_original FROM documents""")
def relabelled_levels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "complex").otherwise("simple").alias("question_level"), F.lit("timeline_position_retrieval*3").alias("question_type"),
        F.lit("relation_union_or_intersection").alias("answer_type"), F.when(F.col("lang") == "en", "union").alias("temporal_relation"),
    )
    return curate.complex_to_medium(d).select("doc_id", "question_level", "question_level_original")


@query("level_statuses", """, d AS (SELECT coalesce(lang, 'none') AS question_level, CASE doc_id % 3 WHEN 0 THEN 'ORIGINAL_EXACT' WHEN 1 THEN 'DIFFERENT' ELSE 'NO_REPAIRED_ANSWER' END AS repair_status FROM documents), facts AS (SELECT 1)
SELECT question_level, repair_status, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT x, NULL, 0 FROM (VALUES ('en'), ('no such level')) AS t(x) WHERE x NOT IN (SELECT question_level FROM d)""".replace(", d AS", "WITH d AS", 1))
def level_statuses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 3
    d = table(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("question_level"), F.when(k == 0, "ORIGINAL_EXACT").when(k == 1, "DIFFERENT").otherwise("NO_REPAIRED_ANSWER").alias("repair_status"))
    return programs.levels_by_status(d, ("en", "no such level"))


_PREDICTED = """WITH d AS (SELECT doc_id, coalesce(lang, '_OTHER_') AS lang, CASE doc_id % 5 WHEN 0 THEN ['A ' || source] WHEN 1 THEN ['zz'] WHEN 2 THEN ['n/a'] WHEN 3 THEN [] END AS pred, CASE WHEN doc_id % 7 = 0 THEN [] WHEN doc_id % 7 = 1 THEN NULL ELSE ['a' || source, 'q'] END AS gold FROM documents)"""


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    k, g = F.col("doc_id") % 5, F.col("doc_id") % 7
    none = F.array().cast("array<string>")
    pred = F.when(k == 0, F.array(F.concat(F.lit("A "), F.col("source")))).when(k == 1, F.array(F.lit("zz"))).when(k == 2, F.array(F.lit("n/a"))).when(k == 3, none)
    gold = F.when(g == 0, none).when(g > 1, F.array(F.concat(F.lit("a"), F.col("source")), F.lit("q")))
    return table(spark, sf, "documents").select("doc_id", "lang", pred.alias("pred"), gold.alias("gold"))


@query("baseline_hits", _PREDICTED + """ SELECT doc_id, CASE WHEN pred IS NULL OR gold IS NULL THEN NULL WHEN doc_id % 5 IN (2, 3) AND len(gold) = 0 THEN 1 WHEN doc_id % 5 = 0 AND len(gold) > 0 THEN 1 ELSE 0 END AS hit FROM d""")
def baseline_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hit@1 of short answers without their spaces; no answer for a question without one is a hit."""
    return predicted(spark, sf).select("doc_id", evaluate.baseline_hit(F.col("pred"), F.col("gold")).alias("hit"))


@query("hits_with_gold", _PREDICTED + """ SELECT lang, count(*) AS n, CAST(0 AS BIGINT) AS hits_1 FROM d WHERE len(gold) > 0 GROUP BY GROUPING SETS ((lang), ())""")
def hits_with_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Hits by language over records that have gold answers; spaces count here, so nothing is hit."""
    return evaluate.hits(predicted(spark, sf), "pred", "gold", ["lang"], (1,), skip_without_gold=True).select("lang", "n", "hits_1")


@query("evidence_counts", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 2 * doc_id + 3 END AS before, CASE WHEN doc_id % 2 = 0 THEN n_chars // 2 ELSE doc_id END AS after FROM documents""")
def evidence_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the search for every second question, sums over two anchors for the others."""
    n, k = F.col("n_chars"), F.col("doc_id")
    c = evaluate.evidence_counts(k % 2 == 0, n, F.expr("n_chars div 2"), F.array(k + 1, k + 2), F.array(k, F.lit(0).cast("long")))
    return table(spark, sf, "documents").select("doc_id", c["before"].alias("before"), c["after"].alias("after"))


@query("record_hashes", """SELECT o_orderkey, sha256(concat('{"o_orderkey":', o_orderkey, ',"o_orderpriority":', coalesce('"' || o_orderpriority || '"', 'null'), '}')) AS record_sha256 FROM orders""")
def record_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", X.record_hash("o_orderpriority", "o_orderkey").alias("record_sha256"))


@query("turned_candidates", """SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE c_name END AS head, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE o_orderpriority END AS tail, o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey""")
def turned_candidates(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("head"), F.col("o_orderpriority").alias("tail"), (F.col("o_orderkey") % 2 == 0).alias("swapped"))
    return match.oriented(rows, "swapped").select("head", "tail", "id")


@query("fitting_slots", """SELECT o_orderkey AS id, o_orderkey % 4 < 3 AS fits FROM orders""")
def fitting_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an event has a search triple's known entities, one way or the other."""
    k, head, tail = F.col("o_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit("shop")
    q_head = F.when(k % 4 == 0, head).when(k % 4 == 1, F.lit("?")).when(k % 4 == 2, tail).otherwise(F.lit("nobody"))
    q_tail = F.when(k % 4 == 0, F.lit("?")).when(k % 4 == 1, tail).when(k % 4 == 2, head).otherwise(F.lit("?"))
    return table(spark, sf, "orders").select(k.alias("id"), evaluate.fits_slots(head, tail, q_head, q_tail).alias("fits"))


__all__ = ["ORACLE", "QUERIES"]
