"""Registered queries over the shop's tables, whose keys are skewed and whose rows are repeated, late or broken.

Facts: a delivery is open from the day of its sale to the day of its shipment (head: the vendor, tail: the brand of the item); a visit lasts from a click to its arrival (head: the client).
Rows without a key or with an end before their start are no facts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, intervals
from ..sources import store
from ..sources.pieces import Pieces
from ..sources.store import scratch_folder
from ..streaming import facts as stream
from .workload import _ALLEN_SQL, _ISLANDS, ORACLE, QUERIES, query, table

_DELIVERIES = """deliveries AS (
  SELECT l.vendor_id AS head, l.flag, l.item_id AS item, l.sale_id AS sale, CAST(s.sold_at AS DATE) AS "start", CAST(l.shipped_at AS DATE) AS "end"
  FROM sale_lines l JOIN sales s ON l.sale_id = s.sale_id WHERE l.vendor_id IS NOT NULL AND CAST(s.sold_at AS DATE) <= CAST(l.shipped_at AS DATE)
)"""
_VISITS = """visits AS (SELECT client_id AS head, kind, ts AS "start", arrived_at AS "end" FROM clicks WHERE client_id IS NOT NULL AND ts <= arrived_at)"""


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    lines, sales = table(spark, sf, "sale_lines"), table(spark, sf, "sales").select("sale_id", F.col("sold_at").cast("date").alias("start"))
    lines = lines.where("vendor_id IS NOT NULL").select("sale_id", F.col("vendor_id").alias("head"), "flag", F.col("item_id").alias("item"), F.col("shipped_at").cast("date").alias("end"))
    return lines.join(sales, "sale_id").where("start <= end").select("head", "flag", "item", F.col("sale_id").alias("sale"), "start", "end")


def visits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "clicks").where("client_id IS NOT NULL AND ts <= arrived_at").select(F.col("client_id").alias("head"), "kind", F.col("ts").alias("start"), F.col("arrived_at").alias("end"))


def _sql(source: str, text: str) -> str:
    return f"WITH {source} {text}"


@query("shop_visit_islands", _sql(_VISITS, _ISLANDS.format(keys="head", where="true").replace("FROM facts", "FROM visits") + ' SELECT head, "start", "end" FROM u'))
def shop_visit_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of time in which some click of a client had not arrived, to the microsecond."""
    return intervals.union(visits(spark, sf), "head")


@query("shop_delivery_cover", _sql(_DELIVERIES, _ISLANDS.format(keys="head, flag", where="true").replace("FROM facts", "FROM deliveries") + """
, e AS (SELECT head, "start" AS day, 1 AS step FROM u UNION ALL SELECT head, "end" + 1, -1 FROM u), st AS (SELECT head, day, sum(step) AS step FROM e GROUP BY ALL),
c AS (SELECT head, day, sum(step) OVER (PARTITION BY head ORDER BY day) AS cover, lead(day) OVER (PARTITION BY head ORDER BY day) AS next_day FROM st), n AS (SELECT head, count(DISTINCT coalesce(flag, '~')) AS flags FROM u GROUP BY head)
SELECT head, day AS "start", CAST(next_day - 1 AS DATE) AS "end" FROM c JOIN n USING (head) WHERE cover = flags AND next_day IS NOT NULL"""))
def shop_delivery_cover(spark: SparkSession, sf: str) -> DataFrame:
    """When did a vendor have open deliveries of all its flags at once?"""
    return intervals.intersection(deliveries(spark, sf), "head", "flag")


@query("shop_sale_common", _sql(_DELIVERIES, """SELECT sale, max("start") AS "start", min("end") AS "end" FROM deliveries GROUP BY sale HAVING max("start") <= min("end")"""))
def shop_sale_common(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which all lines of a sale were open."""
    return intervals.common_interval(deliveries(spark, sf), "sale")


@query("shop_open_days", _sql(_DELIVERIES, _ISLANDS.format(keys="head, item", where="true").replace("FROM facts", "FROM deliveries") + """ SELECT head, CAST(sum("end" - "start") AS BIGINT) AS days FROM u GROUP BY head"""))
def shop_open_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days of open deliveries by vendor; overlaps of one item count once."""
    return intervals.total_duration(deliveries(spark, sf), "head", "item")


# Streams


@query("stream_visit_islands", _sql(_VISITS, _ISLANDS.format(keys="head", where="true").replace("FROM facts", "FROM visits") + """
, late AS (SELECT max("start") - INTERVAL 4 DAY AS mark FROM visits)
SELECT head, "start", "end" FROM u, late WHERE "end" < mark"""))
def stream_visit_islands(spark: SparkSession, sf: str) -> DataFrame:
    """``shop_visit_islands`` from a stream that brings clicks in the order of their arrival: islands that the last watermark has closed."""
    folder = scratch_folder(spark)
    clicks = table(spark, sf, "clicks").select("client_id", "ts", "arrived_at")
    arriving = stream.replay(clicks, "arrived_at", f"{folder}/clicks").where("client_id IS NOT NULL")
    facts = arriving.select(F.col("client_id").alias("head"), F.col("ts").alias("start"), F.col("arrived_at").alias("end"))
    return stream.collected(stream.islands(facts, "head", late="4 days"), folder).select("head", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))


# Stored facts

_ORDERED = """ordered AS (SELECT 'client ' || client_id AS head, status AS relation, 'priority ' || priority AS tail, CAST(sold_at AS DATE) AS "start", CAST(arrived_at AS DATE) AS "end" FROM sales WHERE client_id IS NOT NULL AND sold_at <= arrived_at)"""


@query("stored_facts_match", _sql(_ORDERED, """, p AS (SELECT DISTINCT head FROM ordered WHERE tail = 'priority 5')
SELECT head AS qid, head, relation, tail, "start", "end" FROM ordered JOIN p USING (head) WHERE relation = 'open' AND "start" <= DATE '2024-03-10' AND "end" >= DATE '2024-02-20'"""))
def stored_facts_match(spark: SparkSession, sf: str) -> DataFrame:
    """Orders saved as a store, loaded again and matched: what was open around the turn of February for each client that has ever had priority 5."""
    sales = table(spark, sf, "sales").where("client_id IS NOT NULL AND sold_at <= arrived_at")
    text = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    facts = sales.select(text("client ", "client_id").alias("head"), F.col("status").alias("relation"), text("priority ", "priority").alias("tail"), F.col("sold_at").cast("date").alias("start"), F.col("arrived_at").cast("date").alias("end"))
    folder = scratch_folder(spark)
    store.save_facts(facts, folder)
    p = facts.where("tail = 'priority 5'").select(F.col("head").alias("qid"), "head", F.lit("open").alias("relation"), F.lit(None).cast("string").alias("tail")).distinct()
    return store.load_facts(spark, folder).of_heads(p, dt.date(2024, 2, 20), dt.date(2024, 3, 10))


# Work in pieces


@query("resumed_pieces", "SELECT sale_id, status, CAST(round(total * 100) AS BIGINT) AS cents FROM sales")
def resumed_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Totals in cents by a job in pieces: a first start does the open sales, a second one what is left, and compaction keeps one result of each."""
    sales = table(spark, sf, "sales").select("sale_id", "status", "total")
    schema = sales.select("sale_id", "status", F.lit(0).cast("long").alias("cents")).schema
    cents = lambda rows, _: rows.withColumn("cents", F.round(F.col("total") * 100).cast("long"))
    work = Pieces(spark, scratch_folder(spark), "sale_id", schema, pieces=4)
    work.run(sales.where("status = 'open'"), cents)
    work.run(sales, cents)
    return work.compact(scratch_folder(spark)).results()


# Any-match: deliveries against all swapped deliveries of the same vendor

_MATCH = """
, a AS (SELECT DISTINCT head, "start" AS ys, "end" AS ye FROM deliveries WHERE flag = 'swapped')
SELECT head, item, sale, count(*) AS lines FROM deliveries d WHERE EXISTS (SELECT 1 FROM a WHERE a.head = d.head AND ({})) GROUP BY ALL"""


def _match_query(name: str, sql: str, **options) -> None:
    @query(name, _sql(_DELIVERIES, _MATCH.format(sql)))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = deliveries(spark, sf).withColumnRenamed("head", "qid")
        anchors = d.where("flag = 'swapped'")
        met = constraints.any_match(d, anchors, **options) if "allen" not in options else constraints.any_interval_match(d, anchors, options["allen"])
        return met.groupBy(F.col("qid").alias("head"), "item", "sale").agg(F.count(F.lit(1)).alias("lines"))


_match_query("shop_before_any", '"end" < ys', relation="before")
_match_query("shop_after_any", '"start" > ye', relation="after")
_match_query("shop_inside_any", '"start" >= ys AND "end" <= ye', relation="inside")
_match_query("shop_overlap_any", '"start" <= ye AND "end" >= ys', relation="overlap")
_match_query("shop_equal_month_any", """date_trunc('month', "start") <= date_trunc('month', ye) AND date_trunc('month', "end") >= date_trunc('month', ys)""", relation="equal", granularity="month")
_match_query("shop_offset_any", """(ys + INTERVAL 45 DAY BETWEEN "start" AND "end") OR (ye + INTERVAL 45 DAY BETWEEN "start" AND "end")""", relation="after", offset_days=45)
for _name in ("overlaps", "contains", "meets"):
    _match_query(f"shop_{_name}_any", _ALLEN_SQL[_name].replace("xs", '"start"').replace("xe", '"end"'), allen=_name)


def _count_query(relation: str) -> None:
    @query(f"shop_{relation}_counts", _sql(_DELIVERIES, f"""
    , s AS (SELECT head, "start" AS xs, "end" AS xe, count(*) AS n FROM deliveries GROUP BY ALL), t AS (SELECT head, xs AS ys, xe AS ye, n AS m FROM s)
    SELECT head, CAST(sum(n * m) AS BIGINT) AS pairs FROM s JOIN t USING (head) WHERE {_ALLEN_SQL[relation]} GROUP BY head"""))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """All deliveries of a vendor against all of it, by counts."""
        met = intervals.relation_counts(deliveries(spark, sf), "head", relation).where("matches > 0")
        return met.groupBy("head").agg(F.sum(F.col("n") * F.col("matches")).alias("pairs"))


for _name in ("during", "overlaps"):
    _count_query(_name)

__all__ = ["ORACLE", "QUERIES"]
