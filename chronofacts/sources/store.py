"""Facts stored for matching: partitioned by the year in which they start, bucketed by head.

A pattern with a known head meets the facts bucket by bucket, without an exchange on their side; a condition on time reads only the years that can hold a
match. A fact may last longer than its year, so the store keeps, for each year, the latest end of its facts: a year is read for a range of days if it begins no later than the range ends
and its latest end is not before the range's start. That summary has one row a year and is what the driver gets.

Facts without a start are stored under year null and match no range; a null head matches no pattern. An empty set of facts gives an empty store.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .facts import _shared_folder

COLUMNS = "head string, relation string, tail string, start date, end date"


@dataclass(frozen=True)
class FactStore:
    """``table``: the catalog's name for the stored facts; ``years``: (year, latest end) of each."""

    spark: SparkSession
    table: str
    years: tuple[tuple[int, dt.date | None], ...]

    def facts(self) -> DataFrame:
        return self.spark.table(self.table).drop("year")

    def within(self, first: dt.date, last: dt.date) -> DataFrame:
        """Facts that overlap the days from ``first`` to ``last``; only years that can hold one are read."""
        years = [y for y, latest in self.years if y <= last.year and latest is not None and latest >= first]
        found = self.spark.table(self.table).where(F.col("year").isin(years) if years else F.lit(False))
        return found.where((F.col("start") <= F.lit(last)) & (F.col("end") >= F.lit(first))).drop("year")

    def of_heads(self, patterns: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """Facts of each pattern (qid, head, and relation or tail, which may be null), overlapping the days if they are given."""
        f = self.facts() if first is None or last is None else self.within(first, last)
        p = patterns.select("qid", "head", F.col("relation").alias("_relation"), F.col("tail").alias("_tail"))
        free = lambda c: F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c))
        return f.join(p, "head").where(free("relation") & free("tail")).select("qid", "head", "relation", "tail", "start", "end")


def _bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def save_facts(facts: DataFrame, folder: str, buckets: int | None = None) -> None:
    """Write head, relation, tail, start and end of ``facts`` under ``folder``; ``summary`` comes last and marks the store as whole."""
    spark = facts.sparkSession
    n = buckets or _bucket_count(spark)
    rows = facts.select("head", "relation", "tail", "start", "end").withColumn("year", F.year("start"))
    # One file for each bucket and year: rows of a bucket stand in one task each.
    name = f"facts_{uuid.uuid4().hex}"
    dealt = rows.repartition(n, "head").sortWithinPartitions("year", "head", "start")
    dealt.write.format("parquet").mode("overwrite").partitionBy("year").bucketBy(n, "head").sortBy("head").option("path", f"{folder}/facts").saveAsTable(name)
    summary = spark.table(name).groupBy("year").agg(F.max("end").alias("latest"), F.count(F.lit(1)).alias("facts"))
    summary.withColumn("buckets", F.lit(n)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/summary")
    spark.sql(f"DROP TABLE {name}")


def load_facts(spark: SparkSession, folder: str) -> FactStore:
    """The store under ``folder``; fails if it is not whole."""
    summary = spark.read.parquet(f"{folder}/summary").collect()
    table = f"facts_{uuid.uuid4().hex}"
    buckets = summary[0].buckets if summary else 1
    spark.sql(f"CREATE TABLE {table} ({COLUMNS.replace('start', '`start`').replace('end', '`end`')}, year int) USING parquet PARTITIONED BY (year) CLUSTERED BY (head) SORTED BY (head) INTO {buckets} BUCKETS LOCATION '{folder}/facts'")
    spark.sql(f"MSCK REPAIR TABLE {table}")
    return FactStore(spark, table, tuple((r.year, r.latest) for r in summary if r.year is not None))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{_shared_folder(spark)}/stores/{uuid.uuid4().hex}"
