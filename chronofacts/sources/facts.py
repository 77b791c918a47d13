"""Fact files, question files, artefact tables and sinks."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.timeparse import make_timestamp, strip

CONTAINER_KEYS = ("data", "samples", "records", "items")


@dataclass(frozen=True)
class DatasetPaths:
    """Where a dataset's files lie under one root."""

    root: str
    name: str

    @property
    def facts(self) -> str:
        return f"{self.root}/{self.name}/kg/full.txt"

    @property
    def questions(self) -> str:
        return f"{self.root}/{self.name}/questions/test.json"


def parse_facts(lines: DataFrame, column: str = "value") -> DataFrame:
    """head, relation, tail, start, end, timestamp and parse_error of lines with 4 or 5 tab-separated parts.

    Blank lines and lines that begin with ``#`` are left out. Four parts are a point whose date must be ISO; five are an interval, unchecked.
    """
    line = strip(F.col(column))
    kept = lines.withColumn("_line", line).where((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    parts = F.transform(F.split("_line", "\t"), strip)
    n = F.size("_parts")
    part = lambda k: F.get("_parts", F.lit(k))
    bad = (n != 4) & (n != 5) | ((n == 4) & F.try_to_date(part(3), "yyyy-MM-dd").isNull())
    end = F.when(n == 5, part(4)).otherwise(part(3))
    return kept.withColumn("_parts", parts).select(
        *(X.clean_token(part(k)).alias(name) for k, name in enumerate(("head", "relation", "tail"))), part(3).alias("start"), end.alias("end"),
        make_timestamp(part(3), end).alias("timestamp"), F.when(bad, F.lit("not a fact line")).alias("parse_error"),
    )


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return parse_facts(spark.read.text(path))


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON file: a list, one object, or an object that holds the list under one of ``CONTAINER_KEYS`` (the first that is a list)."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        item = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        wrapped = T.StructType([T.StructField(k, T.ArrayType(item)) for k in CONTAINER_KEYS] + list(item.fields))
        rows = reader.schema(wrapped).json(path)
        own = F.array(F.struct(*(F.col(f.name) for f in item.fields)))
        return rows.select(F.explode(F.coalesce(*(F.col(k) for k in CONTAINER_KEYS), own)).alias("r")).select("r.*")
    rows = reader.json(path)
    for key in CONTAINER_KEYS:
        if key in rows.columns and isinstance(rows.schema[key].dataType, T.ArrayType):
            return rows.select(F.explode(key).alias("r")).select("r.*")
    return rows


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def latest_shards(rows: DataFrame, key: str = "idx", shard: str = "shard") -> DataFrame:
    """Of checkpointed rows, the last for each key; rows without a key or data are left out."""
    order = Window.partitionBy(key).orderBy(F.desc(shard))
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def resume_from(spark: SparkSession, source: str, checkpoint: str, resume: bool = True) -> DataFrame:
    """The checkpoint table if it can be read and resuming is wanted, else the input."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(checkpoint) if resume and there else read_records(spark, source)


def load_settings(text: str, required: tuple[str, ...] = ()) -> dict[str, str]:
    """``KEY=value`` lines; fails at once if a required key is missing."""
    pairs = (line.strip().removeprefix("export ").partition("=") for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    found = {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}
    if missing := [k for k in required if not found.get(k)]:
        raise KeyError(f"missing settings: {', '.join(missing)}")
    return found


def vocabulary(values: DataFrame, column: str, id_name: str) -> DataFrame:
    """Distinct values with their rank in code-point order, from 0.

    Distributed: values are range-partitioned, counted by partition, and each partition numbers its own; no task sees all of them. The ranged rows are
    stored, as a row must keep its partition's number.
    """
    names = values.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()
    ranged = stored_table(names.repartitionByRange("name").sortWithinPartitions("name").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("_p").orderBy("name")
    return ranged.join(F.broadcast(before), "_p").select("name", (F.col("_before") + F.row_number().over(within) - 1).alias(id_name))


def entities(facts: DataFrame) -> DataFrame:
    """vid, name and node_id of all heads and tails."""
    both = facts.select(F.col("head").alias("name")).union(facts.select("tail"))
    return vocabulary(both, "name", "vid").withColumn("node_id", X.short_id(F.col("name"), "ent_"))


def relations(facts: DataFrame) -> DataFrame:
    return vocabulary(facts, "relation", "relation_id").withColumnRenamed("name", "relation")


def timestamps(facts: DataFrame, column: str = "timestamp") -> DataFrame:
    return vocabulary(facts, column, f"{column}_id").withColumnRenamed("name", column)


def occurrences(facts: DataFrame, *order: str) -> DataFrame:
    """``occurrence``: how often the same fact has stood before, in the given order."""
    w = Window.partitionBy("head", "relation", "tail", "start", "end").orderBy(*order)
    return facts.withColumn("occurrence", F.row_number().over(w) - 1)


def with_edge_ids(facts: DataFrame) -> DataFrame:
    key = F.concat_ws("|", "head", "relation", "tail", F.col("start").cast("string"), F.col("end").cast("string"), F.col("occurrence").cast("string"))
    return facts.withColumn("edge_id", X.short_id(key, "evt_"))


def build_graph(facts: DataFrame, *order: str) -> dict[str, DataFrame]:
    """The artefact tables of a fact set: entities, relations, timestamps and facts with all ids."""
    ents, rels, times = entities(facts), relations(facts), timestamps(facts)
    ids = with_edge_ids(occurrences(facts, *order))
    node = ents.select(F.col("name"), "node_id")
    full = (
        ids.join(rels, "relation").join(times, "timestamp", "left")
        .join(node.toDF("head", "src_node_id"), "head").join(node.toDF("tail", "dst_node_id"), "tail")
    )
    return {"entities": ents, "relations": rels, "timestamps": times, "facts": full}


def save_graph(tables: dict[str, DataFrame], folder: str, embedding_dim: int | None = None, normalize: bool = True) -> bool:
    """Write the tables as Parquet, the vocabularies as CSV too, and ``meta`` last; does nothing where ``meta`` is already there."""
    spark = next(iter(tables.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        if name != "facts":
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_csv")
    counts = {n: spark.read.parquet(f"{folder}/{n}").count() for n in tables}
    row = [(embedding_dim, normalize, "cosine" if normalize else "l2", counts, {n: f"{folder}/{n}" for n in tables})]
    spark.createDataFrame(row, "embedding_dim int, normalize boolean, metric string, counts map<string,bigint>, files map<string,string>").write.mode("overwrite").json(f"{folder}/meta")
    return True


def load_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that ``meta`` lists; fails if one is missing."""
    meta = spark.read.json(f"{folder}/meta").first()
    return {n: spark.read.parquet(p) for n, p in meta.files.asDict().items()}


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def report_table(df: DataFrame, digits: int = 3, most: int = 10_000) -> str:
    """A small result as an aligned text table with rounded numbers. For reports: the rows are collected; more than ``most`` are an error."""
    shown = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    rows = [df.columns, *([shown(x) for x in r] for r in found)]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in rows)


def core_fields(cases: DataFrame, fields: tuple[str, ...] = ("id", "question", "answer", "events", "question_level", "question_type", "answer_type", "temporal_relation", "qtype")) -> DataFrame:
    """The fields that a cleaned dataset keeps; null lists become empty."""
    empty = F.array().cast("array<string>")
    return cases.select(*(F.coalesce(F.col(f), empty).alias(f) if f in ("answer", "events") else F.col(f) if f in cases.columns else F.lit(None).cast("string").alias(f) for f in fields))


def base_name(path: str) -> str:
    return PurePosixPath(path).stem


def point_column(df: DataFrame) -> Column:
    return df["start"] == df["end"]


def _shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local master may go without the setting; then a temporary folder is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; what is built on it is planned and recomputed from there."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored_table(df: DataFrame) -> DataFrame:
    """``stored`` as Parquet, for many narrow rows: a fraction of a checkpoint's size, and later reads take the columns they need."""
    path = f"{_shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
