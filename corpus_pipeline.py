"""A corpus pipeline of four stages: toxicity, near-duplicates, benchmark decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns a DataFrame; all but the last keep the
columns of ``documents``. ``run`` chains them, writing each stage's rows to the shared folder first, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofacts.llm import decontaminate as benchmarks
from chronofacts.llm import sentencepiece_scan, simhash, toxicity
from chronofacts.llm.common import parquet, stored


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those of ``docs`` that ``labels`` covers, rejects are gone."""
    return toxicity.keep_clean(docs, parquet(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id stays; five-word shingles, a similarity of 0.8 or more (``simhash.SIMILAR``)."""
    return simhash.deduplicate(docs, simhash.SIMILAR)


def remove_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item are gone."""
    return benchmarks.decontaminate(docs, parquet(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian 32-bit integers) of every document left."""
    encoded, ids = sentencepiece_scan.encode(docs)
    return encoded.select("doc_id", "lang", "source", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.col(ids).alias("ids"))


STAGES = [("toxicity", remove_toxic), ("near_duplicates", remove_near_duplicates), ("decontamination", remove_benchmark_text), ("tokenization", tokenize)]

#: SQL expresses neither the classifier nor the fingerprints; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = parquet(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs)
    return docs
