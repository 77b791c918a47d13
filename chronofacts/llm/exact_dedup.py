"""Exact duplicates by sorting content.

Each text is normalised (A-Z lower-cased, nothing else) and moves once: a range exchange, whose splitters Spark samples, deals the rows out by the
first bytes of the normalised text, its SHA-256, the identifier and a tie, so a splitter is short however long the texts are, and a group of
copies that is too large for one range is cut inside. An external sort then puts equal bytes next to each other, and every text is compared in
full with its neighbour. A run of equal texts is a group; its first row, in the order asked for, stays. Runs that touch an end of
their range may go on in the next one: of each such run one row (two for a range at most, however many rows it has) is added up by
SHA-256 and broadcast to its rows. Memory in a task: a batch of texts, and identifiers of one run.

Nulls: a null text counts as empty; null identifiers stand behind all others, so such a row stays only where its group has no other. Repeated rows (equal
text and identifier): one of them stays, the one whose place in the stored table comes last (``largest``) or first. An empty table gives an empty result.
Further columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, give_back, slices, stored, utf8

#: Leading bytes of a normalised text by which ranges are cut, before its hash.
HEAD = 16
#: Lower-cases the bytes A-Z; UTF-8 has them in no other character.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KEYS = T.StructType([T.StructField("head", T.BinaryType()), T.StructField("sha", T.BinaryType()), T.StructField("norm", T.BinaryType())])


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, id, tie) as (head, sha, norm, id, tie)."""
    for batch in batches:
        for part in slices(batch, 0):
            norm = [(t or b"").translate(LOWER) for t in utf8(part, 0)]
            keys = [[t[:HEAD] for t in norm], [hashlib.sha256(t).digest() for t in norm], norm]
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.binary()) for k in keys), part.column(1), part.column(2)], names=["head", "sha", "norm", "id", "tie"])
    give_back()


def _whole_runs(rows: list[pa.RecordBatch], starts: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
    """The rows (sha, id, tie) of whole runs that begin at ``starts``, with what their run amounts to; ``edge``: of each run."""
    table = pa.Table.from_batches(rows).combine_chunks()
    sha, ident, tie = (table.column(k).combine_chunks() for k in range(3))
    lengths = np.diff(np.append(starts, table.num_rows))
    first = pa.array(np.repeat(starts, lengths))
    lead = np.zeros(table.num_rows, bool)
    lead[starts] = True
    columns = [sha, ident, tie, ident.take(first), tie.take(first), pa.array(np.repeat(lengths, lengths)), pa.array(lead), pa.array(np.repeat(edge, lengths))]
    return pa.RecordBatch.from_arrays(columns, names=["sha", "id", "tie", "keep_id", "keep_tie", "n", "lead", "edge"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (norm, sha, id, tie) of one range as rows of their runs; the first and last run of the range are marked as its edges."""
    before, held, none_yet = None, [], True
    for batch in batches:
        if not batch.num_rows:
            continue
        norm, rows = batch.column(0), pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
        fresh = np.ones(batch.num_rows, bool)
        fresh[0] = before is None or norm[0].as_py() != before
        fresh[1:] = pc.not_equal(norm.slice(1), norm.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        before = norm[batch.num_rows - 1].as_py()
        starts = np.flatnonzero(fresh)
        if not len(starts):
            held.append(rows)
            continue
        held.append(rows.slice(0, starts[0]))
        if sum(r.num_rows for r in held):
            yield _whole_runs(held, np.zeros(1, int), np.array([none_yet]))
            none_yet = False
        if len(starts) > 1:
            inner = starts[:-1] - starts[0]
            yield _whole_runs([rows.slice(starts[0], starts[-1] - starts[0])], inner, (inner == 0) & none_yet)
            none_yet = False
        held = [rows.slice(starts[-1])]
    if held:
        yield _whole_runs(held, np.zeros(1, int), np.ones(1, bool))
    give_back()


def _judged(docs: DataFrame, text: str, doc_id: str, tie: Column, keep: str) -> DataFrame:
    """One row for each of ``docs``: sha, id, tie, keep_id, keep_tie and n of its group."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    largest = keep == "largest"
    kind = docs.schema[doc_id].dataType
    ids = [T.StructField("id", kind), T.StructField("tie", T.LongType())]
    keyed = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id"), tie.alias("tie")).mapInArrow(_normalised, T.StructType([*_KEYS.fields, *ids]))
    inside = [F.desc_nulls_last("id"), F.desc("tie")] if largest else [F.asc_nulls_last("id"), F.asc("tie")]
    ordered = keyed.repartitionByRange("head", "sha", *inside).sortWithinPartitions("head", "sha", "norm", *inside)
    out = T.StructType([
        T.StructField("sha", T.BinaryType()), *ids, T.StructField("keep_id", kind), T.StructField("keep_tie", T.LongType()), T.StructField("n", T.LongType()), T.StructField("lead", T.BooleanType()), T.StructField("edge", T.BooleanType()),
    ])
    rows = stored(ordered.select("norm", "sha", "id", "tie").mapInArrow(_runs, out))
    # At most two rows for each range, so the broadcast grows with the number of ranges alone.
    lacks = F.col("keep_id").isNull()
    best = F.max(F.struct(~lacks, "keep_id", "keep_tie")) if largest else F.min(F.struct(lacks, "keep_id", "keep_tie"))
    edges = rows.where("edge AND lead").groupBy(F.col("sha").alias("edge_sha")).agg(F.sum("n").alias("all"), best.alias("best"))
    met = rows.join(F.broadcast(edges), F.col("edge") & (F.col("sha") == F.col("edge_sha")), "left")
    over = lambda a, b: F.when(F.col("edge"), F.col(a)).otherwise(F.col(b)).alias(b)
    return met.select("sha", "id", "tie", over("best.keep_id", "keep_id"), over("best.keep_tie", "keep_tie"), over("all", "n"))


def duplicate_report(docs: DataFrame, keep: str = "largest", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256 of the normalised text."""
    judged = _judged(docs, text, doc_id, F.monotonically_increasing_id(), keep)
    return judged.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), (F.col("tie") == F.col("keep_tie")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, keep: str = "smallest", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with all their columns, one row of each group. Rows are numbered and stored first, so identifiers may repeat or be null."""
    row = fresh_name(docs, "row_number")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    stay = _judged(numbered, text, doc_id, F.col(row), keep).where("tie = keep_tie").select(F.col("tie").alias(row))
    return numbered.join(stay, row, "left_semi").select(*(F.col(c) for c in docs.columns))
