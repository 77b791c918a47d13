"""Vector search and similarity joins of triples.

The vocabulary is packed into chunks and the queries into blocks; a join row is one chunk and one block, and its products are searched in Arrow,
so that no join emits pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block, queries of one product, bytes of a chunk of vectors, bytes of all queries that are broadcast, and keys of a block beyond that.
BLOCK, STRIP, CHUNK_BYTES, BROADCAST_BYTES, SALTS = 512, 64, 1 << 20, 32 << 20, 64


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def normalized(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors as rows of ``dim`` doubles; missing components are 0."""
    flat, lengths = vectors.flatten().fill_null(0.0).to_numpy(zero_copy_only=False), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(vectors), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, added component by component like ``dot``, so that equal vectors have equal scores."""
    total, term = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        np.multiply(x[:, None], y[None, :], out=term)
        total += term
    return total


def _chunks(vocabulary: DataFrame) -> DataFrame:
    """Rows (id, v) packed where they lie into rows of arrays (ids, vs), each of about ``CHUNK_BYTES``."""
    id_type = vocabulary.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = max(1, pc.max(pc.list_value_length(batch.column("v"))).as_py() or 1)
            step = max(1, CHUNK_BYTES // (8 * dim))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                whole = [pa.array([0, part.num_rows], pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(*whole, pa.concat_arrays([part.column(c)])) for c in ("id", "v")], names=["ids", "vs"])

    return vocabulary.select("id", F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL").mapInArrow(run, f"ids array<{id_type}>, vs array<array<double>>")


def scores(queries: DataFrame, vocabulary: DataFrame, block: int = BLOCK, least: float | None = None, k: int | None = None) -> DataFrame:
    """(query_id, id, score) from queries (query_id, v) and a vocabulary (id, v): every pair, those of ``least`` or more, or what can be among a query's ``k`` best.

    Chunks of the vocabulary meet blocks of queries, and only what is asked for leaves a product: with ``k``, at most that many rows for each chunk and query,
    ties to smaller ids. Blocks are broadcast while all queries have ``BROADCAST_BYTES`` at most; beyond that larger blocks are joined with the chunks over salted keys.
    Null vectors take no part; vectors should be finite.
    """
    known = queries.where("v IS NOT NULL").select("query_id", F.col("v").cast("array<double>").alias("v"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v").cast("long") * 8 + 32).alias("bytes")).first()
    small = (size["bytes"] or 0) <= BROADCAST_BYTES
    n = max(1, -(-size["n"] // (block if small else 16 * block)))
    salts = 1 if small else SALTS
    types = [f.dataType.simpleString() for f in (queries.schema["query_id"], vocabulary.schema["id"])]
    blocks = known.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("_b")).agg(F.collect_list(F.struct("query_id", "v")).alias("_q"))
    blocks = blocks.select("_b", F.col("_q.query_id").alias("qids"), F.col("_q.v").alias("qs"))
    spread = _chunks(vocabulary).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if small:
        met = spread.join(F.broadcast(blocks), "_b")
    else:
        salted = blocks.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = spread.withColumn("_s", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).join(salted, ["_b", "_s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, vs, qids, qs = (batch.column(c).slice(at, 1).flatten() for c in ("ids", "vs", "qids", "qs"))
                dim = max(1, *(int(pc.max(pc.list_value_length(x)).as_py() or 0) for x in (vs, qs)))
                order = pc.sort_indices(ids)
                ids, left = ids.take(order), _matrix(vs, dim)[order.to_numpy()]
                right = _matrix(qs, dim)
                for lo in range(0, len(right), STRIP):
                    found = _products(left, right[lo : lo + STRIP])
                    if k is not None:
                        rows = np.argsort(-found, axis=0, kind="stable")[:k]
                        r, c = rows.T.ravel(), np.repeat(np.arange(found.shape[1]), len(rows))
                    else:
                        r, c = np.nonzero(np.ones_like(found, bool) if least is None else found >= least)
                    score = found[r, c]
                    if k is not None and least is not None:
                        r, c, score = r[score >= least], c[score >= least], score[score >= least]
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(c + lo)), ids.take(pa.array(r)), pa.array(score)], names=["query_id", "id", "score"])

    return met.select("ids", "vs", "qids", "qs").mapInArrow(run, f"query_id {types[0]}, id {types[1]}, score double")


def top_k(queries: DataFrame, vocabulary: DataFrame, k: int = 64, threshold: float | None = None) -> DataFrame:
    """The k best of each query, ties to the smaller id; the threshold is inclusive and comes after the cut."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores(queries, vocabulary, least=threshold, k=k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def within(queries: DataFrame, vocabulary: DataFrame, threshold: float) -> DataFrame:
    """All of each query above a threshold (exclusive)."""
    return scores(queries, vocabulary, least=threshold).where(F.col("score") > threshold)


def prune_confident(found: DataFrame, key: str = "query_id", score: str = "score", trigger: float = 0.9, keep: float = 0.9) -> DataFrame:
    """Where a query's best is above ``trigger``, only what reaches ``keep`` stays."""
    best = F.max(score).over(Window.partitionBy(key))
    return found.withColumn("_best", best).where((F.col("_best") <= trigger) | (F.col(score) >= keep)).drop("_best")


def similar_triples(slots: dict[str, DataFrame | None], facts: DataFrame, prune: bool = False) -> DataFrame:
    """Facts whose three slots are all among a question's candidates.

    ``slots`` maps head, relation and tail to (qid, name, sim), or to None where the slot is unknown for all questions (it then matches everything at 1).
    """
    known = {s: prune_confident(df, "qid", "sim") if prune else df for s, df in slots.items() if df is not None}
    out = facts
    for n, (slot, df) in enumerate(known.items()):
        side = df.select("qid", F.col("name").alias(slot), F.col("sim").alias(f"{slot[0]}_sim"))
        out = out.join(side, [slot] if n == 0 else ["qid", slot])
    for slot in slots:
        if slot not in known:
            out = out.withColumn(f"{slot[0]}_sim", F.lit(1.0))
    return out.withColumn("score_sum", F.col("h_sim") + F.col("r_sim") + F.col("t_sim"))


def relax(branches: list[DataFrame], key: str = "qid") -> DataFrame:
    """Prioritised searches (threshold then direction): for each triple, the first that finds anything."""
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [b.withColumn("branch", F.lit(k)) for k, b in enumerate(branches)])
    return tagged.withColumn("_least", F.min("branch").over(Window.partitionBy(key))).where("branch = _least").drop("_least")


def swap_cascade(found: DataFrame, swapped: DataFrame, high: float = 0.4, low: float = 0.2) -> DataFrame:
    """Forward at the high threshold, swapped at the high, forward at the low, swapped at the low; from scored candidates of both directions."""
    at = lambda df, t, turn: df.where(F.col("score") >= t).withColumn("swapped", F.lit(turn))
    steps = [at(found, high, False), at(swapped, high, True)]
    if high != low:
        steps += [at(found, low, False), at(swapped, low, True)]
    return relax(steps, "query_id")


def search_orientation(anchors: Column, search: Column, similarity: Column | None = None, threshold: float = 0.9) -> Column:
    """Whether the search triple should be turned: some anchor speaks for it and none against it.

    An anchor with the same relation (or one more similar than ``threshold``, given as a map) votes by where the known entity of the search stands.
    """
    known = F.when(search["head"] == "?", search["tail"]).otherwise(search["head"])
    as_head = search["head"] != "?"
    same = lambda a: (a["relation"] == search["relation"]) | (F.coalesce(F.try_element_at(similarity, a["relation"]), F.lit(0.0)) > threshold if similarity is not None else F.lit(False))
    agree = F.exists(anchors, lambda a: same(a) & F.when(as_head, a["head"] == known).otherwise(a["tail"] == known))
    differ = F.exists(anchors, lambda a: same(a) & F.when(as_head, a["tail"] == known).otherwise(a["head"] == known))
    return differ & ~agree
