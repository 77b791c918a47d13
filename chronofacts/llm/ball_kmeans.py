"""Exact k-means with balls (ball k-means), in whole numbers.

A cluster is a ball: its centroid and a radius that holds all members. Only a cluster whose centroid is nearer than twice the radius can take a member away, so
these are the neighbours; the driver finds them from the k centroids and k radii. A member closer to its centroid than half the way to the nearest neighbour is in the
stable core and is compared with nothing. The others lie in annuli: neighbours in order of distance, the j-th annulus between half the way to the j-th and
half the way to the next; a member there is compared with the first j neighbours only, exactly, ties to the smaller number. All tests are between squared whole numbers, so
they hold exactly; only a ball's radius after its centroid moved is an upper bound (old radius plus shift, rounded up), which can add a neighbour and not lose one.

Spark holds the vectors in blocks (one row for each Arrow batch: identifiers, components, cluster). A round is one pass over the blocks, whose tasks send k rows of
sums, counts and radii each; they are added up in Spark, and the driver gets k of them. Every round's blocks are stored in the shared folder, so a lost executor repeats a part of
one round. A cluster with any share of the rows costs no more than others: nothing is grouped by cluster but the sums.

Nulls: vectors that are null, of another length, or that hold a null or a non-finite component take no part. Null identifiers are kept and come last in the choice of first
centroids, as text '2:'. Ties in that choice (repeated identifiers) go to the smaller vector. Repeated rows are rows of their own. With fewer than ``k`` vectors each is a first centroid; an empty table
gives an empty result. Components beyond 2^52 raise an error, as do a squared distance or a sum of them that no long can hold. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Components up to this give squared distances and block sums that doubles hold exactly (for DIMENSIONS of them); larger ones are computed with Python's whole numbers.
SMALL = 1 << 21
LARGEST = 1 << 52
#: Rows of a block at most, as Arrow's batches are larger.
BLOCK_ROWS = 8192


@dataclass
class Balls:
    """Centroids, the ball radius of each (from above) and, for each, its neighbours by distance with their squared distances."""

    centroids: list[list[int]]
    radius: list[float]
    neighbours: list[tuple[np.ndarray, np.ndarray]]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exactly: both are float64 within ``SMALL``, or Python numbers."""
    d = a - b
    return (d * d).sum(axis=-1)


def balls(centroids: list[list[int]], radius: list[float]) -> Balls:
    """k centroids are compared with each other: k is a parameter and does not grow with the input."""
    c = np.array(centroids, dtype=object)
    neighbours = []
    for i in range(len(c)):
        d = _squared(c, c[i])
        # sqrt(d) < 2 * radius, with room for rounding; equal distances can tie, so they count.
        near = [j for j in range(len(c)) if j != i and math.sqrt(d[j]) <= 2 * radius[i] * (1 + 1e-9) + 1e-9]
        near.sort(key=lambda j: d[j])
        neighbours.append((np.array(near, dtype=np.int64), np.array([d[j] for j in near], dtype=object)))
    return Balls(centroids, radius, neighbours)


def _matrix(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as numbers in which squared distances are exact."""
    most = max(int(np.abs(vectors).max(initial=0)), max((abs(x) for c in centroids for x in c), default=0))
    kind = np.float64 if most <= SMALL and vectors.shape[1] <= DIMENSIONS else object
    return vectors.astype(kind), np.array(centroids, dtype=object).astype(kind)


def assign(vectors: np.ndarray, cluster: np.ndarray, found: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """New cluster and squared distance of each vector (int64 rows), and how many distances were computed; ``cluster`` -1: not in a ball yet, compared with all."""
    x, c = _matrix(vectors, found.centroids)
    out, best, work = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype), 0
    for own in np.unique(cluster):
        rows = np.flatnonzero(cluster == own)
        start = max(int(own), 0)
        own_d = _squared(x[rows], c[start])
        now, d, work = np.full(len(rows), start), own_d.copy(), work + len(rows)
        others, gap = (np.arange(1, len(c)), None) if own < 0 else found.neighbours[own]
        for j, k in enumerate(others):
            # Beyond half the way to k or on it (4 d^2 >= gap^2), where k can be as near; neighbours further away have larger gaps.
            at = np.arange(len(rows)) if gap is None else np.flatnonzero(own_d * 4 >= (float(gap[j]) if x.dtype != object else gap[j]))
            if not len(at):
                break
            dk = _squared(x[rows[at]], c[k])
            work += len(at)
            wins = (dk < d[at]) | ((dk == d[at]) & (k < now[at]))
            now[at[wins]], d[at[wins]] = k, dk[wins]
        out[rows], best[rows] = now, d
    return out, best, work


def _blocks(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, vector of longs) as block rows without clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(begin, BLOCK_ROWS)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8")
                nobody = np.full(part.num_rows, -1, "<i4")
                yield pa.RecordBatch.from_pydict({"ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), "vectors": [values.tobytes()], "width": pa.array([width], pa.int32()), "cluster": [nobody.tobytes()]})

    return run


def _block_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(batch.num_rows):
        cluster = np.frombuffer(batch.column("cluster")[k].as_py(), "<i4").astype(np.int64)
        yield np.frombuffer(batch.column("vectors")[k].as_py(), "<i8").reshape(len(cluster), -1), cluster


def _assigned(found: Balls) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [assign(vectors, cluster, found)[0].astype("<i4").tobytes() for vectors, cluster in _block_rows(batch)]
            yield pa.RecordBatch.from_pydict({"ids": batch.column("ids"), "vectors": batch.column("vectors"), "width": batch.column("width"), "cluster": pa.array(new, pa.binary())})

    return run


def _summed(centroids: list[list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's blocks, for each cluster: number of members, their sums by component (as text, of any size) and the largest squared distance from ``centroids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, far = [0] * len(centroids), [None] * len(centroids), [0] * len(centroids)
        for batch in batches:
            for vectors, cluster in _block_rows(batch):
                x, c = _matrix(vectors, centroids)
                for k in np.unique(cluster):
                    own = x[cluster == k]
                    count[k] += len(own)
                    part = own.sum(axis=0).astype(object)
                    total[k] = part if total[k] is None else total[k] + part
                    far[k] = max(far[k], int(_squared(own, c[k]).max()))
        has = [k for k in range(len(centroids)) if count[k]]
        sums = [[str(int(v)) for v in total[k]] for k in has]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(has, pa.int32()), "n": pa.array([count[k] for k in has], pa.int64()), "sums": pa.array(sums, pa.list_(pa.string())), "far": pa.array([str(far[k]) for k in has], pa.string())})

    return run


def _moved(blocks: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], list[float]]:
    """Floor means of the members (an empty cluster stays), and radii around them."""
    parts = blocks.select("ids", "vectors", "width", "cluster").mapInArrow(_summed(centroids), "cluster int, n long, sums array<string>, far string")
    number = lambda c: F.col(c).cast("decimal(38,0)")
    cells = parts.select("cluster", "n", "far", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(number("value")).alias("value"), F.max(number("far")).alias("far"))
    new, radius = [list(c) for c in centroids], [0.0] * len(centroids)
    for r in cells.collect():  # k times the dimensions, whatever the input
        new[r.cluster][r.at] = int(r.value) // r.n
        radius[r.cluster] = math.sqrt(r.far)
    shift = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(new, centroids, strict=True)]
    return new, [(r + s) * (1 + 1e-9) for r, s in zip(radius, shift, strict=True)]


def _final(found: Balls, digests: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, (vectors, before) in zip(batch.column("ids"), _block_rows(batch), strict=True):
                cluster, distance, _ = assign(vectors, before, found)
                if any(int(d) >= 1 << 63 for d in ([distance.max()] if len(distance) else [])):
                    raise OverflowError("a squared distance that no long can hold")
                long = pa.array([int(d) for d in distance], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster, pa.int32()), long, pa.array([digests[k] for k in cluster], pa.string())], names=["vec_id", "cluster", "distance", "centroid_sha256"])

    return run


def kept_vectors(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", width: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v: whole components floor(scale * x) of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    fits = lambda e: F.when(F.abs(e * scale) <= LARGEST, F.floor(e * scale)).otherwise(F.raise_error(F.lit("a component beyond 2^52")).cast("long"))
    return embeddings.where((F.size(x) == width) & F.coalesce(finite, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, fits).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    at = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    order = [F.col("vec_id").isNull(), at, F.col("v")]
    return [[int(x) for x in r.v] for r in kept.orderBy(*order).select("v").limit(k).collect()]


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = DIMENSIONS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector that takes part: vec_id, cluster, distance (squared), centroid_sha256 of its final centroid."""
    kept = kept_vectors(embeddings, vec_id, vector, width, scale)
    centroids = first_centroids(kept, k, seed)
    schema = "ids array<long>, vectors binary, width int, cluster binary"
    blocks = stored(kept.mapInArrow(_blocks(width), schema))
    radius = [math.inf] * len(centroids)
    for _ in range(rounds):
        blocks = stored(blocks.mapInArrow(_assigned(balls(centroids, radius)), schema))
        centroids, radius = _moved(blocks, centroids)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return blocks.mapInArrow(_final(balls(centroids, radius), digests), "vec_id long, cluster int, distance long, centroid_sha256 string")


def cluster_report(embeddings: DataFrame, **options) -> DataFrame:
    """``cluster`` with cluster_inertia and inertia: the squared distances summed over the cluster and over all."""
    rows = stored(cluster(embeddings, **options))
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # One row for each cluster, so k at most.
    total = sum(r.cluster_inertia for r in sums.collect())
    if total >= 1 << 63:
        raise OverflowError("an inertia that no long can hold")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
