"""Exact top-k search by inner product with dual cover trees.

Vectors become whole numbers, floor(``SCALE`` x) for each component x. The top levels of both trees are shared: a net of at most ``CELLS``
centres, in farthest-first order, is fitted on about ``SAMPLE`` rows; every row goes to its nearest centre's cell, every query to one of the
first centres (the coarser net). Of each cell and each query group the covering radius is known exactly. With centres q and d and radii r and s, no
pair below scores more than q.d + |q| s + |d| r + r s.

Round 1 searches each query group in the cells that hang below its own centre. Round 2 visits the other pairs of group and cell
whose bound reaches the group's worst k-th score of round 1; pairs that can't are dropped before any row is sent. A pair in a round is
searched by its own two cover trees, pairs of nodes together, best bound first; a pair of nodes is skipped if its bound is less than the worst k-th score among the queries below.

A task holds at most about ``QUERY_BLOCK`` queries and ``DATA_BLOCK`` rows: larger groups and cells are dealt into blocks by hash. Without clusters, bounds
prune little, and every data row is sent once for each ``QUERY_BLOCK`` queries, as an exact search must.

Scores are exact: in floating point while all sums stay below 2^52, else in whole numbers of 64 bits or of any size. A score among the k best that no long can
hold raises OverflowError. Vectors that are null, or hold a null or a component that is not finite, take no part, nor do rows without a vec_id. Vectors of different
lengths are compared on their common components (zeros stand for the rest). A candidate with the query's own vec_id is the query's own row.
Repeated rows are candidates each (k of them at most can matter, so they are counted before the shuffle); repeated rows of one query are one query.
Ties go to the smaller vec_id. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
K = 10
EVERY = 100
DATA_BLOCK, QUERY_BLOCK = 4096, 8192
#: Points below which a node is not split, and what a distance of rows can be wrong by for each component, in largest components.
LEAF, ROUNDING = 32, 3e-8
#: Rows on which the net is fitted, as expected (drawn by hash), and centres of the net at most.
SAMPLE, CELLS = 16_384, 1024
#: Queries of a leaf that are compared at once.
_ROWS = 256
#: Up to here sums of whole numbers are exact in floating point, and in 64 bits.
_FLOAT, _LONG = 2.0**52, 2.0**62


@dataclass(slots=True)
class Node:
    """Covers its points within ``radius`` of ``center``. A leaf has points, another node has children."""

    center: np.ndarray
    norm: float
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)
    worst: float = -np.inf


def cover_tree(x: np.ndarray, keep: int = 0, ids: np.ndarray | None = None) -> Node:
    """The tree over the rows of ``x``. Of equal rows, a leaf keeps only the first ``keep``, if that is not 0.

    With ``ids``, it keeps as many more as one id has repeats among the equal rows, so that ``keep`` - 1 are left without any one id.

    The children of a node are the cells of a net at half its scale; cells of ``LEAF`` points or fewer share one leaf. Distances are those of the rows
    scaled to the largest component, so that nothing overflows, and may be wrong by ``slack``: radii are larger by it, and a node within it is not split. A centre
    always leaves the points that are free, so the loop ends whatever the rounding.
    """
    exponent = int(np.frexp(np.abs(x).max(initial=0))[1])
    y = np.ldexp(x, -exponent)
    squares, slack = np.einsum("ij,ij->i", y, y), ROUNDING * x.shape[1]

    def distances(points: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares[points] + squares[to] - 2 * (y[points] @ y[to]), 0))

    def leaf(points: np.ndarray, center: int, radius: float) -> Node:
        if keep and radius <= slack and (x[points] == x[center]).all():
            repeats = 0 if ids is None else int(np.unique(ids[points], return_counts=True)[1].max()) - 1
            points = np.sort(points)[: keep + repeats]
        # In the rows' own scale; infinite where no double holds it, which only prunes less.
        with np.errstate(over="ignore"):
            return Node(x[center], float(np.ldexp(np.linalg.norm(y[center]), exponent)), float(np.ldexp(radius + slack, exponent)), points)

    def build(points: np.ndarray, far: np.ndarray, center: int) -> Node:
        radius = float(far.max())
        if radius <= slack or len(points) <= 2 * LEAF:
            return leaf(points, center, radius)
        node = leaf(points, center, radius)
        reach = 2.0 ** (np.ceil(np.log2(radius)) - 1)
        own, now, free = points, far, np.ones(len(points), bool)
        rows, sizes, few, at = y[points], squares[points], [], center
        while True:
            near = free & ((now <= reach) | (own == at))
            if near.sum() > LEAF:
                node.children.append(build(own[near], now[near], at))
            else:
                few.append(own[near])
            free &= ~near
            if not free.any():
                break
            at = int(own[free.argmax()])
            now = np.sqrt(np.maximum(sizes + squares[at] - 2 * (rows @ y[at]), 0))
        if few:
            rest = np.concatenate(few)
            node.children.append(leaf(rest, center, float(distances(rest, center).max())))
        node.points = np.zeros(0, np.int64)
        return node

    every = np.arange(len(x))
    return build(every, distances(every, 0), 0)


def _as_float(score: int) -> float:
    """A score for comparison with bounds; infinite where no double holds it."""
    try:
        return float(score)
    except OverflowError:
        return np.inf if score > 0 else -np.inf


def bound(center: np.ndarray, norm: float, radius: float, other: np.ndarray, other_norm: np.ndarray | float, other_radius: np.ndarray | float) -> np.ndarray | float:
    """What no pair of points within the radii can exceed; with room for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):  # what is not a number prunes nothing
        reach = norm * other_radius + other_norm * radius + radius * other_radius
        return other @ center + reach + 1e-6 * (norm * other_norm + reach) + 1


class Search:
    """Top-k of each query of a block among the rows of a data block; rows of both are sorted by id. Scores below a query's ``floor`` are not wanted."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.k, self.query_ids, self.data_ids = k, query_ids, data_ids
        self.visited, self.found = 0, [np.zeros(0, np.int64)] * len(queries)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor.astype(np.float64)
        if not len(queries) or not len(data):
            self.scores = [np.zeros(0, np.int64)] * len(queries)
            return
        with np.errstate(over="ignore"):
            largest = float(np.linalg.norm(queries, axis=1).max() * np.linalg.norm(data, axis=1).max())
        self.exact = np.int64 if largest < _LONG else object
        if largest < _FLOAT:
            self.q, self.d = queries, data
        elif self.exact is np.int64:
            self.q, self.d = queries.astype(np.int64), data.astype(np.int64)
        else:
            self.q, self.d = (np.array([[int(x) for x in row] for row in m], object) for m in (queries, data))
        self.scores = [np.zeros(0, self.exact)] * len(queries)
        self._visit(cover_tree(queries), cover_tree(data, k + 1, data_ids))

    def _compare(self, q: Node, points: np.ndarray) -> None:
        self.visited += len(q.points) * len(points)
        points = np.sort(points)
        low = np.inf
        for i in range(0, len(q.points), _ROWS):
            mine = q.points[i : i + _ROWS]
            scores = (self.q[mine] @ self.d[points].T).astype(self.exact)
            other = self.query_ids[mine][:, None] != self.data_ids[points][None, :]
            for row, fits, at in zip(scores, other & (scores >= self.floor[mine][:, None]), mine.tolist()):
                if fits.any():
                    self._take(at, points[fits], row[fits])
                low = min(low, self._worst(at))
        q.worst = low

    def _take(self, at: int, points: np.ndarray, scores: np.ndarray) -> None:
        """Keep the best k of a query's own and the new rows: by score, then by id, in which order the rows are numbered."""
        points, scores = np.concatenate([self.found[at], points]), np.concatenate([self.scores[at], scores])
        if len(points) > self.k:
            least = np.partition(scores, len(scores) - self.k)[-self.k]
            sure, tied = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
            chosen = np.concatenate([sure, tied[np.argsort(points[tied], kind="stable")][: self.k - len(sure)]])
            points, scores = points[chosen], scores[chosen]
        self.found[at], self.scores[at] = points, scores

    def _worst(self, at: int) -> float:
        return max(_as_float(self.scores[at].min()) if len(self.found[at]) == self.k else -np.inf, float(self.floor[at]))

    def _visit(self, q: Node, d: Node) -> None:
        if self._bound(q, d) < q.worst:
            return
        if not q.children and not d.children:
            self._compare(q, d.points)
        elif d.children and (not q.children or d.radius >= q.radius):
            for child in sorted(d.children, key=lambda c: -self._bound(q, c)):
                self._visit(q, child)
        else:
            for child in q.children:
                self._visit(child, d)
            q.worst = min(c.worst for c in q.children)

    @staticmethod
    def _bound(q: Node, d: Node) -> float:
        return bound(q.center, q.norm, q.radius, d.center, d.norm, d.radius)


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different rows, each the one farthest from those before: every beginning of the list is a net."""
    y = np.ldexp(x, -int(np.frexp(np.abs(x).max(initial=0))[1]))
    chosen, far = [], np.full(len(x), np.inf)
    while len(chosen) < count and len(x) and (not chosen or far.max() > 0):
        at = 0 if not chosen else int(far.argmax())
        chosen.append(at)
        far = np.minimum(far, ((y - y[at]) ** 2).sum(axis=1))
        far[at] = 0
    return x[chosen]


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, and its distance from it, computed without cancellation."""
    exponent = int(np.frexp(max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0)))[1])
    y, c = np.ldexp(x, -exponent), np.ldexp(centers, -exponent)
    at = ((c * c).sum(axis=1)[None, :] - 2 * (y @ c.T)).argmin(axis=1)
    with np.errstate(over="ignore"):
        return at, np.ldexp(np.linalg.norm(y - c[at], axis=1), exponent)


def fit(embedding: Column) -> Column:
    """Whether a vector takes part."""
    return embedding.isNotNull() & F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors in whole numbers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim), np.float64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    return out


def _routed(rows: DataFrame, centers: np.ndarray, coarse: int, dim: int) -> DataFrame:
    """``rows`` with cell and distance, and the same among the first ``coarse`` centres (the group)."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                x = _matrix(part.column(1), dim)
                cell, far = nearest(x, shared.value)
                group, wide = nearest(x, shared.value[:coarse])
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, (cell.astype(np.int32), far, group.astype(np.int32), wide))], names=[*part.schema.names, "cell", "far", "grp", "wide"])

    return rows.mapInArrow(run, "id long, v array<double>, n int, cell int, far double, grp int, wide double")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id ``every`` divides, its k best among the others."""
    valid = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("e")).where(F.col("id").isNotNull() & fit(F.col("e")))
    valid = valid.select("id", F.transform("e", lambda x: x.cast("double")).alias("v"))
    rows = stored(valid.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n")))
    asking = F.col("id") % every == 0
    n, n_asked, dim = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(asking, 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(1, dim)
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = rows.where(F.xxhash64("id", "v", F.lit("net")) / F.lit(float(1 << 64)) + 0.5 <= share).select("v")
    sample = _matrix(pa.array([r.v for r in drawn.collect()], pa.list_(pa.float64())), dim)
    centers = farthest_first(sample, min(CELLS, max(1, -(-n // DATA_BLOCK)))) if len(sample) else np.zeros((1, dim))
    coarse = min(len(centers), max(1, -(-n_asked // QUERY_BLOCK)))
    routed = stored(_routed(rows, centers, coarse, dim))
    # At most CELLS rows each reach the driver.
    cells = {r.cell: r for r in routed.groupBy("cell").agg(F.max("far").alias("radius"), F.sum("n").alias("rows")).collect()}
    groups = {r.grp: r for r in routed.where(asking).groupBy("grp").agg(F.max("wide").alias("radius"), F.count(F.lit(1)).alias("rows")).collect()}
    blocks: dict[int, list[int]] = {}
    for g in sorted(groups):
        begin = sum(map(len, blocks.values()))
        blocks[g] = list(range(begin, begin + -(-groups[g].rows // QUERY_BLOCK)))
    home = nearest(centers, centers[:coarse])[0]
    first = {c: [g for g in groups if home[c] == g] for c in cells}
    for g in groups:  # a group without a cell of its own begins at its nearest one
        if not any(g in gs for gs in first.values()):
            first[min(cells, key=lambda c: float(np.linalg.norm(centers[c] - centers[g])))].append(g)
    found = _round(routed, asking, cells, blocks, first, None, k, dim)
    if coarse > 1:
        found = stored(found)
        worst = {r.grp: r.worst for r in found.groupBy("grp", "query_id", "tag").agg(F.count(F.lit(1)).alias("c"), F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.col("c") >= k).groupBy("grp").agg(F.min(F.element_at("s", k)).alias("worst"), F.count(F.lit(1)).alias("full")).collect() if r.full == groups[r.grp].rows}
        names = sorted(cells)
        radii, norms = np.array([cells[c].radius for c in names]), np.linalg.norm(centers[names], axis=1)
        second: dict[int, list[int]] = {c: [] for c in cells}
        for g in groups:
            limits = bound(centers[g], float(np.linalg.norm(centers[g])), groups[g].radius, centers[names], norms, radii)
            for c, limit in zip(names, limits):
                if g not in first[c] and not limit < worst.get(g, -np.inf):
                    second[c].append(g)
        if any(second.values()):
            floors = found.groupBy("query_id", "tag").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", "tag", F.get("s", F.lit(k - 1)).alias("floor"))
            found = found.unionByName(_round(routed, asking, cells, blocks, second, floors, k, dim))
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _round(routed: DataFrame, asking: Column, cells: dict, blocks: dict, visit: dict[int, list[int]], floors: DataFrame | None, k: int, dim: int) -> DataFrame:
    """grp, query_id, tag, vec_id, score: up to k rows of each query from each visited pair of a query block and a data block."""
    spark, offsets = routed.sparkSession, {}
    for c in sorted(cells):
        offsets[c] = sum(-(-cells[x].rows // DATA_BLOCK) for x in offsets)
    size = lambda c: -(-cells[c].rows // DATA_BLOCK)
    # Where each cell's rows and each group's queries go: CELLS rows at most, with as many numbers as there are blocks of the other side.
    to_queries = spark.createDataFrame([(c, offsets[c], size(c), [b for g in visit[c] for b in blocks[g]]) for c in cells], "cell int, begin int, parts int, qbs array<int>")
    to_data = spark.createDataFrame([(g, blocks[g][0], len(blocks[g]), [b for c in cells if g in visit[c] for b in range(offsets[c], offsets[c] + size(c))]) for g in blocks], "grp int, begin int, parts int, dbs array<int>")
    part = (F.col("begin") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).cast("int")
    data = routed.join(F.broadcast(to_queries), "cell").select("id", "v", part.alias("db"), "qbs", F.explode(F.sequence(F.lit(1), "n"))).select("id", "v", "db", F.explode("qbs").alias("qb"))
    data = data.toDF("id", "v", "db", "qb")  # columns of its own, though both sides come from one table
    queries = routed.where(asking).join(F.broadcast(to_data), "grp").select("id", "v", "grp", F.xxhash64("v").alias("tag"), part.alias("qb"), F.explode("dbs").alias("db"))
    if floors is not None:
        queries = queries.join(floors, (F.col("id") == F.col("query_id")) & (queries["tag"] == floors["tag"]), "left").select("id", "v", "grp", queries["tag"], "qb", "db", "floor")
    else:
        queries = queries.withColumn("floor", F.lit(None).cast("long"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("id"), right.sort_by("id")
        query_ids, data_ids = left["id"].to_numpy(), right["id"].to_numpy()
        floor = np.array([-np.inf if x is None else x for x in left["floor"].to_pylist()], np.float64)
        s = Search(_matrix(left["v"], dim), query_ids, _matrix(right["v"], dim), data_ids, k, np.nextafter(floor, -np.inf))
        at = np.repeat(np.arange(len(query_ids)), [len(f) for f in s.found])
        points = np.concatenate([np.zeros(0, np.int64), *s.found])
        scores = [int(x) for f in s.scores for x in f]
        if any(not -(1 << 63) <= x < 1 << 63 for x in scores):
            raise OverflowError("a score among the best is too large for a long")
        return pa.table({"grp": left["grp"].to_numpy()[at], "query_id": query_ids[at], "tag": left["tag"].to_numpy()[at], "vec_id": data_ids[points], "score": pa.array(scores, pa.int64())})

    return queries.groupBy("qb", "db").cogroup(data.groupBy("qb", "db")).applyInArrow(run, "grp int, query_id long, tag long, vec_id long, score long")
