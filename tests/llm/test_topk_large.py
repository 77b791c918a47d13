"""Top-k search on finite vectors of any magnitude: equal, near and clustered rows, within a time limit."""

import time

import numpy as np
import pytest

from chronofacts.llm import topk_search


def rows_of(kind, spread, n=300, width=16):
    rng = np.random.default_rng(int(np.log10(spread)))
    base = rng.uniform(-1, 1, (3, width)) * spread
    if kind == "equal":
        return np.floor(np.repeat(base[:1], n, 0))
    if kind == "near":
        return np.floor(base[:1] + rng.integers(-2, 3, (n, width)))
    if kind == "clusters":
        return np.floor(base[rng.integers(0, 3, n)] + rng.integers(-50, 50, (n, width)))
    return np.floor(base[rng.integers(0, 3, n)] * rng.choice([1, 1e-3, 0, 1e-100], (n, 1)))


@pytest.mark.parametrize("kind", ["equal", "near", "clusters", "mixed"])
@pytest.mark.parametrize("spread", [1e7, 1e8, 1e12, 1e153, 1e300])
def test_search_ends_and_is_exact(kind, spread):
    x = rows_of(kind, spread)
    began = time.perf_counter()
    s = topk_search.Search(x[:15], np.arange(15), x, np.arange(len(x)), 10)
    assert time.perf_counter() - began < 5
    whole = [[int(v) for v in row] for row in x]
    for q in range(15):
        best = sorted((-sum(a * b for a, b in zip(whole[q], r, strict=True)), j) for j, r in enumerate(whole) if j != q)[:10]
        assert sorted((-int(v), int(j)) for v, j in zip(s.scores[q], s.found[q], strict=True)) == best


def test_radii_cover_all_points_below():
    for spread in (1.0, 1e8, 1e150):
        x = np.concatenate([rows_of(k, max(spread, 10.0), 400) for k in ("near", "clusters", "mixed")])
        stack = [topk_search.cover_tree(x)]
        while stack:
            node = stack.pop()
            below, inside = [node], []
            while below:
                m = below.pop()
                inside += list(m.points)
                below += m.children
            scale = np.abs(x).max()
            assert (np.linalg.norm((x[inside] - node.center) / scale, axis=1) <= node.radius / scale).all()
            stack += node.children


def test_table_of_large_clusters(spark):
    rng = np.random.default_rng(4)
    base = rng.uniform(-1, 1, (2, 6)) * 1e6
    rows = [(i, [float(v) for v in base[i % 2] + rng.integers(-1, 2, 6)]) for i in range(600)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    whole = [[int(np.floor(1024 * v)) for v in x] for _, x in rows]
    want = {}
    for q in range(0, 600, 100):
        best = sorted((-sum(a * b for a, b in zip(whole[q], r, strict=True)), j) for j, r in enumerate(whole) if j != q)[:10]
        want |= {(q, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    assert got == want
