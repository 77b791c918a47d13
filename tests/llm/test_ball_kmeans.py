"""Ball k-means against plain k-means in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from chronofacts.llm import ball_kmeans


def plain(rows, k, rounds, width, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in first[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    end = [(i, *nearest(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, a in end if a == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted((repr(i), j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in end)


def compared(spark, rows, k=6, rounds=4, width=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ball_kmeans.cluster_report(df, k=k, rounds=rounds, width=width).collect()
    assert sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == plain(rows, k, rounds, width)
    return got


def test_ties_nulls_and_repeats(spark):
    rnd = random.Random(1)
    rows = [(i, [float(rnd.randint(-3, 3)) / 256 for _ in range(3)]) for i in range(400)]
    rows += [(5, [0.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0]), (None, [0.01, 0.0, 0.0]), (900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [float("nan")] * 3), (905, [float("-inf"), 1.0, 1.0])]
    compared(spark, rows)
    assert compared(spark, [(i, [1.0, 1.0, 1.0]) for i in range(30)])
    assert len(compared(spark, rows[:4])) == 4
    assert ball_kmeans.cluster_report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("spread", [1e3, 1e6])
def test_large_components_are_exact(spark, spread):
    rnd = random.Random(spread)
    compared(spark, [(i, [rnd.uniform(-spread, spread) for _ in range(3)]) for i in range(120)])


def test_components_that_no_long_holds_are_refused(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(1, [1e300, 0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(PySparkException, match="beyond 2"):
        ball_kmeans.cluster_report(df, width=3).collect()


def test_whole_table_against_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding").collect()]
    compared(spark, rows, k=40, rounds=5, width=64)


def test_cores_and_far_clusters_are_not_compared():
    rng = np.random.default_rng(2)
    middles = rng.integers(-100_000, 100_000, (20, 8))
    x = np.concatenate([m + rng.integers(-200, 200, (200, 8)) for m in middles])
    centroids = [[int(v) for v in m] for m in middles]
    first, best, work = ball_kmeans.assign(x, np.full(len(x), -1), ball_kmeans.balls(centroids, [math.inf] * 20))
    assert work == len(x) * 20
    radius = [math.sqrt(best[first == k].max()) for k in range(20)]
    again, _, work = ball_kmeans.assign(x, first, ball_kmeans.balls(centroids, radius))
    assert (again == first).all() and work == len(x)


def test_random_moves_agree_with_all_distances():
    rng = np.random.default_rng(7)
    for _ in range(30):
        x = rng.integers(-9, 9, (150, 2))
        c = rng.integers(-9, 9, (8, 2))
        before = rng.integers(0, 8, 150)
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        radius = [math.sqrt(d[before == k, k].max(initial=0)) for k in range(8)]
        got, best, _ = ball_kmeans.assign(x, before, ball_kmeans.balls(c.tolist(), radius))
        assert (got == d.argmin(1)).all() and (best == d.min(1)).all()
