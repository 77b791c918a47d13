"""The queries over whole tables: nothing is left out of the query set or of a side of a join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofacts.operators import similarity
from chronofacts.plans import workload
from tests import test_oracle as oracle

SF = "/root/testdata/sf0.01"
duck = oracle.duck


@pytest.mark.parametrize("name", ["vector_topk", "similarity_triple_join", "swap_relax_cascade", "balance_levels"])
def test_whole_query(spark, duck, name):
    oracle.test_query(spark, duck, name)


def test_every_hundredth_vector_is_a_query(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}
    assert {r.query_id for r in workload.QUERIES["vector_topk"](spark, SF).select("query_id").distinct().collect()} == ids


def test_scores_of_many_blocks_are_those_of_one(spark):
    rnd = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rnd.integers(-4, 5, 6)]) for k in range(90)]
    v = spark.createDataFrame(rows, "id int, v array<float>")
    q = v.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.id): r.score for r in similarity.scores(q, v, block=7).collect()}
    assert got == {(a, b): float(np.dot(x, y)) for a, x in rows if a % 3 == 0 for b, y in rows}


def test_other_languages_pass_the_balance(spark):
    other = F.col("lang").isNull() | ~F.col("lang").isin("en", "fr", "de")
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").where(other).select("doc_id").collect()}
    got = {r.doc_id for r in workload.QUERIES["balance_levels"](spark, SF).select("doc_id").collect()}
    assert ids and ids <= got


def test_best_of_salted_blocks_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(similarity, "CHUNK_BYTES", 400)
    rnd = np.random.default_rng(4)
    rows = [(f"n{k:02d}", [float(x) for x in rnd.integers(-1, 2, 3)]) for k in range(60)] + [("short", [1.0]), ("hole", [1.0, None, 2.0]), ("null", None), ("void", [])]
    v = spark.createDataFrame(rows, "id string, v array<double>").repartition(3)
    q = v.where("id < 'n20' OR id = 'hole' OR id = 'null'").withColumnRenamed("id", "query_id")
    value = {i: [x or 0.0 for x in (list(x) + [0.0] * 3)[:3]] for i, x in rows if x is not None}
    want = {}
    for i in [x for x in value if x < "n20" or x == "hole"]:
        best = sorted(value, key=lambda j: (-float(np.dot(value[i], value[j])), j))[:7]
        want |= {(i, j): (float(np.dot(value[i], value[j])), n + 1) for n, j in enumerate(best)}
    assert {(r.query_id, r.id): (r.score, r["rank"]) for r in similarity.top_k(q, v, 7).collect()} == want
    assert similarity.top_k(q.limit(0), v, 7).count() == 0 and similarity.top_k(q, v.limit(0), 7).count() == 0
