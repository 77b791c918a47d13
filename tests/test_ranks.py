"""Cuts at exact ranks, balancing, splits and samples built on them, and the rank join, against sorting in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronofacts.operators import curate, match, rank_join, ranks


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    """One stratum holds nine tenths; a null stratum, a null order text, repeated rows and texts with a common beginning."""
    data = [("hot" if k % 10 else ["a", None, "b"][k // 10 % 3], ("same-" + sha(k)) if k % 2 else sha(k), k) for k in range(3000)]
    data += [("hot", "tie", 9000)] * 40 + [("hot", "tie", 9001)] * 5 + [("a", None, 9100), ("a", "", 9101)]
    return data, spark.createDataFrame(data, "g string, h string, k int")


@pytest.mark.parametrize("few", [1, 30, 50_000])
def test_bands_of_hot_strata(spark, rows, monkeypatch, few):
    """Borders deep inside common prefixes and in the middle of ties; prefixes are refined until they hold ``few`` rows."""
    monkeypatch.setattr(ranks, "FEW", few)
    data, df = rows
    by = defaultdict(list)
    for g, h, k in data:
        by[g].append(h or "")
    middle = sum(h < "tie" for h in by["hot"]) + 17
    cuts = [("hot", 0, 0), ("hot", 1, 7), ("hot", 2, middle), ("hot", 3, len(by["hot"])), ("hot", 4, 10**6), (None, 0, 50), ("a", 0, 1), ("zz", 0, 3)]
    got = ranks.bands(df, ["g"], "h", spark.createDataFrame(cuts, "g string, cut int, rank long"))
    assert got.columns == ["g", "h", "k", "band"] and Counter(tuple(r)[:3] for r in got.collect()) == Counter(data)
    sizes = Counter((r.g, r.band) for r in got.collect())
    for g, texts in by.items():
        at = sorted(min(r, len(texts)) for q, _, r in cuts if q == g)
        want = Counter()
        for n in range(len(texts)):
            want[sum(n >= r for r in at)] += 1
        assert {b: n for (q, b), n in sizes.items() if q == g} == {b: n for b, n in want.items() if n}
    # Bands follow the order.
    ends = defaultdict(list)
    for r in got.where("g = 'hot'").collect():
        ends[r.band].append(r.h)
    order = sorted(ends)
    assert all(max(ends[a]) <= min(ends[b]) for a, b in zip(order, order[1:], strict=False))


def test_bands_without_keys_rows_or_cuts(spark, rows):
    _, df = rows
    one = spark.createDataFrame([(100,)], "rank long")
    assert ranks.first(df, [], "h", one).count() == 100
    assert ranks.first(df.limit(0), [], "h", one).count() == 0
    assert ranks.bands(df, ["g"], "h", spark.createDataFrame([], "g string, cut int, rank long")).where("band <> 0").count() == 0


def test_splits_and_samples_of_a_hot_stratum(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 20)
    data = [(k, "hot" if k % 10 else "ab"[k // 10 % 2]) for k in range(1003)]
    df = spark.createDataFrame(data, "k int, g string").withColumn("h", F.sha2(F.col("k").cast("string"), 256))
    got = curate.stratified_split(df, ["g"], "h").collect()
    assert Counter(r.split for r in got) == {"train": 803, "validation": 100, "test": 100}
    for g in {"hot", "a", "b"}:
        own = sorted((r.h, r.split) for r in got if r.g == g)
        assert [s for _, s in own] == sorted((s for _, s in own), key=["train", "validation", "test"].index)
    ordered = sorted(sha(k) for k, _ in data)
    split = {r.h: r.split for r in curate.hash_split(df, F.col("h")).withColumn("h", F.sha2(F.col("k").cast("string"), 256)).collect()}
    assert [split[h] for h in ordered] == ["train"] * 803 + ["validation"] * 100 + ["test"] * 100
    for mode, n in (("bround", 37), ("floor", 37), ("floor", 5000)):
        sample = curate.stratified_sample(df.drop("h"), ["g"], F.sha2(F.col("k").cast("string"), 256), n, mode)
        c = Counter(g for _, g in data)
        quota = {g: (round if mode == "bround" else int)(c[g] * min(n, 1003) / 1003) for g in c}
        first = sorted((sum(sha(j) < sha(k) for j, q in data if q == g) >= quota[g], sha(k), k) for k, g in data)[:n]
        assert sorted(r.k for r in sample.collect()) == sorted(k for _, _, k in first)


# Rank join


def plain(slots, facts, k):
    out = []
    for q in {q for q, _, _ in slots["head"]}:
        sim = {s: {} for s in slots}
        for s, rows in slots.items():
            for p, name, x in rows:
                if p == q and name is not None:
                    sim[s][name] = max(x, sim[s].get(name, x))
        found = [(-(sim["head"][h] + sim["relation"][r] + sim["tail"][t]), h, r, t) for h, r, t in facts if h in sim["head"] and r in sim["relation"] and t in sim["tail"]]
        out += [(q, h, r, t, -s) for s, h, r, t in sorted(found)[:k]]
    return Counter(out)


@pytest.fixture(scope="module")
def world():
    rnd = random.Random(6)
    facts = [("hot" if i % 3 == 0 else f"h{rnd.randrange(300)}", f"r{rnd.randrange(4)}", f"t{rnd.randrange(400)}") for i in range(4000)]
    facts += facts[:30]
    names = {s: sorted({f[k] for f in facts}) for k, s in enumerate(("head", "relation", "tail"))}
    slots = {s: [(q, n, rnd.randrange(40) if q == 2 else rnd.randrange(10**6)) for q in (1, 2) for n in ns] + [(1, None, 5), (1, ns[0], 3)] for s, ns in names.items()}
    return slots, facts


def test_rank_join_with_ties_repeats_and_a_hot_name(spark, world):
    slots, facts = world
    frames = {s: spark.createDataFrame(rows, "qid int, name string, sim long") for s, rows in slots.items()}
    f = spark.createDataFrame(facts, "head string, relation string, tail string")
    for k, depth in ((50, 16), (3, 4)):
        best, touched = rank_join.best_triples(frames, f, k, depth=depth)
        assert Counter((r.qid, r.head, r.relation, r.tail, r.score_sum) for r in best.collect()) == plain(slots, facts, k)
    seen = {r.qid: r.touched for r in rank_join.best_triples(frames, f.where("head <> 'hot'"), 3, depth=4)[1].collect()}
    assert seen[1] < 0.4 * len(facts)


def test_rank_join_without_candidates_and_with_an_unknown_slot(spark, world):
    slots, facts = world
    frames = {s: spark.createDataFrame(rows, "qid int, name string, sim long") for s, rows in slots.items()}
    f = spark.createDataFrame(facts, "head string, relation string, tail string")
    assert rank_join.best_triples(frames | {"relation": frames["relation"].limit(0)}, f)[0].count() == 0
    assert rank_join.best_triples(frames, f.limit(0))[0].count() == 0
    got = rank_join.best_triples(frames | {"relation": None}, f, 5)[0].collect()
    ones = slots | {"relation": [(q, f"r{i}", 1) for q in (1, 2) for i in range(4)]}
    assert Counter((r.qid, r.head, r.relation, r.tail, r.score_sum) for r in got) == plain(ones, facts, 5)
    with pytest.raises(ValueError):
        rank_join.best_triples({"head": None, "relation": frames["relation"], "tail": None}, f)


def test_exact_or_similar_asks_only_for_what_is_left(spark):
    f = spark.createDataFrame([("a", "r", "x"), ("b", "r", "y")], "head string, relation string, tail string")
    p = spark.createDataFrame([(1, "a", "r", None), (2, "c", "r", None)], "qid int, head string, relation string, tail string")
    asked = []

    def similar(left):
        asked.extend(r.qid for r in left.collect())
        return f.where("head = 'b'").withColumns({"qid": F.lit(2), "score_sum": F.lit(2.5)})

    assert sorted((r.qid, r.head, r.approximate) for r in match.exact_or_similar(p, f, similar).collect()) == [(1, "a", False), (2, "b", True)]
    assert asked == [2]
