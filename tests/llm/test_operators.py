"""The training-data operators against brute force, round trips and defined edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronofacts.llm import chat, decontaminate, html_extract, license_scan, queries, sentencepiece_scan, sharding, simhash, topk_search, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, schema=DOCS):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], schema)


EDGE = [None, "", " \n\t", "a", "a b", "word " * 20_000, "dup text here", "dup text here", "été 日本", "x\0y ﷐"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in df.select(*want.columns).collect()) == Counter(want.fetchall())


def test_topk_ties_nulls_and_repeats(spark):
    rnd = random.Random(2)
    rows = [(k, [float(rnd.randint(-2, 2)) for _ in range(3)]) for k in range(300)] + [(7, [1.0, 1.0, 1.0]), (900, None), (901, [1.0, None, 2.0]), (902, [float("nan")] * 3), (None, [1.0] * 3), (200, [2.0, 2.0, 2.0]), (200, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk_search.top_k(df).collect()]
    good = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in {(i, tuple(v)) for i, v in good if i % 100 == 0}:
        best = sorted((-int(np.dot(q[1], v)), i) for i, v in good if i != q[0])[:10]
        want += [(q[0], r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m * 2000, 5, (400, 8)).round() for m in range(6)])
    stack, seen = [topk_search.cover_tree(x)], 0
    while stack:
        n = stack.pop()
        inside = n.points
        seen += len(inside)
        assert not len(inside) or np.linalg.norm(x[inside] - n.center, axis=1).max() <= n.radius + 1e-6
        stack += n.children
    assert seen == len(x)
    s = topk_search.Search(x[-50:], np.arange(50), x, np.arange(len(x)), 10)
    assert s.visited < 50 * len(x)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_base_and_templates(spark):
    texts = EDGE + ["Under the MIT License; under the mit license", "Apache License, Version 2.0", "CC-BY-NC", "Licensed under the MIT open source license", "Licensed under the MIT very open license", "Copyright (c) 2020 Some One. All rights reserved."]
    got = {r.doc_id: r for r in license_scan.license_report(docs_of(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = plain_words(t)
        places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        assert (got[k].n_words, got[k].n_base) == (len(w), len(places))
        assert got[k].base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, got[k].base_labels.split(","))) <= set(got[k].labels.split(","))
        assert got[k].first_word == min((i for i, _ in places), default=None) and 0 <= got[k].score <= 1
    n = len(EDGE)
    assert [got[n + k].labels for k in range(6)] == ["mit", "apache-2", "cc-by-nc", "mit", "", "all-rights-reserved"]
    a = license_scan.compile_template("x", "a <<replace:1-2>> b <<optional>> c d <<end>> e")
    ends = [a.match([w.encode() for w in t.split()], 0) for t in ("a x b e", "a x y b c d e", "a b e", "a x b c e", "a x y z b e")]
    assert ends == [4, 7, -1, -1, -1]


def test_url_rules_and_nulls(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/x?y#z", "https://a.org", "https://a.org/", "https://sub.x.com/fr/a", "https://x.com/de/a", "https://example.org/en/12", "https://casino-win.net/en/4", "https://therha.net/en/676"]
    got = url_filter.url_report(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r.rule for r in got] == [None, None, None, "example.org/es/", None, "org/", "com/fr/", "com/de/", "example.org/en/1", None, None]
    assert got[3].host == "example.org" and got[3].path == "/es/x" and got[0].host == got[2].host == ""
    assert [r.verdict for r in got[3:4] + got[5:]] == ["block", "allow", "allow", "block", "block", "block", "allow"]


def plain_print(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    h = [xxhash.xxh64_intdigest(" ".join(s), seed=42) for s in ([w[i : i + 3] for i in range(len(w) - 2)] or ([w] if w else []))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components_of(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_simhash_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = simhash.duplicate_report(docs).collect()
    prints = [(d, plain_print(t)) for d, t in texts.items()]
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{p:016x}" for d, p in prints}
    assert {r.doc_id: r.component_id for r in got} == components_of(prints)
    kept = sorted(r.doc_id for r in simhash.deduplicate(docs).collect())
    assert kept == sorted(set(components_of(prints).values()))


def test_simhash_chains_in_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 20)
    rnd = random.Random(4)
    prints = set()
    for _ in range(15):
        x = rnd.getrandbits(64)
        for _ in range(30):
            x ^= 1 << rnd.randrange(64)
            prints.add(x)
    rows = [(k * 3, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    found = dict(simhash.components(simhash.links(spark.createDataFrame(rows, "node long, f0 long"))).collect())
    assert {n: found.get(n, n) for n, _ in rows} == components_of([(n, p % (1 << 64)) for n, p in rows])


def test_simhash_edges(spark):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(spark, EDGE)).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[7] == got[6] == 6
    rows = spark.createDataFrame([(None, "one two three four"), (5, "one two three four"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id) for r in simhash.near_duplicates(rows).where("component_id IS NOT NULL").collect()) == [(False, 5), (True, 5)]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def shingles(text, n=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar_components(texts):
    """By the rule between all pairs, one by one: some 32-bit segment of the words' part within one bit, and both parts within their radius."""
    prints = [[x % (1 << 64) for x in simhash.similar_fingerprint(t.encode())] for t in texts]
    part = list(range(len(texts)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            x = [p ^ q for p, q in zip(a, b)]
            if sum(map(int.bit_count, x[:3])) <= 22 and sum(map(int.bit_count, x[3:])) <= 28 and any((y >> s & 0xFFFFFFFF).bit_count() <= 1 for y in x[:3] for s in (0, 32)):
                r, q = sorted((find(i), find(j)))
                part[q] = r
    return [find(i) for i in range(len(texts))]


def test_simhash_similar_texts(spark):
    """Near copies by the similarity of their five-word shingles are caught, others stay; equal ids of unlike texts stay."""
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8)))
    texts, pairs = [], []
    for k in range(150):
        base = [word() for _ in range(rnd.randint(60, 400))]
        copy = list(base)
        for _ in range(len(base) // 70):
            copy[rnd.randrange(len(copy))] = word()
        texts += [" ".join(base), " ".join(copy)]
        a, b = map(shingles, texts[-2:])
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append(k)
    shuffled = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in texts[:20:2]]  # the same words in another order
    docs = docs_of(spark, [*texts, *shuffled])
    kept = {r.doc_id for r in simhash.deduplicate(docs, simhash.SIMILAR).collect()}
    assert sum(2 * k + 1 not in kept for k in pairs) >= 0.9 * len(pairs) > 90
    assert all(2 * k in kept for k in range(150)) and all(k in kept for k in range(300, 310))
    odd = spark.createDataFrame([(1, "one two three four five"), (1, "six seven eight nine ten"), (1, "one two three four five"), (None, "one two three four five"), (None, "eleven"), (7, None), (8, "")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.text or "") for r in simhash.deduplicate(odd, simhash.SIMILAR).collect())
    assert rows == [(0, "eleven"), (1, "one two three four five"), (1, "six seven eight nine ten"), (7, "")]
    assert simhash.deduplicate(odd.limit(0), simhash.SIMILAR).count() == 0


def test_simhash_similar_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = {r.doc_id for r in simhash.deduplicate(docs, simhash.SIMILAR).collect()}
    part = similar_components([t or "" for _, t in rows])
    assert kept == {rows[k][0] for k, p in enumerate(part) if k == p}
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    meets = Counter((a, b) for ks in holders.values() if len(ks) < 100 for i, a in enumerate(ks) for b in ks[:i])
    near = {a for (a, b), n in meets.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    assert len(near) > 20 and sum(rows[a][0] not in kept for a in near) >= 0.9 * len(near)


def test_sharding(spark):
    rnd = random.Random(6)
    texts = ["copy " * 50] * 400 + ["t" * rnd.randint(0, 900) + str(k) for k in range(800)] + [None, ""]
    rows = sharding.shard_report(docs_of(spark, texts)).collect()
    size = Counter()
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None)
        size[r.shard] += r.size
    assert len(rows) == len(texts) and set(size) == set(range(24)) and max(size.values()) - min(size.values()) < 0.1 * sum(size.values()) / 24
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_report(docs_of(spark, texts).limit(0)).count() == 0


def test_sharding_cuts_hot_texts_without_ids(spark):
    """By brute force: the shards are the order of all rows cut at even bytes, and no range keeps over the limit."""
    rnd = random.Random(16)
    rows = [(None, "hot text")] * 900 + [(5, "same row")] * 500 + [(k, "t" * rnd.randint(0, 300)) for k in range(600)] + [(None, None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = sharding.stored(docs.select("doc_id", "text", *sharding._sized(docs, "text", "doc_id"), F.monotonically_increasing_id().alias("tie")))
    assert max(r["count"] for r in sharding._cut_again(keyed.withColumn("range", F.lit(0).cast("long")), 100).groupBy("range").count().collect()) <= 100
    got = sharding._placed(keyed, 7, 0.0, 100).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    total, at, want, slots = sum(r.size for r in got), 0, {}, Counter()
    for r in sorted(got, key=lambda r: (r.key, r.sub, r.tie)):
        shard = at * 7 // total
        want[r.tie] = (shard, slots[shard])
        slots[shard] += 1
        at += r.size
    assert {r.tie: (r.shard, r.slot) for r in got} == want


def test_write_shards(spark, tmp_path):
    rows = [(k % 50 or None, f"text {k % 120}" * (k % 9), k, str(k)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long, Slot string")
    name = sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "_shard" and sorted(map(tuple, back.select("doc_id", "text", "shard", "Slot").collect()), key=repr) == sorted(rows, key=repr)
    assert {r[name] for r in back.select(name).distinct().collect()} == set(range(5))


def test_toxicity_learns_and_keeps_labels_out(spark):
    rnd = random.Random(8)
    clean = [f"w{k}" for k in range(300)]
    texts, marks = [], []
    for k in range(600):
        bad = k % 5 == 0
        w = [rnd.choice(clean) for _ in range(rnd.randint(5, 60))]
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["awful", "nastyish", "nastyest"])
        texts.append(" ".join(w))
        marks.append(int(bad))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, 0, m) for k, m in enumerate(marks)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_report(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == marks[r.doc_id] for r in held) / len(held) > 0.95
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity_report(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)
    edge = toxicity.toxicity_report(docs_of(spark, EDGE), labels.limit(0)).collect()
    assert len(edge) == len(EDGE) and {r.score for r in edge} == {0.0}
    model = toxicity.train([t.encode() for t in texts], marks, [k % 4 == 3 for k in range(600)], ["en"] * 600)
    long = (" ".join(clean) + " ") * 300 + "awful"
    assert toxicity.Scorer(model).scores([toxicity.words(long.encode())])[0] > 0.3
    found, c = toxicity.score(docs_of(spark, EDGE), model)
    assert all(0 <= r[c] <= 1 for r in found.collect())


def toxic_rows(rnd, n, langs):
    clean = [f"w{k}" for k in range(200)]
    texts, marks = [], []
    for k in range(n):
        w = rnd.choices(clean, k=rnd.randint(5, 40))
        if k % 3 == 0:
            w[rnd.randrange(len(w))] = {"en": "awful", "de": "furchtbar"}[langs[k]]
        texts.append(" ".join(w))
        marks.append(int(k % 3 == 0))
    return texts, marks


def test_toxicity_thresholds_by_language_and_plain_convolution(spark):
    rnd = random.Random(13)
    langs = ["de" if k % 4 == 1 else "en" for k in range(600)]
    texts, marks = toxic_rows(rnd, 600, langs)
    model = toxicity.train([t.encode() for t in texts], marks, [k % 3 == 1 or k % 2 == 0 for k in range(600)], langs)
    assert set(model.thresholds) == {"en", "de"} or set(model.thresholds) == {"en"}  # a language needs LANGUAGE_LEAST positives of its own
    odd = toxicity.Model(model.table, model.filters, model.bias, model.out, model.shift, None, {"de": 2.0, "en": -1.0})
    docs = spark.createDataFrame([(k, "text", lang) for k, lang in enumerate(["de", "en", "fr", None])], "doc_id long, text string, lang string")
    found, c = toxicity.score(docs, odd)
    got = {r.doc_id: (r[c], r.x) for r in found.withColumn("x", toxicity.rejected(docs, odd, c)).collect()}
    assert [got[k][1] for k in range(4)] == [False, True, got[2][0] >= 0.3, got[3][0] >= 0.3]
    for text in ["", "awful", " ".join(texts[:3]), "w1 " * 70_000 + "awful w2"]:
        ws = toxicity.words(text.encode())
        vectors = [model.table[toxicity.features(w)].sum(axis=0) for w in ws] or [np.zeros(toxicity.DIM)]
        logit = model.shift
        for width, kernel in model.filters.items():
            padded = [*vectors, *[np.zeros(toxicity.DIM)] * (width - 1)]
            seen = {}
            peak = np.full(toxicity.FILTERS, -np.inf)
            for i in range(len(vectors)):
                key = (*ws[i : i + width],)
                if key not in seen:
                    seen[key] = sum(padded[i + k] @ kernel[k] for k in range(width))
                peak = np.maximum(peak, seen[key])
            logit += (np.maximum(peak + model.bias[width], 0) * model.out[width]).sum()
        assert toxicity.Scorer(model).scores([ws])[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)


def test_toxicity_training_rows_are_bounded(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, *rest: taken.append(texts))
    docs = spark.createDataFrame([(k % 40, f"text {k % 80}", "en") for k in range(4000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    allowed = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2]
    toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 50)
    toxicity.fit(docs, labels)
    assert len(taken[0]) == len(allowed) and 0 < sum(map(len, taken[1])) <= 50


def test_decontamination_edges(spark, monkeypatch):
    items = [(1, "a b c d e f g h i j k"), (2, "short one"), (3, None), (4, ""), (5, "solo"), (1, "a b c d e f g h i j k")]
    texts = EDGE + ["x A b, c d e f g h i j y", "A b c d e f g h i j k z", "short ONE short one", "nothing", "solo"]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def brute(t):
        w, hit, ids = plain_words(t), set(), set()
        for item, text in items:
            x = plain_words(text)
            n = min(len(x), 10)
            for s in range(max(len(x) - 9, 1) if x else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == x[s : s + n]:
                        hit |= set(range(i, i + n))
                        ids.add(str(item))
        return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)

    for size, blocks in ((8 << 20, 4), (80, 100), (80, 1)):  # one table, several, and the join
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontaminate, "BLOCKS", blocks)
        rows = decontaminate.contamination(docs_of(spark, texts), bench).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in rows] == [brute(t) for t in texts]
    extra = docs_of(spark, texts).withColumn("passages", F.lit(1))
    assert decontaminate.decontaminate(extra, bench).columns == extra.columns
    assert decontaminate.contamination(docs_of(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_table_stays_small():
    """Arrays take a bounded number of bytes for each byte of benchmark text; finds what a plain search finds."""
    rnd = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 9, 10, 40, 200]))).encode()) for k in range(800)]
    size = sum(len(t) for _, t in items)
    scanner = decontaminate.Scanner(items, 10)
    assert sum(a.nbytes for t in scanner.tables for a in (t.flat, t.starts, t.items, t.first, t.begin)) + sum(len(t.shift) for t in scanner.tables) < 20 * size
    text = [w for _ in range(40) for w in (*rnd.choices(vocabulary, k=30), *items[rnd.randrange(800)][1].decode().split())]
    whole, hit, found = " " + " ".join(text) + " ", set(), set()
    for k, t in items:
        w = t.decode().split()
        n = min(10, len(w))
        for i in range(len(w) - n + 1):
            s = " " + " ".join(w[i : i + n]) + " "
            at = whole.find(s)
            while at >= 0:
                first = whole.count(" ", 0, at)
                hit |= set(range(first, first + n))
                found.add(str(k))
                at = whole.find(s, at + 1)
    spans, names = scanner.scan([w.encode() for w in text])
    assert {i for a, b in spans for i in range(a, b)} == hit and names == found


def test_chat_round_trip():
    rnd = random.Random(9)
    parts = ["[INST]", "[/INST]", "</s>", "<s>", "[\\INST]", "<<SYS>>", "\\", "<", "[", " ", "a", "[TURN]", "/INST]", "\n", "é"]
    render = chat.compile_template(chat.TEMPLATE)
    for _ in range(400):
        m = [{"role": rnd.choice(["user", "assistant", "system", "tool", "", "[ROLE]"]), "text": "".join(rnd.choices(parts, k=rnd.randint(0, 8)))} for _ in range(rnd.randint(0, 5))]
        text, spans = render(m)
        assert chat.read_back(text) == [(x["role"], x["text"]) for x in m]
        assert [chat.unescape(text[a:b]) for a, b in spans] == [x["text"] for x in m if x["role"] == "assistant"]


def test_template_language():
    t = "{% set x = 'a' + 'b' %}{{ x | upper }}{% if 1 < 2 %}yes{% else %}no{% endif %}{% for m in messages %}{{ m['role'] }}:{{ m.text | length }};{% endfor %}"
    assert chat.compile_template(t)([{"role": "u", "text": "abc"}])[0] == "AByesu:3;"
    assert chat.fold_all(chat.parse("a{% if 1 == 1 and not false %}{{ 'b' + 'c' }}{% endif %}d")) == [("text", "abcd")]
    for bad in ("{{ messages.__class__ }}", "{{ unknown }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)([])
    for bad in ("{% for x in %}", "{% import os %}", "{{ 1 | eval }}", "{% if true %}", "{{ f() }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_chat_nulls(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, None, "x"), (None, 0, "user", "y"), (1, 2, "user", "z"), (1, 2, "user", "z")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest_report(chat.format_conversations(rows)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 0 and got[None].n_turns == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"\nx\nassistant\n\nuser\nz\nuser\nz\n").hexdigest()


def test_top_k_among_equal_vectors_with_repeated_query_id():
    data = np.array([[4.0, 0.0]] * 20)
    ids = np.array([0] * 6 + list(range(1, 15)))
    s = topk_search.Search(np.array([[4.0, 0.0]]), np.array([0]), data, ids, 5)
    assert s.scores[0].tolist() == [16] * 5 and sorted(ids[s.found[0]]) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("spread", [1.0, 1e3, 4e5, 1e12])
def test_topk_is_exact_for_large_components(spark, spread):
    """In floating point, in 64 bits, and beyond."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, spread, (400, 12)) * 1024) / 1024
    if spread == 1e12:  # far apart in size, so that scores fit in a long
        x[:, 1:] /= 1e12
        x[::2, 0] = 0.0
        x[1::2, 0] /= 1e8
    rows = [(k, x[k % 350].tolist()) for k in range(400)]
    got = sorted(tuple(r) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).collect())
    whole = [[int(np.floor(c * 1024)) for c in v] for _, v in rows]
    want = []
    for q in range(0, 400, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in enumerate(whole) if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_topk_rounds_skip_cells_of_clustered_data(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "DATA_BLOCK", 40)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 12)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 8) * 60 + rng.normal(0, 0.2, (100, 8)) for _ in range(8)])
    rows = [(k, v.tolist()) for k, v in enumerate(x[rng.permutation(800)])] + [(5, x[0].tolist())] * 300
    sent = []
    whole_round = topk_search._round

    def watched(routed, asking, cells, blocks, visit, *rest):
        sent.append((sum(map(len, visit.values())), len(cells) * len(blocks)))
        return whole_round(routed, asking, cells, blocks, visit, *rest)

    monkeypatch.setattr(topk_search, "_round", watched)
    got = sorted(tuple(r) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect())
    whole = [(i, [int(np.floor(c * 1024)) for c in v]) for i, v in rows]
    want = []
    for q, v in whole[:800:10]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert sum(s for s, _ in sent) < 0.6 * sent[0][1]


def test_html(spark):
    page = html_extract.Page
    assert page("<div>x<p>a<b>b</p><p>c &lt; d < e &amp;am &nbsp; z<ul><li>1<li>2</ul></div>tail<br>x<script>a</p></script>").text() == "x\nab\nc < d < e &am z\n1\n2\ntail x"
    assert page('<body><div class="cookie-notice">C</div><header>H</header><main><h1>T</h1><p>one\n two</p><section id="comments"><p>bad</p></section></main><footer>F</footer>').text() == "T\none two"
    assert page("<" * 50 + "<div>" * 5000 + "deep").text().endswith("deep")
    site = "<body><div><p>Site wide line</p></div><div><p>Own text {}</p></div></body>"
    rows = [(k, "https://a.example/x", site.format(k)) for k in range(12)] + [(99, None, site.format(99)), (100, "https://b.example/", None), (101, "https://b.example/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (100, 0):
        found, c = html_extract.extract(pages, broadcast_rows=limit)
        got = {r.page_id: r[c] for r in found.collect()}
        assert got[3] == "Own text 3" and got[99] == "Site wide line\nOwn text 99" and got[100] == got[101] == ""
    assert html_extract.main_text_report(pages.limit(0)).count() == 0


def test_html_template_inside_articles(spark):
    rnd = random.Random(5)
    words = lambda n: " ".join(rnd.choices([f"w{k}" for k in range(900)], k=n))
    box = "<p>Read our <em>other</em> stories</p>"
    copied, quote = words(80), f"<blockquote>{words(9)}</blockquote>"
    own = [words(60) for _ in range(20)]
    bodies = [f"<h2>Facts</h2><p>{own[k]} <em>other</em></p>{quote if k < 5 else ''}{box}<ul><li>item {k}</li><li>yes</li></ul>" for k in range(20)]
    bodies += [f"<p>{copied}</p><p>{words(1)}</p>" for _ in range(20)]  # near copies of one article
    html = [f"<body><nav>menu</nav><article>{b}</article></body>" for b in bodies]
    pages = spark.createDataFrame([(k, "https://a.example/x", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    for limit in (100, 0):
        found, c = html_extract.extract(pages, broadcast_rows=limit)
        got = {r.page_id: r[c] for r in found.collect()}
        assert all("stories" not in t for t in got.values())
        assert all(got[k].startswith(f"Facts\n{own[k]} other") and got[k].endswith("yes") for k in range(20))
        assert got[0] == html_extract.Page(html[0].replace(box, "")).text()  # a quotation on five pages stays
        assert all(copied in got[k] for k in range(20, 40))


def test_html_keeps_main_text_and_time_in_proportion():
    page = html_extract.Page
    kept = '<body><article><header class="post-header"><h1>T</h1></header><p>a</p><div class="foot-note">n</div><section class="discussion"><p>d</p></section><math>x+y</math></article><article><p>second</p></article><div class="ad">x</div></body>'
    assert page(kept).text() == "T\na\nn\nd\nx+y\nsecond"
    assert page('<article><p>one <a href="x>two</a> three</p></article>').text() == "one two three"
    assert page("<article><p>text<p>more <b").text() == "text\nmore"
    for bad in ("<a ", '<a x="', "</a ", "<a x='>", "<script></script ", "<!", "<p><b></p>", "<p><button><b>", "<b></x>"):
        began = time.perf_counter()
        page(bad * 20_000).text()
        assert time.perf_counter() - began < 4, bad


def test_html_template_against_plain_counts(spark):
    """The template from Spark equals that of a plain loop, and decides the text of pages whose menus tell by nothing else."""
    rnd = random.Random(11)
    rows = []
    for k in range(60):
        chrome = f"<div><p>bar {k % 4} of the site</p></div>"
        own = " ".join(rnd.choices([f"w{x}" for x in range(900)], k=40))
        rows.append((k, f"https://{'ab'[k % 2]}.example/{k}", f"<body>{chrome}<article><p>{own} {k}</p></article><div>tail {k}</div></body>" if k % 10 else None))
    rows += [(100 + k, "https://a.example/x", rows[1][2]) for k in range(5)] + [(200, None, rows[1][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen, sites = {}, Counter()
    for _, url, html in rows:
        if url:
            site = url.split("/")[2]
            sites[site] += 1
            mark, found = html_extract.Page(html or "").digests()
            for d, kind in found.items():
                seen.setdefault((site, d, kind), set()).add(mark)
    least = {html_extract.OUTSIDE: 3, html_extract.WITHIN: 10, html_extract.BARE: 3}
    want = {(site, d) for (site, d, kind), s in seen.items() if len(s) >= least[kind] and (kind == html_extract.OUTSIDE or len(s) >= 0.2 * sites[site])}
    assert {tuple(r) for r in html_extract.recurring(html_extract.subtrees(pages)).collect()} == want != set()
    for page_id, url, html in rows:
        if url and html:
            page = html_extract.Page(html)
            known = {d for site, d in want if site == url.split("/")[2]}
            assert "bar" in page.text(rules=False) and ("bar" in page.text(known, rules=False)) == (page_id >= 100)  # copies of one page count once
    a, b = ({r.page_id: r.main_text for r in html_extract.extract(pages, broadcast_rows=n)[0].collect()} for n in (1000, 0))
    assert a == b


def test_sentencepiece_scan(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    lattice = sentencepiece_scan.Lattice(sentencepiece_scan.Vocabulary.load(sentencepiece_scan.MODEL))
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "the", "ing", "▁", "日", "\U0001f600", "\0", "﷐", " the ", "tion", "er"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(120)] + ["".join(rnd.choices("theringao", k=150)) for _ in range(20)]
    for t in texts:
        ids = lattice.encode(t.encode())
        s = lattice.symbols(" " + t)
        assert not t or ids == np.array(lattice.path(s, lattice.best(s, {0: 0})[1], len(s))[1], "<i4").tobytes()
        assert lattice.decode(np.frombuffer(ids, "<i4")).decode() == t
        for size in (1, 2, 5, 17, 40):
            assert sentencepiece_scan.encode_chunked(lattice, t, size) == ids
    model = pb.ModelProto()
    model.ParseFromString(open(sentencepiece_scan.MODEL, "rb").read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM  # the same pieces and scores, segmented by the library's own n-best lattice search
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for t in ["the king in the north", "there is nothing", "a word another", "information retrieval"]:
        ours = np.frombuffer(lattice.encode(t.encode()), "<i4").tolist()
        assert sum(library.get_score(i) for i in ours) == max(sum(library.get_score(library.piece_to_id(p)) for p in found) for found in library.nbest_encode_as_pieces(t, 8))


def test_sentencepiece_distributed_equals_whole(spark):
    docs = docs_of(spark, EDGE + ["thhering" * 900, "thhering" * 900])
    a, b = (sentencepiece_scan.encoding_report(docs, chunk=n).orderBy("doc_id").collect() for n in (1 << 20, 300))
    assert a == b and [r.round_trip for r in a] == [None] + [True] * (len(a) - 1)


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pipeline.run(spark, SF).collect()
    found, c = toxicity.score(docs, model := toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    clean = {r.doc_id: r.text for r in found.where(~toxicity.rejected(docs, model, c)).collect()}
    names = sorted(clean)
    part = similar_components([clean[d] or "" for d in names])
    firsts = {names[k] for k, p in enumerate(part) if k == p}
    dirty = {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in rows} == firsts - dirty
    lattice = sentencepiece_scan.Lattice(sentencepiece_scan.Vocabulary.load(sentencepiece_scan.MODEL))
    assert all(lattice.decode(np.frombuffer(r.ids, "<i4")).decode() == clean[r.doc_id] and r.n_tokens * 4 == len(r.ids) for r in rows)
    assert all(f(spark, docs, SF).columns == docs.columns for _, f in pipeline.STAGES[:-1])
