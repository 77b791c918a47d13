"""Snapshot differences against pairing in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from chronofacts.llm import snapshot_diff

COLUMNS, CONTENT = ("text", "lang", "source"), ("text", "lang")
SCHEMA = "key long, text string, lang string, source string"


def digest(x):
    return b"\0" if x is None else b"\1" + hashlib.sha256(x.encode()).digest()


def order(row):
    return b"".join(digest(x) for x in row[1:])


def smallness(key):
    return (key is not None, key or 0)


def plain(earlier, later):
    """Pairs by key, then by content, with lists."""
    out, alone = [], []

    def emit(old, new, same, other):
        changed = ",".join(c for c, a, b in zip(COLUMNS, old[1:], new[1:], strict=True) if a != b)
        out.append((new[0], old[0], other if changed else same, changed, sha(new)))

    def sha(row):
        return hashlib.sha256("\n".join("~" if x is None else x for x in row[1:]).encode()).hexdigest()

    sides = [defaultdict(list), defaultdict(list)]
    for side, rows in enumerate((earlier, later)):
        for r in rows:
            sides[side][r[0]].append(r)
    for key in {*sides[0], *sides[1]}:
        a, b = (sorted(s[key], key=order) for s in sides)
        for x, y in zip(a, b, strict=False):
            emit(x, y, "same", "update")
        n = min(len(a), len(b))
        alone += [(0, r) for r in a[n:]] + [(1, r) for r in b[n:]]
    by = defaultdict(lambda: ([], []))
    for side, r in alone:
        by[r[1:3]][side].append(r)
    for a, b in by.values():
        a.sort(key=lambda r: (smallness(r[0]), order(r)))
        b.sort(key=lambda r: order(r))
        b.sort(key=lambda r: smallness(r[0]), reverse=True)
        for x, y in zip(a, b, strict=False):
            emit(x, y, "rekey", "rekey")
        n = min(len(a), len(b))
        out += [(r[0], r[0], "delete", "", None) for r in a[n:]] + [(r[0], None, "insert", "", sha(r)) for r in b[n:]]
    return Counter(out)


def compared(spark, earlier, later):
    frames = (spark.createDataFrame(x, SCHEMA) for x in (earlier, later))
    got = Counter(tuple(r) for r in snapshot_diff.difference(*frames, "key", COLUMNS, CONTENT).collect())
    assert got == plain(earlier, later)
    return got


def test_nulls_repeats_and_empty_tables(spark):
    a = [(1, "a", "en", "s"), (2, "b", None, "s"), (3, None, None, None), (None, "n", "en", "s"), (None, "m", "en", "s"), (5, "", "en", "s"), (6, "~", "en", "s"), (7, "dup", "de", "x"), (8, "dup", "de", "y"), (9, "dup", "de", None), (10, "a\nen", "en", "s"), (11, "gone", "en", "s"), (12, "c", "en", "s"), (12, "c", "en", "s")]
    b = [(1, "a", "en", "t"), (20, "b", None, "s"), (30, None, None, None), (None, "n", "en", "s"), (40, "m", "en", "q"), (5, None, "en", "s"), (6, None, "en", "s"), (70, "dup", "de", "y"), (80, "dup", "de", "y"), (-1, "dup", "de", "z"), (-2, "dup", "de", "z"), (10, "a", "en", "en\ns"), (12, "c", "en", "s"), (13, "x" * 200_000, "en", "s")]
    got = compared(spark, a, b)
    assert sum(got.values()) > 0
    compared(spark, b, a)
    compared(spark, a, [])
    compared(spark, [], b)
    assert not compared(spark, [], [])


@pytest.mark.parametrize("hot", ["key", "content", "null key"])
def test_hot_groups_are_spread(spark, hot):
    """A third of the rows in one group: results stay right, and no task of the second shuffle holds more than its share."""
    rnd = random.Random(hot)

    def rows(n, first):
        out = []
        for k in range(n):
            key, text = first + k, f"t{rnd.randrange(n)}"
            if k % 3 == 0:
                key, text = (None if hot == "null key" else 7, text) if hot != "content" else (key, "same")
            out.append((key, text, rnd.choice(["en", None]), rnd.choice("ab")))
        return out

    a, b = rows(1500, 0), rows(1400, 900)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        compared(spark, a, b)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ranks_of_one_group_reach_every_partition(spark):
    keyed = spark.sparkContext.parallelize([((b"g", k % 2, k), k) for k in range(4000)], 4)
    ranked = snapshot_diff._ranked(keyed, 4000, 8)
    assert sorted(ranked.collect()) == sorted(((b"g", k // 2, k % 2), k) for k in range(4000))
    assert max(ranked.glom().map(len).collect()) < 1500


def test_later_snapshot_has_every_change(spark):
    import zlib

    docs = spark.createDataFrame([(k, None if k % 7 == 0 else f"t{k}", "en", f"s{k}") for k in range(-50, 400)] + [(None, "n", None, None)], "doc_id long, text string, lang string, source string")
    got = Counter(tuple(r) for r in snapshot_diff.later_snapshot(docs).collect())
    want = []
    for k, t, lang, s in (tuple(r) for r in docs.collect()):
        n = -1 if k is None else zlib.crc32(str(k).encode()) % 25
        if n == 0:
            continue
        t, (lang, s) = (t or "") + "+" if n == 1 else t, (s, lang) if n == 2 else (lang, None if n == 4 else s)
        want += [(x, t, lang, s) for x in ([-1 - k] if n in (3, 4) else [k, -1 - k] if n == 5 else [k])]
    assert got == Counter(want)
