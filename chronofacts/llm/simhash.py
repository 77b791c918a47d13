"""SimHash near-dedup by multi-index hashing.

A fingerprint is one or more parts; a bit of a part is 1 if it is set in over half of the part's hashes. Two fingerprints link if some
32-bit segment of the first part differs in one bit at most, and every part in no more bits than the part's radius. There are two rules:

- ``CLOSE``: lower-case A-Z, words between ASCII white space, shingles of three words (fewer words: the whole
  sequence), XXH64 with seed 42 of each shingle, repeats included; 64 bits, 3 of which may differ.
- ``SIMILAR``, for texts whose sets of five-word shingles have a similarity of 0.8 or more: 192 bits of the distinct words, of which 22 may
  differ, and 128 bits of the shingles of five words, of which 28 may differ. Shared words find the candidates, as an edited word changes one
  word but five shingles; the second part tells texts of the same words in another order.

No words, or a null text: all parts are zero.

For ``CLOSE`` the segments exclude nothing, as 3 bits fall on two of them. For ``SIMILAR`` they belong to the rule: of 1,000 sampled pairs of similar texts
of a test table 97 % link. Links are found by multi-index hashing, none is lost. Each distinct fingerprint enters a table under its
segments, enumerates the Hamming ball of radius 1 of each segment (33 keys), fetches the table's matches and verifies complete distances. Copies share a
fingerprint, so groups of copies cost one row. A bucket is verified as a whole, by a search that expands each
fingerprint once, and gives a spanning star of each part that hangs together, never its pairs. Buckets of over ``BUCKET``
fingerprints are dealt out as pairs of blocks; every two members meet in one of them, so no link is lost.
Components come from rounds of large-star and small-star steps on pairs of nodes, each written to the shared folder.

``near_duplicates``: repeated doc_ids are one node. A null doc_id has a fingerprint, and the smallest non-null doc_id of its component; null if there is none.
``deduplicate`` goes by rows: rows with one doc_id but texts that do not link all stay. Empty tables give empty results; columns that are added have names that no column has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column, fresh_name, stored

SHINGLE = 3
SEED = 42


@dataclass(frozen=True)
class Rule:
    """Parts of a fingerprint as (64-bit numbers, bits that may differ); the first part is cut into 32-bit segments."""

    name: str
    parts: tuple[tuple[int, int], ...]

    @property
    def columns(self) -> list[str]:
        return [f"f{k}" for k in range(sum(n for n, _ in self.parts))]

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which rows of ``left`` link to which of ``right``: arrays of 64-bit numbers, a column each."""
        out, at = None, 0
        for n, radius in self.parts:
            apart = sum(np.bitwise_count(left[:, None, k] ^ right[None, :, k]).astype(np.int16) for k in range(at, at + n)) <= radius
            out, at = apart if out is None else out & apart, at + n
        return out


CLOSE = Rule("close", ((1, 3),))
SIMILAR = Rule("similar", ((3, 22), (2, 28)))
#: Distinct fingerprints of a bucket that one task compares at once; larger buckets are dealt out in blocks.
BUCKET = 4096
_HASHES = 1 << 16
#: A key on more than this share of the rows is joined by a broadcast: there are at most 1 / HOT of them.
HOT = 1e-3


def fingerprint(text: bytes | None) -> int:
    """64 bits, as a signed number."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    h, digest = xxhash.xxh64_intdigest, b" ".join
    if len(words) < SHINGLE:
        hashes = [h(digest(words), SEED)]
    else:
        hashes = [h(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES):
        bits = np.unpackbits(np.array(hashes[i : i + _HASHES], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """64 new bits from 64 bits, by the finaliser of splitmix64."""
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _majority(hashes: np.ndarray, numbers: int, salt: int) -> list[int]:
    """The bits that are set in over half of the hashes; each hash is mixed into as many numbers as wanted."""
    out = []
    for k in range(numbers):
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), _HASHES):
            mixed = _mixed(hashes[i : i + _HASHES], salt + k)
            counts += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0]))
    return out


def similar_fingerprint(text: bytes | None) -> list[int]:
    """The parts of ``SIMILAR``: of the distinct words, and of the runs of five words (all words, if they are fewer), repeats included."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return [0] * len(SIMILAR.columns)
    h = xxhash.xxh64_intdigest
    seen = {w: h(w, SEED) for w in dict.fromkeys(words)}
    one = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    runs = max(1, len(words) - 4)
    joint = np.zeros(runs, np.uint64)
    for k in range(min(5, len(words))):
        joint = _mixed(joint ^ one[k : k + runs], 101 + k)
    return _majority(np.fromiter(seen.values(), np.uint64, len(seen)), 3, 1) + _majority(joint, 2, 11)


def with_fingerprint(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the fingerprint of ``CLOSE`` as one more long column, and that column's name."""
    name = fresh_name(docs, "simhash")
    return add_column(docs, name, T.LongType(), text, lambda: lambda texts: [fingerprint(x) for x in texts]), name


def _keys(rule: Rule) -> tuple:
    """Bucket keys of a fingerprint: its own, and those one bit away. A key is a segment's 32 bits and, above them, which segment it is."""
    one = F.lit(1).cast("long")
    halves = [x for k in range(rule.parts[0][0]) for x in (F.col(f"f{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"f{k}", 32))]
    own = F.array(*(x.bitwiseOR(F.lit(k << 32)) for k, x in enumerate(halves)))
    ball = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.transform(own, lambda k: k.bitwiseXOR(F.call_function("shiftleft", one, i)))))
    return own, ball


def _expand(fps: np.ndarray, rule: Rule) -> np.ndarray:
    """Each member's part, as the index of the part's first member: every member is compared with the unreached ones once."""
    n = len(fps)
    part = np.arange(n)
    left = np.arange(n)
    while len(left):
        first, left = left[0], left[1:]
        ahead = [first]
        while ahead and len(left):
            block = np.array(ahead[:64])
            ahead = ahead[64:]
            near = rule.near(fps[left], fps[block]).any(axis=1)
            part[left[near]] = first
            ahead += left[near].tolist()
            left = left[~near]
    return part


def _stars(key: np.ndarray, fp: np.ndarray, node: np.ndarray, rule: Rule) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(node, smaller node) rows of buckets; rows are sorted by key. A node that a bucket holds twice counts once."""
    a, b = [], []
    edges = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.r_[0, edges], np.r_[edges, len(key)]
    twos = starts[ends - starts == 2]
    if len(twos):
        same, at = np.ones(len(twos), bool), 0
        for n, radius in rule.parts:
            same &= sum(np.bitwise_count(fp[twos, k] ^ fp[twos + 1, k]).astype(np.int16) for k in range(at, at + n)) <= radius
            at += n
        x, y = node[twos[same]], node[twos[same] + 1]
        a.append(np.maximum(x, y))
        b.append(np.minimum(x, y))
    for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
        nodes, at = np.unique(node[s:e], return_index=True)
        part = _expand(fp[s:e][at], rule)
        far = part != np.arange(len(nodes))
        a.append(nodes[far])
        b.append(nodes[part[far]])
    return a, b


def _searcher(rule: Rule):
    """Buckets arrive whole and sorted within a partition; a bucket that spans batches waits for its end."""

    def out(t: pa.Table) -> pa.RecordBatch:
        fps = np.stack([t[c].to_numpy().view(np.uint64) for c in rule.columns], axis=1)
        a, b = _stars(t["key"].to_numpy(), fps, t["node"].to_numpy(), rule)
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(join(a)), pa.array(join(b))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            whole = pc.index(t["key"], t["key"][-1]).as_py()
            if whole:
                yield out(t.slice(0, whole).combine_chunks())
            rest = t.slice(whole)
        if rest is not None:
            yield out(rest.combine_chunks())

    return run


def links(prints: DataFrame, rule: Rule = CLOSE) -> DataFrame:
    """(u, v) with v < u: enough links between the nodes of ``prints`` (the rule's columns, node; fingerprints distinct) to connect all that link."""
    own, ball = _keys(rule)
    table = prints.select(F.explode(own).alias("key"), "node")
    # Probes travel as (key, node); fingerprints join what is left of them.
    probes = prints.select(F.explode(ball).alias("key"), "node").join(table.select("key"), "key", "left_semi")
    members = stored(table.unionByName(probes))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Buckets of one member go; those over BUCKET become pairs of blocks, each member in a row with every block.
    blocks = F.ceil(F.col("n") / BUCKET).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        members.join(sizes.select("key", blocks.alias("blocks")), "key")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"), "node")
    )
    dealt = dealt.join(prints.select("node", *rule.columns), "node")
    n = dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # The key alone may be one of few hot buckets, but blocks bound it; two buckets under one hashed key only compare more.
    return dealt.repartition(int(n), "key").sortWithinPartitions("key").select("key", "node", *rule.columns).mapInArrow(_searcher(rule), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (u, v), by large-star and small-star rounds."""
    edges = stored(edges)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u")
        if large:
            return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    edges, before = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), None
    while (now := mark(edges)) != before:
        before = now
        edges = stored(star(star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("v", "v").distinct().toDF("node", "component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, by ``CLOSE``: doc_id, fingerprint (long), component_id."""
    named, fp = with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    prints = stored(named.select("doc_id", F.col(fp).alias("f0")))
    # A node is the smallest doc_id of a fingerprint; fingerprints without one can't carry a component on, but link through it.
    nodes = stored(prints.groupBy("f0").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    if nodes.where("least IS NULL").isEmpty():
        known = nodes.select("f0", F.col("least").alias("node"), "rows")
        classes = known.join(components(links(known)), "node", "left").select("f0", "rows", F.coalesce("component", "node").alias("component_id"))
    else:  # fingerprints stand for themselves, then each component takes its smallest doc_id
        reached = components(links(nodes.select("f0", F.col("f0").alias("node"))))
        named = nodes.join(reached, nodes["f0"] == reached["node"], "left").select("f0", "least", "rows", F.coalesce("component", "f0").alias("c"))
        classes = named.join(named.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("f0", "rows", "component_id")
    # Fingerprints of many documents are few, so they are broadcast; no task gets all rows of one.
    total = nodes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    classes = stored(classes)
    hot, rest = F.broadcast(classes.where(F.col("rows") > HOT * total).drop("rows")), classes.where(F.col("rows") <= HOT * total).drop("rows")
    out = prints.join(hot, "f0").unionByName(prints.join(hot.select("f0"), "f0", "left_anti").join(rest, "f0"))
    return out.select("doc_id", F.col("f0").alias("fingerprint"), "component_id")


def duplicate_report(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the fingerprint as 16 lowercase hex digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, rule: Rule = CLOSE) -> DataFrame:
    """One row of each component, with its own columns: the one with the smallest doc_id (nulls last), then the smallest text digest (nulls last). Of equal doc_ids and texts one row stays."""
    digest, name = fresh_name(docs, "text_digest"), "fp"
    narrow = docs.select(F.col("doc_id").alias("doc_id"), F.sha2("text", 256).alias("digest"), F.col("text").alias("text"))
    make = (lambda: lambda texts: [[fingerprint(x)] for x in texts]) if rule is CLOSE else (lambda: lambda texts: [similar_fingerprint(x) for x in texts])
    printed = add_column(narrow, name, T.ArrayType(T.LongType()), "text", make)
    prints = stored(printed.select("doc_id", "digest", *(F.get(name, k).alias(c) for k, c in enumerate(rule.columns))))
    # Nulls come last; the number of a node is kept with it, so it stays what it is.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("digest").isNull().alias("no_text"), "digest")).alias("first")
    nodes = stored(prints.groupBy(*rule.columns).agg(first).withColumn("node", F.monotonically_increasing_id()))
    reached = components(links(nodes.select(*rule.columns, "node"), rule))
    kept = nodes.join(reached, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("_id"), F.col("first.digest").alias("_digest"))
    named, rank = docs.withColumn(digest, F.sha2("text", 256)), fresh_name(docs, "kept_rank")
    chosen = named.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col(digest).eqNullSafe(F.col("_digest")), "left_semi")
    order = Window.partitionBy("doc_id", digest).orderBy(F.lit(0))
    return chosen.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*(F.col(c) for c in docs.columns))
