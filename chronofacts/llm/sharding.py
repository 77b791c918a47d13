"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by (hash of the text, hash of doc_id, tie), so copies of a text stand together; the tie tells rows apart that agree in
both. A sample of keys, each record's chance in proportion to its size, gives splitters at even steps of the sample: they cut the order into
ranges of about equal bytes. The ranges are measured, and those of over ``RANGE_ROWS`` rows are cut again by splitters drawn from them alone, until none is left; so
their number grows with the table and the rows of one do not, also where a third of all rows have the same text, with or without doc_ids. Exact sizes
of the ranges are summed up, and within each range a running sum places every record at its exact
offset in the order of all bytes. Shard ``k`` of ``n`` takes the offsets from k/n to (k+1)/n of the total: the law is ``bytes``,
and two shards differ by two records' sizes at most, or by a group of copies that stays whole.

``whole``: copies stay in one shard if together they have at most this share of a shard's bytes (and stand in one range); 0 lets every group be
cut, and the larger it is, the less equal are the shards.

Nulls: a null text has no bytes and the checksum of no bytes; null doc_ids are one doc_id, told apart by the tie. Repeated rows get a place each. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, stored

SHARDS = 24
OVERHEAD = 8
#: Expected sample size: a constant, so what reaches the driver does not grow with the input.
SAMPLE = 8192
#: First ranges for each shard, and rows beyond which a range is cut again; a window sorts one range in one task.
RANGES, RANGE_ROWS = 16, 2_000_000
#: Pieces into which a range is cut again, and sampled keys for each piece.
PIECES, KEYS = 64, 16
#: Default of ``whole``.
WHOLE = 0.01
#: Leading bits of a key that choose the splitters it is compared with.
_BITS = 10
_LEAST = -(1 << 63)


def _draw(chance: Column) -> Column:
    """Poisson sampling by a hash of the key, so a recomputed task draws the same records."""
    return (F.xxhash64("key", "sub", "tie", F.lit("draw")) / F.lit(float(1 << 64))) + F.lit(0.5) < chance


def _splitters(keyed: DataFrame, total: int, ranges: int) -> list[tuple[int, int, int]]:
    """(key, sub, tie) at which a new range begins, in order: at the first record with a key, unless that begins a range already."""
    got = sorted(tuple(r) for r in keyed.where(_draw(F.col("size") * F.lit(SAMPLE / max(total, 1)))).select("key", "sub", "tie").collect())
    out: list[tuple[int, int, int]] = []
    for i in range(1, ranges if got else 0):
        key, sub, tie = got[i * len(got) // ranges]
        hot = bool(out) and out[-1][0] == key
        at = (key, sub, tie) if hot else (key, _LEAST, _LEAST)
        if at not in out[-1:]:
            out.append(at)
    return out


def _past(m: Column) -> Column:
    """Whether a record has reached a splitter."""
    return (F.col("key") > m["key"]) | ((F.col("key") == m["key"]) & ((F.col("sub") > m["sub"]) | ((F.col("sub") == m["sub"]) & (F.col("tie") >= m["tie"]))))


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters a record has reached.

    The leading bits of its hash point into a literal array: how many splitters lie below all hashes with these
    bits. Only the few splitters that share them are compared.
    """
    if not splitters:
        return F.lit(0).cast("long")
    half = 1 << (_BITS - 1)
    counts = [0] * (2 * half + 1)
    for key, _, _ in splitters:
        counts[(key >> (64 - _BITS)) + half + 1] += 1
    below = F.expr(f"array({', '.join(map(str, accumulate(counts)))})")
    number = lambda x: f"{x}L" if x > _LEAST else f"({_LEAST + 1}L - 1L)"
    marks = F.expr("array(" + ", ".join(f"named_struct('key', {number(a)}, 'sub', {number(b)}, 'tie', {number(c)})" for a, b, c in splitters) + ")")
    at = (F.shiftright("key", 64 - _BITS) + half).cast("int")
    first = F.get(below, at)
    near = F.slice(marks, first + 1, F.get(below, at + 1) - first)
    return (first + F.size(F.filter(near, _past))).cast("long")


def _cut_again(ranged: DataFrame, limit: int) -> DataFrame:
    """``ranged`` with every range of over ``limit`` rows subdivided, until there is none or none can be cut."""
    before = None
    while True:
        over = stored(ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).where(F.col("rows") > limit))
        now = over.agg(F.count(F.lit(1)), F.sum("rows"), F.max("rows")).first()
        if not now[0] or tuple(now) == before:
            return ranged
        before = tuple(now)
        # At most PIECES * KEYS keys of a range meet in one row, as expected; such ranges are few, as each has over ``limit`` rows.
        inside = ranged.join(F.broadcast(over.select("range", "rows")), "range")
        marks = inside.where(_draw(F.lit(PIECES * KEYS) / F.col("rows"))).groupBy("range").agg(F.sort_array(F.collect_list(F.struct("key", "sub", "tie"))).alias("drawn"))
        pick = F.transform(F.sequence(F.lit(1), F.lit(PIECES - 1)), lambda i: F.get("drawn", F.floor(i * F.size("drawn") / PIECES).cast("int")))
        marks = marks.select(F.col("range").alias("cut"), F.array_distinct(pick).alias("marks"))
        joined = ranged.join(F.broadcast(stored(marks)), F.col("range") == F.col("cut"), "left")
        piece = F.coalesce(F.size(F.filter("marks", _past)), F.lit(0))
        ranged = stored(joined.withColumn("range", F.col("range") * PIECES + piece).drop("cut", "marks"))


def _placed(sized: DataFrame, shards: int, whole: float, limit: int) -> DataFrame:
    """``sized`` (size, key, sub, tie and others) with shard and slot."""
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranged = _cut_again(sized.withColumn("range", _range_of(_splitters(sized, total, shards * RANGES))), limit)
    # One row for each range: where it begins in bytes. They are fewer than the records by a factor of RANGE_ROWS or so.
    begin = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    begin = begin.select("range", (F.sum("bytes").over(Window.orderBy("range")) - F.col("bytes")).alias("begin"))
    order = Window.partitionBy("range").orderBy("key", "sub", "tie")
    same = Window.partitionBy("range", "key")
    placed = (
        ranged.join(F.broadcast(begin), "range")
        .withColumn("offset", F.col("begin") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("group_bytes", F.sum("size").over(same))
        .withColumn("group_offset", F.min("offset").over(same))
    )
    at = F.when(F.col("group_bytes") <= F.lit(int(total / shards * whole)), F.col("group_offset")).otherwise(F.col("offset"))
    # A range meets few shards, and slots count on from the ranges before.
    placed = placed.withColumn("shard", F.floor(at.cast("decimal(38,0)") * shards / F.lit(max(total, 1)).cast("decimal(38,0)")).cast("int")).drop("begin", "offset", "group_bytes", "group_offset")
    pieces = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = pieces.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before"))
    within = Window.partitionBy("range", "shard").orderBy("key", "sub", "tie")
    return placed.join(F.broadcast(before), ["shard", "range"]).withColumn("slot", F.col("before") + F.row_number().over(within) - 1)


def _sized(docs: DataFrame, text: str, doc_id: str) -> list[Column]:
    body = F.col(text)
    return [
        (F.coalesce(F.octet_length(body), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("key"), F.xxhash64(F.col(doc_id)).alias("sub"),
    ]


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", whole: float = WHOLE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    crc = F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("text_crc32")
    # The tie is stored with the rows, so it stays what it is.
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), crc, *_sized(docs, text, doc_id), F.monotonically_increasing_id().alias("tie")))
    return _placed(sized, shards, whole, range_rows).select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``assign`` with the law's name and no grown shard."""
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, whole: float = WHOLE) -> str:
    """Write each shard's documents as Parquet under ``folder``/shard=k, in slot order; returns the name of the folder column.

    That is ``shard``, with underscores in front if ``docs`` has a column of that name. Rows are numbered and stored first, so ids may repeat or be null.
    """
    row, shard, slot = (fresh_name(docs, x) for x in ("row_number", "shard", "slot"))
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    placed = _placed(stored(numbered.select(*_sized(numbered, "text", "doc_id"), F.col(row).alias("tie"))), shards, whole, RANGE_ROWS)
    joined = numbered.join(placed.select(F.col("tie").alias("_tie"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")), F.col(row) == F.col("_tie"))
    out = joined.select(*(F.col(c) for c in docs.columns), F.col("_shard").alias(shard), F.col("_slot").alias(slot))
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(folder)
    return shard
