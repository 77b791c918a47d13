"""The difference of two snapshots of a table, with rows that only changed their key found again by content.

Rows travel as digests: SHA-256 of each compared column, so a row is some 130 bytes however long its texts are. Both pairings, by key and
then by content, are the same two steps over an RDD:

1. ``repartitionAndSortWithinPartitions`` by (group, side, order) with sampled splitters. A group that is too large for one partition is cut
   inside; each partition reports its first and last run, and a row's rank in its group and side is its place in its run plus the run's rows in the partitions before.
2. ``repartitionAndSortWithinPartitions`` by (group, rank, side), dealt out by group and rank, so that a hot group spreads evenly. A generator
   merges the two sides as two pointers do: equal group and rank are a pair; it holds one row.

By key: group is the key, order the content. By content, for rows that found no partner: group is the content columns; order is the key, ascending for the earlier side and
descending for the later one, so that the i-th smallest earlier key meets the i-th largest later key.

What reaches the driver is ``DRAWN`` keys and two runs for each shuffle partition, a setting, whatever the input. The state between the pairings is stored in
the shared folder. Equal digests count as equal values.

Nulls: a null equals a null only; so rows with null keys form a group, and a null key is smaller than all others. Repeated keys in a snapshot: the i-th of
the earlier rows, by content digests, pairs with the i-th of the later ones. Repeated rows are rows of their own. Empty tables give no pairs. Other columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Sort keys drawn for each shuffle partition.
DRAWN = 20
EARLIER, LATER = 0, 1
_SCHEMA = "key long, old_key long, op string, changed string, row binary, side int, digests array<binary>"


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c.cast("string").cast("binary"), 256))


def _side(df: DataFrame, side: int, key: str, columns: Sequence[str]) -> DataFrame:
    """side, key, the columns' digests and, of the later side, the digest of the whole row."""
    whole = F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    return df.select(F.lit(side).alias("side"), F.col(key).cast("long").alias("key"), F.array(*(_digest(F.col(c)) for c in columns)).alias("digests"), (_digest(whole) if side == LATER else F.lit(None).cast("binary")).alias("row"))


def _ranked(rows: RDD, count: int, parts: int) -> RDD:
    """``count`` rows ((group, side, order), value) as ((group, rank in the order, side), value)."""
    chance = min(1.0, DRAWN * parts / max(count, 1))
    drawn = sorted(rows.keys().sample(False, chance, 11).collect())
    splitters = [drawn[k * len(drawn) // parts] for k in range(1, parts)] if drawn else []
    ordered = rows.repartitionAndSortWithinPartitions(parts, lambda at: bisect_right(splitters, at))

    def runs(index: int, part: Iterator) -> Iterator:
        first, last, count = None, None, 0
        for (group, side, _), _ in part:
            if (group, side) != last:
                last, count = (group, side), 0
                first = first or last
            count += 1
        if last:
            yield index, first, last, count

    ahead, run, size = {}, None, 0
    for index, first, last, count in sorted(ordered.mapPartitionsWithIndex(runs).collect()):
        ahead[index] = size if first == run else 0
        size = count + (size if first == last == run else 0)
        run = last

    def numbered(index: int, part: Iterator) -> Iterator:
        run, rank = None, ahead.get(index, 0) - 1
        for (group, side, _), value in part:
            rank = 0 if run and run != (group, side) else rank + 1
            run = (group, side)
            yield (group, rank, side), value

    return ordered.mapPartitionsWithIndex(numbered)


def _two_way(part: Iterator) -> Iterator:
    """Sorted ((group, rank, side), value) as pairs (earlier or None, later or None)."""
    held = None
    for (group, rank, side), value in part:
        if held and side == LATER and held[0] == (group, rank):
            yield held[1], value
            held = None
            continue
        if held:
            yield held[1], None
            held = None
        if side == EARLIER:
            held = (group, rank), value
        else:
            yield None, value
    if held:
        yield held[1], None


def _paired(rows: DataFrame, keyed: Callable[[tuple], tuple], parts: int) -> RDD:
    """Pairs (earlier or None, later or None) of stored rows (side, key, digests, row)."""
    ranked = _ranked(rows.rdd.map(lambda r: keyed(tuple(r))), rows.count(), parts)
    return ranked.repartitionAndSortWithinPartitions(parts, lambda at: zlib.crc32(at[0], at[1] & 0xFFFFFFFF)).mapPartitions(_two_way)


def _tagged(digests: Sequence[bytes | None]) -> bytes:
    """Digests as one value that sorts and tells nulls apart."""
    return b"".join(b"\0" if d is None else b"\1" + bytes(d) for d in digests)


def _number(key: int | None) -> bytes:
    """A key as bytes in its order; null first."""
    return b"" if key is None else (key + (1 << 63)).to_bytes(8, "big")


def _by_key(row: tuple) -> tuple:
    side, key, digests, whole = row
    return (_number(key), side, _tagged(digests)), (side, key, digests, whole)


def _by_content(content: Sequence[int]) -> Callable[[tuple], tuple]:
    def keyed(row: tuple) -> tuple:
        side, key, digests, whole = row
        # Descending for the later side: complements of the bytes, null behind all.
        at = _number(key) if side == EARLIER else b"\xff" * 9 if key is None else bytes(255 - b for b in _number(key))
        return (_tagged([digests[k] for k in content]), side, (at, _tagged(digests))), (side, key, digests, whole)

    return keyed


def _described(columns: Sequence[str], unchanged: str, changed: str) -> Callable[[tuple], tuple]:
    """A pair as a row of ``_SCHEMA``; a row without a partner keeps what the next step needs and has no op."""

    def described(pair: tuple) -> tuple:
        old, new = pair
        if old and new:
            differ = ",".join(c for c, a, b in zip(columns, old[2], new[2], strict=True) if a != b)
            return new[1], old[1], changed if differ else unchanged, differ, new[3], None, None
        side, key, digests, whole = old or new
        return key, key if old else None, None, "", whole, side, digests

    return described


def difference(earlier: DataFrame, later: DataFrame, key: str, columns: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Per pair or unpaired row: key (later, else earlier), old_key, op (same, update, rekey, insert, delete), changed (a pair's differing ``columns``), row_sha256.

    ``content``: the columns among ``columns`` in which a row whose key changed must agree with its partner. ``row_sha256`` digests the later
    row's columns, joined by line feeds, nulls as ``~``.
    """
    spark = earlier.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides = stored(_side(earlier, EARLIER, key, columns).unionByName(_side(later, LATER, key, columns)).select("side", "key", "digests", "row"))
    by_key = _paired(sides, _by_key, parts).map(_described(columns, "same", "update"))
    first = stored(spark.createDataFrame(by_key, _SCHEMA, verifySchema=False))
    alone = first.where("op IS NULL").select("side", "key", "digests", "row")
    by_content = _paired(alone, _by_content([columns.index(c) for c in content]), parts).map(_described(columns, "rekey", "rekey"))
    second = spark.createDataFrame(by_content, _SCHEMA, verifySchema=False)
    op = F.coalesce("op", F.when(F.col("side") == LATER, "insert").otherwise("delete"))
    return first.where("op IS NOT NULL").unionByName(second).select("key", "old_key", op.alias("op"), "changed", F.lower(F.hex("row")).alias("row_sha256"))


def later_snapshot(docs: DataFrame) -> DataFrame:
    """A later snapshot of ``documents`` (key, text, lang, source): crc32 of the decimal doc_id modulo 25 tells what happened to a row; a null doc_id has none."""
    n = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 25, F.lit(-1))
    kept, moved = F.col("doc_id"), -1 - F.col("doc_id")
    keys = F.when(n == 0, F.array().cast(T.ArrayType(T.LongType()))).when(n.isin(3, 4), F.array(moved)).when(n == 5, F.array(kept, moved)).otherwise(F.array(kept))
    swapped = lambda a, b: F.when(n == 2, F.col(b)).otherwise(F.col(a)).alias(a)
    text = F.when(n == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text"))
    source = F.when(n == 4, F.lit(None)).otherwise(swapped("source", "lang")).alias("source")
    return docs.select(F.explode(keys).alias("key"), text.alias("text"), swapped("lang", "source"), source)


def difference_report(docs: DataFrame) -> DataFrame:
    """``difference`` of ``documents`` and ``later_snapshot`` of them."""
    earlier = docs.select(F.col("doc_id").alias("key"), "text", "lang", "source")
    return difference(earlier, later_snapshot(docs), "key", ("text", "lang", "source"), ("text", "lang"))
