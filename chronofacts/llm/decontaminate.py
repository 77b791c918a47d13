"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Every item gives patterns: its windows of ``window`` consecutive words, or all its words if it has fewer.
The symbols are words, numbered by the benchmark's own vocabulary; the blocks are word pairs. A hashed shift table tells how far a block lets
the search jump; a block with shift 0 leads, through its hash bucket and the pattern's first block, to the few patterns that are compared directly.
A pattern is a place in one array of word numbers, so a table takes some 10 bytes for each byte of benchmark text, and each Python worker builds it once.

A benchmark of up to ``BLOCK_BYTES`` is one table; one of up to ``BLOCKS`` such blocks is searched block after block in one pass over the documents.
A larger one is neither collected nor broadcast: windows of documents and benchmark are joined as words, dealt over ``SALTS`` tasks each.

Nulls: a null text has no words; a null item_id stands as ``null`` in the list of items. Empty items give no pattern.
Repeated documents are judged row by row, repeated items count once. An empty benchmark hits nothing, empty documents give an empty result.
Added columns get names that no column of the documents has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column, fresh_name, slices, utf8, words

WINDOW = 10
#: Text bytes of one block of benchmark items, and blocks that are searched in one pass.
BLOCK_BYTES, BLOCKS = 8 << 20, 4
SALTS = 16

#: Multipliers of a pair's hash; a table's index is some of the upper bits.
_A, _B, _DOWN = 0x9E3779B1, 0x85EBCA77, 11


class WuManber:
    """Search for the patterns of ``length`` words that begin at ``starts`` in ``flat`` (word numbers); ``items`` are their items' numbers. Equal patterns are one."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, items: np.ndarray, length: int, number: dict[bytes, int]) -> None:
        self.length, self.block, self.flat, self.number = length, min(2, length), flat, number
        starts = self._once(starts, items)
        bits = min(20, max(8, (4 * len(starts)).bit_length()))
        self.mask = (1 << bits) - 1
        table = np.full(1 << bits, min(255, length - self.block + 1), np.uint8)
        for end in range(self.block, length + 1):  # shifts grow smaller, so the least stays
            table[self._hash(flat[starts + max(0, end - 2)], flat[starts + end - 1])] = min(255, length - end)
        self.shift = table.tobytes()
        bucket = self._hash(flat[starts + max(0, length - 2)], flat[starts + length - 1])
        first = self._pair(flat[starts], flat[starts + self.block - 1])
        order = np.lexsort((first, bucket))
        self.starts, self.pattern, self.first = starts[order].astype(np.int32), order.astype(np.int32), first[order]
        self.begin = np.searchsorted(bucket[order], np.arange((1 << bits) + 1)).astype(np.int32)

    def _once(self, starts: np.ndarray, items: np.ndarray) -> np.ndarray:
        """A start of each different pattern; ``items`` from ``owned[p]`` on are the items that have pattern p, each once."""
        key = np.zeros(len(starts), np.uint64)
        for j in range(self.length):
            key = key * np.uint64(0x9E3779B97F4A7C15) + self.flat[starts + j].astype(np.uint64)
        order = np.lexsort((items, key))
        starts, items, key = starts[order], items[order], key[order]
        same = key[1:] == key[:-1]
        for j in range(self.length):  # by the words themselves; patterns that only share a key stay apart
            same &= self.flat[starts[1:] + j] == self.flat[starts[:-1] + j]
        new = np.append(True, ~same)
        keep = new | np.append(True, items[1:] != items[:-1])
        self.items = items[keep]
        self.owned = np.searchsorted((np.cumsum(new) - 1)[keep], np.arange(int(new.sum()) + 1)).astype(np.int32)
        return starts[new]

    def items_of(self, pattern: int) -> np.ndarray:
        return self.items[self.owned[pattern] : self.owned[pattern + 1]]

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 32) | b

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.int64) * _A + b.astype(np.int64) * _B) >> _DOWN) & self.mask

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, pattern's number) of every occurrence, in the order of places."""
        length, shift, get, mask, n = self.length, self.shift, self.number.get, self.mask, len(text)
        farthest, back = length - self.block + 1, min(2, length)
        end, numbers = length, []
        while end <= n:
            b = get(text[end - 1], -1)
            a = get(text[end - back], -1)
            if a < 0 or b < 0:
                end += farthest
                continue
            h = ((a * _A + b * _B) >> _DOWN) & mask
            jump = shift[h]
            if jump:
                end += jump
                continue
            yield from self._compare(text, end - length, h, numbers)
            end += 1

    def _compare(self, text: list[bytes], start: int, h: int, numbers: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """``numbers``: filled with the text's word numbers at the first place that has to be compared."""
        get, length = self.number.get, self.length
        a, b = get(text[start], -1), get(text[start + self.block - 1], -1)
        low, high = int(self.begin[h]), int(self.begin[h + 1])
        if a < 0 or b < 0 or low == high:
            return
        key = (a << 32) | b
        if high - low > 1:
            near = self.first[low:high]
            low, high = low + int(np.searchsorted(near, key)), low + int(np.searchsorted(near, key, "right"))
        elif self.first[low] != key:
            return
        if low == high:
            return
        if not numbers:
            numbers.append(np.fromiter((get(w, -1) for w in text), self.flat.dtype, len(text)))
        own = numbers[0][start : start + length]
        if high - low == 1:
            at = self.starts[low]
            if self.flat[at : at + length].tobytes() == own.tobytes():
                yield start, int(self.pattern[low])
            return
        for k in range(low, high, 4096):
            places = self.starts[k : min(high, k + 4096)]
            same = (self.flat[places[:, None] + np.arange(length)] == own).all(axis=1)
            yield from ((start, int(p)) for p in self.pattern[k : min(high, k + 4096)][same])


class Scanner:
    """Full windows have one table, and so have short items of each length, so that one short item does not shorten every jump."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int) -> None:
        number: dict[bytes, int] = {}
        self.names = ["null" if item is None else str(item) for item, _ in items]
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            if w := words(text):
                codes = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int32, len(w))
                by_length.setdefault(min(len(w), window), []).append((k, codes))
        self.tables = []
        for length, found in sorted(by_length.items()):
            sizes = np.array([len(c) for _, c in found])
            flat, windows = np.concatenate([c for _, c in found]), sizes - length + 1
            starts = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
            self.tables.append(WuManber(flat, starts, np.repeat(np.array([k for k, _ in found], np.int32), windows), length, number))

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        spans, items = [], set()
        for table in self.tables:
            met = set()
            for start, pattern in table.find(text):
                if not spans or spans[-1] != (start, start + table.length):
                    spans.append((start, start + table.length))
                met.add(pattern)
            for pattern in met:
                items.update(table.items_of(pattern).tolist())
        return merged(spans), {self.names[i] for i in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("behind", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def _report(n_words: int, spans: list[tuple[int, int]], items: set[str] | list[str]) -> dict:
    return {"n_words": n_words, "spans": [{"first": a, "behind": b} for a, b in spans], "items": sorted(items)}


def _scanner(name: str, block: list, window: int) -> Scanner:
    """Built once in a worker for each block; those of another benchmark are let go."""
    global _built
    if "_built" not in globals() or name.partition("/")[0] not in {k.partition("/")[0] for k in _built}:
        _built = {}
    if name not in _built:
        _built[name] = Scanner(block, window)
    return _built[name]


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and that column's name: struct(n_words, spans of hit words, items found). No shuffle up to ``BLOCKS`` blocks of benchmark."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    name, n = fresh_name(docs, "passages"), max(1, -(-size // BLOCK_BYTES))
    if n > BLOCKS:
        return _joined(docs, rows, text, name, window), name
    out = docs
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == k)
        block = [(r.i, None if r.t is None else bytes(r.t)) for r in part.orderBy("i", "t").collect()]
        mark = hashlib.sha256(repr((window, block)).encode()).hexdigest()
        shared = docs.sparkSession.sparkContext.broadcast((f"{size}-{n}-{window}/{mark}", block))

        def make(shared=shared):
            scanner = _scanner(*shared.value, window)

            def run(texts: list[bytes | None]) -> list[dict]:
                return [_report(len(w), *scanner.scan(w)) for w in map(words, texts)]

            return run

        column = name if k == 0 else fresh_name(out, "passages_more")
        out = add_column(out, column, _FOUND, text, make)
        if k:
            out = out.withColumn(name, _both(F.col(name), F.col(column))).drop(column)
    return out, name


def _windows(rows: DataFrame, window: int, lengths: list[int] | None) -> DataFrame:
    """(key, at, window as words between spaces) of ``rows`` (key, t): all windows of ``lengths`` words; None: those that are patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                keys, ats, texts = [], [], []
                for key, x in zip(part.column(0).to_pylist(), utf8(part, 1)):
                    w = words(x)
                    for n in lengths or ([min(len(w), window)] if w else []):
                        for i in range(len(w) - n + 1):
                            keys.append(key)
                            ats.append(i)
                            texts.append(b" ".join(w[i : i + n]))
                            if len(texts) == 65536:
                                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ats, pa.int64()), pa.array(texts, pa.binary())], names=["key", "at", "w"])
                                keys, ats, texts = [], [], []
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ats, pa.int64()), pa.array(texts, pa.binary())], names=["key", "at", "w"])

    return rows.mapInArrow(run, "key string, at long, w binary")


def _joined(docs: DataFrame, rows: DataFrame, text: str, name: str, window: int) -> DataFrame:
    """As the tables find, by a join of windows; for benchmarks of any size. A window that stands in many documents is dealt over ``SALTS`` tasks."""
    counted = fresh_name(docs, "passage_words")
    counting = add_column(docs, counted, T.LongType(), text, lambda: lambda texts: [len(words(x)) for x in texts])
    key = fresh_name(counting, "passage_text")
    keyed = counting.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    patterns = _windows(rows.select(F.coalesce("i", F.lit("null")).alias("key"), "t"), window, None).groupBy("w").agg(F.collect_set("key").alias("items"))
    lengths = sorted({min(r.n, window) for r in patterns.select((F.size(F.split(F.col("w").cast("string"), " "))).alias("n")).distinct().collect()})
    patterns = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    texts = docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("key"), F.col(text).cast("binary").alias("t")).groupBy("key").agg(F.first("t").alias("t"))
    mine = _windows(texts, window, lengths or [window]).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    hits = mine.join(patterns, ["w", "salt"]).select("key", F.struct(F.col("at").alias("first"), (F.col("at") + F.size(F.split(F.col("w").cast("string"), " "))).cast("long").alias("behind")).alias("span"), "items")
    found = hits.groupBy("key").agg(_disjoint(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = found.select(F.col("key").alias("_key"), "spans", "items")
    out = keyed.join(found, F.col(key) == F.col("_key"), "left")
    whole = F.struct(F.col(counted).alias("n_words"), F.coalesce("spans", F.array().cast(_FOUND["spans"].dataType)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select(*(keyed[c] for c in docs.columns), whole.alias(name))


def _disjoint(spans: Column) -> Column:
    """Disjoint spans, in order, that cover the same words as an array of spans."""
    last = lambda s: F.element_at(s, -1)
    grown = lambda s, x: F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(last(s)["first"].alias("first"), F.greatest(last(s)["behind"], x["behind"]).alias("behind"))))
    return F.aggregate(F.array_sort(spans), F.array().cast(_FOUND["spans"].dataType), lambda s, x: F.when((F.size(s) > 0) & (last(s)["behind"] >= x["first"]), grown(s, x)).otherwise(F.concat(s, F.array(x))))


def _both(a: Column, b: Column) -> Column:
    """What two blocks of the benchmark have found in the same text: the union of items, and of spans as disjoint spans."""
    return F.struct(a["n_words"].alias("n_words"), _disjoint(F.concat(a["spans"], b["spans"])).alias("spans"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, c = find_passages(docs.select("doc_id", "text"), benchmark, window=window)
    x = F.col(c)
    hit = F.aggregate(x["spans"], F.lit(0).cast("long"), lambda n, s: n + s["behind"] - s["first"])
    return found.select(
        "doc_id", x["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(x["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(x["items"], ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any occurrence, with their own columns."""
    found, c = find_passages(docs, benchmark, window=window)
    return found.where(F.size(F.col(c)["spans"]) == 0).drop(c)
