"""SentencePiece encoding and decoding: a max-plus scan over chunks of giant documents.

A segmentation's worth is the sum of its pieces' scores; the best one is the longest path through the lattice
of pieces, as in the public SentencePiece unigram model. The vocabulary's pieces and scores come from a model
file that is given by path; nothing is trained. Of several best segmentations the one wins whose last piece is
longest, then the one before, and so on.

Short documents are one chunk. A document of more than ``CHUNK`` characters is cut into chunks of that length:

1. each chunk yields its max-plus transfer matrix: entry [a, b] is the best worth from state a at its left edge to
   state b at its right edge, a state being how many characters of the chunk behind an edge belong to a piece
   that began before the edge;
2. the matrices are combined associatively, which gives the best worth of each state at each edge;
3. with those, each chunk maps each state at its right edge to the state that the backtrace enters at its left;
   these maps are combined from the right and give each chunk its own exit state;
4. each chunk backtraces on its own.

Steps 2 and 3 take one row for each chunk: its matrix and its head, the characters up to the first edge that every path passes
(mostly a word; the whole chunk where it has neither space nor line feed). The rows of one document meet in one task, bounded by the size of one text.

No piece of the vocabulary has a space behind another character and no piece has a line feed (checked on loading);
so every path passes through the edges before a run of spaces and around a line feed, and the units between are segmented on
their own. New units of a batch are segmented together, position by position, in numpy; short ones stay in a cache of ``CACHE_BYTES``.

Text normalisation: a space is put in front, spaces become U+2581, nothing else changes. Characters without a
piece become their UTF-8 byte pieces, as does U+2581 in a text itself: so decoding gives back every text exactly.
Null gives null ids; an empty text gives none. Repeated rows are encoded each. Unpaired surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import add_column, fresh_name, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; longer documents are giant.
CHUNK = 32_768
#: Bytes of units and ids that a generation of a worker's cache holds, by estimate; there are two. Units over ``CACHED`` characters are not kept.
CACHE_BYTES, CACHED = 24 << 20, 24
#: Units that are segmented together; fewer than ``FEW`` are segmented one by one.
TOGETHER, FEW = 8192, 24
MARK = "▁"
#: Stands for U+2581 of a text itself: a lone surrogate, which no text holds.
ALIEN = "\ud800"
NEVER = -(1 << 60)
#: What a character without a piece costs below the lowest score.
UNKNOWN_PENALTY = 10
_NL, _SP, _BARE = b"\n", b" ", b"\xff"


class Vocabulary:
    """Pieces, integer scores and byte pieces, as plain lists that a broadcast can carry."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]) -> None:
        self.pieces, self.kinds = pieces, kinds
        if any(s != int(s) for s in scores):
            self.scale = 1 << 20
        else:
            self.scale = 1
        self.scores = [round(s * self.scale) for s in scores]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        kind = lambda i: "byte" if m.is_byte(i) else "none" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "text"
        return cls([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], [kind(i) for i in n])


class Lattice:
    """Segmentation with one vocabulary."""

    def __init__(self, v: Vocabulary) -> None:
        text = [i for i, k in enumerate(v.kinds) if k == "text"]
        for i in text:
            if MARK in v.pieces[i].lstrip(MARK) or "\n" in v.pieces[i]:
                raise ValueError("a piece holds a space behind another character, or a line feed")
        self.piece = {v.pieces[i]: (v.scores[i], i) for i in text}
        self.longest = max(map(len, self.piece), default=1)
        #: Every beginning of a piece, so that a search stops where no piece goes on; ``()`` if it is no piece itself.
        self.trie: dict[str, tuple] = {p[:k]: () for p in self.piece for k in range(1, len(p))}
        self.trie.update(self.piece)
        self.states = self.longest
        self.byte = [0] * 256
        for i, k in enumerate(v.kinds):
            if k == "byte":
                self.byte[int(v.pieces[i][1:-1], 16)] = i
        if sum(k == "byte" for k in v.kinds) != 256:
            raise ValueError("the vocabulary lacks byte pieces")
        self.unknown = min((v.scores[i] for i in text), default=0) - UNKNOWN_PENALTY * v.scale
        self.value, self.is_byte = np.array(v.scores, np.int64), np.array([k == "byte" for k in v.kinds])
        self.units = Units(self)
        self.raw = [b""] * len(v.pieces)
        for i, k in enumerate(v.kinds):
            self.raw[i] = bytes([int(v.pieces[i][1:-1], 16)]) if k == "byte" else v.pieces[i].replace(MARK, " ").encode() if k == "text" else b""

    def symbols(self, chars: str) -> str:
        """``chars`` with spaces as marks; a mark in the text itself becomes a symbol that no piece has."""
        return chars.replace(MARK, ALIEN).replace(" ", MARK)

    def steps(self, s: str, at: int) -> Iterator[tuple[int, int, int]]:
        """(end, score, piece id or -1) of all pieces that begin at ``at``."""
        trie, single = self.trie, False
        for end in range(at + 1, len(s) + 1):
            found = trie.get(s[at:end])
            if found is None:
                break
            if found:
                single = single or end == at + 1
                yield end, found[0], found[1]
        if not single:
            yield at + 1, self.unknown, -1

    def ids_of(self, s: str, at: int, piece: int) -> tuple[int, ...]:
        if piece >= 0:
            return (piece,)
        return tuple(self.byte[b] for b in (MARK if s[at] == ALIEN else " " if s[at] == MARK else s[at]).encode())

    def best(self, s: str, start: dict[int, int]) -> tuple[list[int], list[tuple[int, int]]]:
        """Worth of the best path to each position from the given ones, and the last step of the best path whose last piece is longest."""
        worth, back = [NEVER] * (len(s) + 1), [(-1, -1)] * (len(s) + 1)
        for at, x in start.items():
            if at <= len(s):
                worth[at] = x
        for at in range(len(s)):
            if worth[at] > NEVER:
                for end, score, piece in self.steps(s, at):
                    if worth[at] + score > worth[end]:  # ``at`` grows: at equal worth the longer piece came first
                        worth[end], back[end] = worth[at] + score, (at, piece)
        return worth, back

    def path(self, s: str, back: list[tuple[int, int]], end: int) -> tuple[int, list[int]]:
        """Where the backtrace from ``end`` begins, and its ids."""
        out: list[tuple[int, ...]] = []
        while back[end][0] >= 0:
            at, piece = back[end]
            out.append(self.ids_of(s, at, piece))
            end = at
        return end, [i for ids in reversed(out) for i in ids]

    def strange(self, ids: bytes) -> bool:
        """Whether byte pieces are among the ids."""
        return bool(self.is_byte[np.frombuffer(ids, "<i4")].any())

    def worth_of(self, s: str) -> int:
        return self.best(s, {0: 0})[0][len(s)]

    def encode_all(self, texts: list[bytes | None]) -> list[bytes | None]:
        """Ids of whole texts, as little-endian 32-bit integers."""
        found = [units(_SP + t) if t else [] for t in texts]
        self.units.learn(found)
        get = self.units.__getitem__
        return [None if t is None else b"".join(map(get, f)) for t, f in zip(texts, found)]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:]

    # Chunks of giant documents. ``chunk`` is symbols; ``ahead`` are the characters behind it, up to states - 1.

    def _cut(self, chunk: str) -> tuple[int, int] | None:
        """The first and the last position in the chunk that every path passes, if there is any."""
        first = next((i for i in range(1, len(chunk)) if _passes(chunk, i)), None)
        if first is None or first < 1:
            return None
        return first, next(i for i in range(len(chunk) - 1, 0, -1) if _passes(chunk, i))

    def matrix(self, chunk: str, ahead: str) -> np.ndarray:
        """The chunk's transfer matrix."""
        n, k, s = len(chunk), self.states, chunk + ahead[: self.states - 1]
        out = np.full((k, k), NEVER, np.int64)
        cut = self._cut(chunk)
        if cut is None:
            for a in range(k):
                out[a] = self._exits(self.best_until(s, {a: 0}, n)[0], n)
            return out
        first, last = cut
        middle = self._worth(chunk[first:last])
        right = self._exits(self.best_until(s[last:], {0: 0}, n - last)[0], n - last)
        for a in range(min(k, first + 1)):
            left = self.best(chunk[:first], {a: 0})[0][first]
            if left > NEVER:
                out[a] = np.where(right > NEVER, right + left + middle, NEVER)
        return out

    def best_until(self, s: str, start: dict[int, int], n: int) -> tuple[list[int], list[tuple[int, int]]]:
        """As ``best``, but pieces begin before ``n`` only: what lies behind belongs to the next chunk. A piece that began before the start may also end behind ``n``."""
        worth, back = [NEVER] * (n + self.states), [(-1, -1)] * (n + self.states)
        for at, x in start.items():
            worth[at] = x
        for at in range(n):
            if worth[at] > NEVER:
                for end, score, piece in self.steps(s, at):
                    if worth[at] + score > worth[end]:
                        worth[end], back[end] = worth[at] + score, (at, piece)
        return worth, back

    def _exits(self, worth: list[int], n: int) -> np.ndarray:
        return np.array(worth[n : n + self.states], np.int64)

    def _worth(self, s: str) -> int:
        """Worth of the best path through whole units."""
        if not s:
            return 0
        found = Counter(units(s.replace(MARK, " ").replace(ALIEN, MARK).encode()))
        self.units.learn([list(found)])
        return sum(n * self.units.worth(u) for u, n in found.items())

    def head(self, chunk: str, ahead: str) -> tuple[str, int]:
        """What decides where a backtrace enters the chunk: the symbols up to the first position that every path passes, and that position; or the whole chunk with what lies ahead, and 0."""
        cut = self._cut(chunk)
        return (chunk[: cut[0]], cut[0]) if cut else (chunk + ahead[: self.states - 1], 0)

    def entries(self, head: str, cut: int, n: int, left: np.ndarray) -> list[int]:
        """For each state at the right edge of a chunk of ``n`` symbols, the state at the left edge from which the best path comes; -1 if none does."""
        start = {a: int(x) for a, x in enumerate(left) if x > NEVER}
        if cut:
            return [self.path(head, self.best(head, start)[1], cut)[0]] * self.states
        worth, back = self.best_until(head, start, n)
        return [self.path(head, back, n + b)[0] if worth[n + b] > NEVER else -1 for b in range(self.states)]

    def backtrace(self, chunk: str, ahead: str, left: np.ndarray, leave: int) -> bytes:
        """Ids of the pieces that begin in the chunk, on the best path that leaves it in state ``leave``."""
        n, s = len(chunk), chunk + ahead[: self.states - 1]
        start = {a: int(x) for a, x in enumerate(left) if x > NEVER}
        cut = self._cut(chunk)
        if cut is None:
            return _packed(self.path(s, self.best_until(s, start, n)[1], n + leave)[1])
        first, last = cut
        head = self.path(chunk, self.best(chunk[:first], start)[1], first)[1]
        tail = self.path(s[last:], self.best_until(s[last:], {0: 0}, n - last)[1], n - last + leave)[1]
        middle = chunk[first:last].replace(MARK, " ").replace(ALIEN, MARK).encode()
        found = units(middle) if middle else []
        self.units.learn([found])
        return _packed(head) + b"".join(map(self.units.__getitem__, found)) + _packed(tail)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def _passes(s: str, i: int) -> bool:
    """Whether every path passes position ``i``: before a run of marks, and on both sides of a line feed."""
    return s[i] == "\n" or s[i - 1] == "\n" or (s[i] == MARK and s[i - 1] != MARK)


def units(data: bytes) -> list[bytes]:
    """The stretches between positions that every path passes: a space (or several) and what follows it, up to the next space or line feed, or a line feed.

    Each is written with its spaces, but for the one space before most words, which is left out; what has no space in front begins with the byte 0xFF, which UTF-8 lacks.
    """
    out = []
    for k, line in enumerate(data.split(_NL)):
        if k:
            out.append(_NL)
        if not line:
            continue
        parts = line.split(_SP)
        if parts[0]:
            out.append(_BARE + parts[0])
        if b"" in parts[1:]:
            spaces = 0
            for p in parts[1:]:
                spaces += 1
                if p:
                    out.append(_SP * (spaces - 1) + p)
                    spaces = 0
            if spaces:
                out.append(_SP * spaces + _BARE)
        else:
            out += parts[1:]
    return out


class Trie:
    """The beginnings of all pieces, as a hashed table of (node, character) that numpy searches for many units at once."""

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, piece: dict[str, tuple[int, int]]) -> None:
        letters = sorted({c for p in piece for c in p})
        self.code = np.full(0x110000, len(letters), np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(len(letters))
        # Units are looked up as they stand in texts: their spaces are marks, and a mark of the text itself is in no piece.
        self.code[ord(" ")], self.code[ord(MARK)] = self.code[ord(MARK)], len(letters)
        coded = lambda c: int(self.code[ord(" " if c == MARK else c)])
        self.width = len(letters) + 1
        number = {"": 0}
        for p in piece:
            for k in range(1, len(p) + 1):
                number.setdefault(p[:k], len(number))
        # The last entry stands for no node; what is no piece can never win.
        self.score, self.id = np.full(len(number) + 1, NEVER, np.int64), np.full(len(number) + 1, -1, np.int32)
        for p, (score, i) in piece.items():
            self.score[number[p]], self.id[number[p]] = score, i
        names = [p for p in number if p]
        keys = np.array([number[p[:-1]] * self.width + coded(p[-1]) for p in names], np.int64)
        bits = max(4, (len(names) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.child = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, children, at = keys, np.array([number[p] for p in names], np.int32), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            own = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[own]], self.child[at[own]] = left[own], children[own]
            stay = np.ones(len(left), bool)
            stay[own] = False
            left, children, at = left[stay], children[stay], (at[stay] + 1) & self.mask
        self.first = self.step(np.zeros(self.width, np.int32), np.arange(self.width))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._FACTOR) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of nodes by characters; -1 where no piece goes on."""
        keys = nodes.astype(np.int64) * self.width + codes
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.child[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.child[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Units(dict):
    """Unit to its ids. ``learn`` segments the new units of a batch; those too long to keep live until the next batch.

    The cache has two generations: what is used again moves to the young one, which becomes the old one when it is full.
    """

    def __init__(self, lattice: Lattice) -> None:
        self.lattice, self.trie = lattice, Trie(lattice.piece)
        self.once: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def text(self, unit: bytes) -> str:
        if unit == _NL:
            return "\n"
        if unit[:1] == _BARE:
            return unit[1:].decode()
        if unit[-1:] == _BARE and not unit[:-1].strip(_SP):
            return unit[:-1].decode()
        return " " + unit.decode()

    def _alone(self, s: str) -> list[int]:
        """``Lattice.best`` and ``Lattice.path``, written out for one string of symbols."""
        lattice = self.lattice
        find, unknown = lattice.trie.get, lattice.unknown
        n = len(s)
        worth, back = [NEVER] * (n + 1), [(0, -1)] * (n + 1)
        worth[0] = 0
        for at in range(n):
            now, end = worth[at], at + 1
            found = find(s[at:end])
            if not found and now + unknown > worth[end]:
                worth[end], back[end] = now + unknown, (at, -1)
            while found is not None:
                if found and now + found[0] > worth[end]:
                    worth[end], back[end] = now + found[0], (at, found[1])
                if end == n:
                    break
                end += 1
                found = find(s[at:end])
        ids: list[int] = []
        end = n
        while end:
            at, piece = back[end]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += lattice.ids_of(s, at, piece)[::-1]
            end = at
        return ids[::-1]

    def _together(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many strings of similar length, how many each has, and which strings need byte pieces."""
        trie, unknown = self.trie, self.lattice.unknown
        count, longest = len(sizes), int(sizes.max())
        table = np.full((longest, count), trie.width - 1, np.int32)  # behind its end a string meets a character that no piece has
        for k in range(longest):
            there = np.flatnonzero(sizes > k)
            table[k, there] = codes[starts[there] + k]
        worth = np.full((longest + 1, count), NEVER, np.int64)
        source, piece = np.zeros((longest + 1, count), np.int32), np.full((longest + 1, count), -1, np.int32)
        worth[0] = 0
        for at in range(longest):
            rows, end = np.flatnonzero(sizes > at), at + 1
            now = worth[at, rows]
            nodes = trie.first[table[at, rows]]
            ids = trie.id[nodes]
            total = now + np.where(ids >= 0, trie.score[nodes], unknown)
            while True:
                better = np.flatnonzero(total > worth[end, rows])
                won = rows[better]
                worth[end, won], source[end, won], piece[end, won] = total[better], at, ids[better]
                go = np.flatnonzero(nodes >= 0)
                if end == longest or not len(go):
                    break
                rows, now = rows[go], now[go]
                nodes = trie.step(nodes[go], table[end, rows])
                end += 1
                ids, total = trie.id[nodes], now + trie.score[nodes]
        out, used, odd = np.zeros((count, longest), np.int32), np.zeros(count, np.int64), np.zeros(count, bool)
        ends, rows = sizes.copy(), np.flatnonzero(sizes > 0)
        while len(rows):
            here = ends[rows]
            last = piece[here, rows]
            odd[rows[last < 0]] = True
            used[rows] += 1
            out[rows, longest - used[rows]] = last
            ends[rows] = here = source[here, rows]
            rows = rows[here > 0]
        return out[np.arange(longest)[None, :] >= longest - used[:, None]], used, odd

    def learn(self, found: list[list[bytes]]) -> None:
        """Segment every unit of the lists that is not kept."""
        self.once = {}
        if self.size > CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.size = 0
        new = set().union(*found) - self.keys()
        again = new & self.old.keys()
        self._keep(list(again), [self.old[u] for u in again])
        new -= again
        odd = [u for u in new if u[:1] == _BARE or u[-1:] == _BARE or u == _NL]
        new.difference_update(odd)
        units = odd + list(new)
        if not units:
            return
        if _NL in odd:
            self._keep([_NL], [_packed(self._alone("\n"))])
            units.remove(_NL)
        # Strings stand one behind the other with a line feed between; only the unit of a line feed itself holds one.
        whole = "".join(self.text(u) + "\n" for u in odd if u != _NL) + (b" " + b"\n ".join(units[len(units) - len(new) :]) + b"\n" if new else b"").decode()
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        ends = np.flatnonzero(points == 10)
        starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        sizes, codes = ends - starts, self.trie.code[points]
        order = np.argsort(sizes, kind="stable")
        ordered, at = sizes[order], 0
        while at < len(order):
            first = int(ordered[at])
            stop = min(int(np.searchsorted(ordered, first + first // 8, "right")), at + max(1, min(TOGETHER, (1 << 20) // max(1, first))))
            rows, at = order[at:stop], stop
            names = [units[r] for r in rows.tolist()]
            symbols = lambda r: self.lattice.symbols(whole[starts[r] : ends[r]])
            if len(rows) < FEW:
                ids = [_packed(self._alone(symbols(r))) for r in rows]
            else:
                flat, used, strange = self._together(codes, starts[rows], sizes[rows])
                data, stops = flat.astype("<i4").tobytes(), np.cumsum(4 * used)
                ids = [data[a:b] for a, b in zip((stops - 4 * used).tolist(), stops.tolist())]
                for k in np.flatnonzero(strange):
                    ids[k] = _packed(self._alone(symbols(rows[k])))
            if int(ordered[stop - 1]) <= CACHED:
                self._keep(names, ids)
            else:
                self.once.update(zip(names, ids))

    def _keep(self, found: list[bytes], ids: list[bytes]) -> None:
        self.update(zip(found, ids))
        self.size += 200 * len(found) + sum(map(len, found)) + sum(map(len, ids))

    def __missing__(self, unit: bytes) -> bytes:
        return self.once[unit]

    def worth(self, unit: bytes) -> int:
        """Of a unit that has been learnt."""
        lattice = self.lattice
        return int(lattice.value[np.frombuffer(self[unit], "<i4")].sum()) if not lattice.strange(self[unit]) else lattice.worth_of(lattice.symbols(self.text(unit)))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product: associative, so chunks may be combined in any grouping."""
    sums = left[:, :, None] + right[None, :, :]
    return np.where((left[:, :, None] > NEVER) & (right[None, :, :] > NEVER), sums, NEVER).max(axis=1)


def prefixes(matrices: list[np.ndarray], start: np.ndarray) -> list[np.ndarray]:
    """The best worth of each state at each chunk's left edge: blocks of chunks are combined first, then each block is entered."""
    size = max(1, int(len(matrices) ** 0.5))
    blocks = [matrices[i : i + size] for i in range(0, len(matrices), size)]
    whole = []
    for block in blocks:
        m = block[0]
        for x in block[1:]:
            m = combine(m, x)
        whole.append(m)
    out, at = [], start[None, :]
    for block, m in zip(blocks, whole):
        inner = at
        for x in block:
            out.append(inner[0])
            inner = combine(inner, x)
        at = combine(at, m)
    return out


def chunked(text: str, lattice: Lattice, size: int) -> list[tuple[str, str]]:
    """Chunks of symbols of a text with its space in front, each with the symbols behind it."""
    s = lattice.symbols(" " + text)
    return [(s[i : i + size], s[i + size : i + size + lattice.states - 1]) for i in range(0, len(s), size)]


def exits(maps: list[list[int]]) -> list[int]:
    """Each chunk's state at its right edge, from the maps of right states to left states; the last chunk ends in state 0."""
    out, state = [], 0
    for m in reversed(maps):
        out.append(state)
        state = m[state]
    return out[::-1]


def encode_chunked(lattice: Lattice, text: str, size: int) -> bytes:
    """The whole scan in one place, for tests; the distributed form runs the same steps as rows."""
    parts = chunked(text, lattice, size) if text else []
    start = np.full(lattice.states, NEVER, np.int64)
    start[0] = 0
    left = prefixes([lattice.matrix(c, a) for c, a in parts], start) if parts else []
    leave = exits([lattice.entries(*lattice.head(c, a), len(c), p) for (c, a), p in zip(parts, left)])
    return b"".join(lattice.backtrace(c, a, p, e) for (c, a), p, e in zip(parts, left, leave))


# Spark


class _Shared:
    """A broadcast vocabulary, made a lattice once in each worker."""

    def __init__(self, df: DataFrame, model: str) -> None:
        v = Vocabulary.load(model)
        self.longest = max((len(p) for p, k in zip(v.pieces, v.kinds) if k == "text"), default=1)
        self.name = hashlib.sha256(repr((v.pieces, v.scores, v.kinds)).encode()).hexdigest()
        self.shared = df.sparkSession.sparkContext.broadcast(v)

    def lattice(self) -> Lattice:
        global _kept
        if "_kept" not in globals() or _kept[0] != self.name:
            _kept = self.name, Lattice(self.shared.value)
        return _kept[1]


#: What becomes of a text: its lattice, UTF-8 bytes and ids give a value of the column.
Finish = Callable[[Lattice, bytes, bytes], object]


def _column(docs: DataFrame, text: str, base: str, kind: T.DataType, finish: Finish, model: str, chunk: int) -> tuple[DataFrame, str]:
    """``docs`` with one more column: ``finish`` of every text that is not null. Short texts take one Python pass and no shuffle."""
    shared, name = _Shared(docs, model), fresh_name(docs, base)

    def make():
        lattice = shared.lattice()
        return lambda texts: [None if t is None else finish(lattice, t, i) for t, i in zip(texts, lattice.encode_all(texts))]

    giant = F.coalesce(F.length(F.col(text)) > chunk, F.lit(False))
    short = add_column(docs.where(~giant), name, kind, text, make)
    giants, key = docs.where(giant), fresh_name(docs, "text_digest")
    found = _giants(giants.select(F.col(text).alias("text")), kind, finish, shared, chunk).withColumnsRenamed({"digest": key, "found": name})
    return short.unionByName(giants.withColumn(key, F.sha2(F.col(text), 256)).join(found, key).select(*docs.columns, name)), name


def _giants(docs: DataFrame, kind: T.DataType, finish: Finish, shared: _Shared, size: int) -> DataFrame:
    """(digest, found): the distributed scan over each distinct text, told by its 256-bit digest. Texts are shuffled once, then read from the stored table."""
    texts = stored(docs.select(F.sha2("text", 256).alias("digest"), "text").groupBy("digest").agg(F.first("text").alias("text")))
    whole = F.concat(F.lit(" "), F.col("text"))
    n = F.ceil(F.length(whole) / F.lit(size)).cast("int")
    # Every chunk row carries what of the next chunk a piece can reach into.
    part = lambda i: F.struct(F.substring(whole, i * size + 1, F.lit(size)).alias("body"), F.substring(whole, (i + 1) * size + 1, F.lit(shared.longest)).alias("ahead"))

    def rows(df: DataFrame, schema: str, f: Callable[[Lattice, dict], dict]) -> DataFrame:
        """Rows one by one through ``f``, a chunk in memory at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = shared.lattice()
            for batch in batches:
                for k in range(batch.num_rows):
                    yield pa.RecordBatch.from_pylist([f(lattice, batch.slice(k, 1).to_pylist()[0])], schema=kinds)

        kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
        return df.mapInArrow(run, schema)

    def matrix(lattice: Lattice, r: dict) -> dict:
        body, ahead = lattice.symbols(r["body"]), lattice.symbols(r["ahead"])
        head, cut = lattice.head(body, ahead)
        return {"digest": r["digest"], "at": r["at"], "m": lattice.matrix(body, ahead).astype("<i8").tobytes(), "head": head.encode("utf-8", "surrogatepass"), "cut": cut, "n": len(body)}

    def edges(table: pa.Table) -> pa.Table:
        """All chunks of one text, in order: the worths at each left edge, and the state in which the best path leaves each chunk."""
        lattice, got = shared.lattice(), sorted(table.to_pylist(), key=lambda r: r["at"])
        k, start = lattice.states, np.full(lattice.states, NEVER, np.int64)
        start[0] = 0
        left = prefixes([np.frombuffer(r["m"], "<i8").reshape(k, k) for r in got], start)
        leave = exits([lattice.entries(r["head"].decode("utf-8", "surrogatepass"), r["cut"], r["n"], x) for r, x in zip(got, left)])
        return pa.table({"key": [got[0]["digest"]], "edges": pa.array([[{"left": x.astype("<i8").tobytes(), "leave": e} for x, e in zip(left, leave)]], edge_kind)})

    edge_kind = pa.list_(pa.struct([("left", pa.binary()), ("leave", pa.int32())]))
    chunks = texts.select("digest", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), part)).alias("at", "c")).select("digest", "at", "c.body", "c.ahead")
    matrices = rows(chunks, "digest string, at int, m binary, head binary, cut int, n int", matrix)
    known = matrices.groupBy("digest").applyInArrow(edges, "key string, edges array<struct<left: binary, leave: int>>")
    # The edges of a text join its one row; only then is it cut into chunks again.
    again = texts.join(known, texts["digest"] == known["key"])
    again = again.select("digest", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(part(i).alias("c"), F.get("edges", i).alias("e")))).alias("at", "x")).select("digest", "at", "x.c.body", "x.c.ahead", "x.e.left", "x.e.leave")

    def backtrace(lattice: Lattice, r: dict) -> dict:
        ids = lattice.backtrace(lattice.symbols(r["body"]), lattice.symbols(r["ahead"]), np.frombuffer(r["left"], "<i8"), r["leave"])
        return {"digest": r["digest"], "at": r["at"], "text": r["body"], "ids": ids}

    traced = rows(again, "digest string, at int, text string, ids binary", backtrace)
    value = to_arrow_schema(T.StructType([T.StructField("found", kind)])).field("found").type

    def join(table: pa.Table) -> pa.Table:
        got = table.sort_by("at")
        text, ids = "".join(got["text"].to_pylist())[1:].encode(), b"".join(got["ids"].to_pylist())
        return pa.table({"digest": [got["digest"][0].as_py()], "found": pa.array([finish(shared.lattice(), text, ids)], value)})

    schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("found", kind)])
    return traced.groupBy("digest").applyInArrow(join, schema)


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, chunk: int = CHUNK) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: the ids as binary, little-endian 32-bit integers each."""
    return _column(docs, text, "piece_ids", T.BinaryType(), lambda lattice, t, ids: ids, model, chunk)


def decode(encoded: DataFrame, ids: str, model: str = MODEL) -> tuple[DataFrame, str]:
    """``encoded`` with the text of its ids as one more column, and that column's name."""
    shared, name = _Shared(encoded, model), fresh_name(encoded, "decoded")

    def make():
        lattice = shared.lattice()
        return lambda rows: [None if r is None else lattice.decode(np.frombuffer(r, "<i4")).decode() for r in rows]

    return add_column(encoded, name, T.StringType(), ids, make), name


_DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("text_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _digest(lattice: Lattice, text: bytes, ids: bytes) -> dict:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return {"n_tokens": len(ids) // 4, "ids_sha256": sha(ids), "text_sha256": sha(text), "decoded_sha256": sha(lattice.decode(np.frombuffer(ids, "<i4")))}


def encoding_report(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), text_sha256, decoded_sha256 and round_trip (null for a null text).

    Encoding, decoding and digests share one Python pass, so no ids leave the worker of a short text.
    """
    found, c = _column(docs.select("doc_id", "text"), "text", "digests", _DIGEST, _digest, model, chunk)
    d = F.col(c)
    return found.select("doc_id", d["n_tokens"].alias("n_tokens"), d["ids_sha256"].alias("ids_sha256"), d["text_sha256"].alias("text_sha256"), d["decoded_sha256"].alias("decoded_sha256"), (d["decoded_sha256"] == d["text_sha256"]).alias("round_trip"))
