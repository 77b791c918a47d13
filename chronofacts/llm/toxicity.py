"""Toxicity: a convolutional text classifier, trained in numpy.

A word's vector is the sum of rows of a hashed table: one for the whole word, and one each for its beginnings of
4 to 8 bytes, so that inflected forms share them. Filters of widths 1, 2 and 3 run over the word vectors of the
whole text; each filter's maximum, through a rectifier, enters a logistic layer. One column of the table starts from
the smoothed log odds of the words in the training texts; everything is then trained with Adam.

Training rows: those of ``labels`` whose document has ``crc32(doc_id as text) mod 4 <> 2``, of them the
``SAMPLE`` with the smallest hash of doc_id, and of these, in that order, as many as have ``TRAIN_BYTES`` of text together (documented bounds; scoring
covers every document). Of rows with one doc_id the text with the smallest digest counts. A quarter of them
(remainder 3) is kept from training to calibrate: the logit is shifted so that the best F1 falls at a score of
``THRESHOLD``; then each language with ``LANGUAGE_LEAST`` positives and a negative among the calibration rows gets the threshold of its own best F1, for fewer tell
nothing about it; the others share the common one. Language enters that decision (``rejected``) only, never a score.

Nulls: null and empty texts are scored as texts without words; a null doc_id is not held out; a null label is no label;
of repeated labels of one doc_id the larger counts. Without labels of both classes every score is the share of label 1, or 0.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column, fresh_name, stored, words

THRESHOLD = 0.3
#: Labelled rows that training takes at most.
SAMPLE = 8_000
#: Bytes of text that training takes at most.
TRAIN_BYTES = 64 << 20
#: Positives that a language needs in the calibration rows for a threshold of its own.
LANGUAGE_LEAST = 30
TABLE = 1 << 16
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 4, 128, 0.01
#: Distinct words whose filter products a task keeps; positions that it convolves at once.
CACHE, BLOCK = 200_000, 1 << 16
_PAD = max(WIDTHS) - 1


STEMS = (4, 5, 6, 7, 8)


def features(word: bytes) -> list[int]:
    """Table rows of a word: its own and those of its beginnings."""
    crc = zlib.crc32
    return [crc(word) % TABLE, *(crc(word[:k], k) % TABLE for k in STEMS)]


@dataclass
class Model:
    """``table``: TABLE x DIM; ``filters[w]``: w x DIM x FILTERS; the logistic layer; thresholds by language."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: dict[int, np.ndarray]
    shift: float
    prior: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def probability(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def _untrained(prior: float) -> Model:
    return Model(np.zeros((1, DIM), np.float32), {}, {}, {}, 0.0, prior)


class Scorer:
    """Scores texts: keeps, for each distinct word, its product with every filter position, so that a position costs additions only."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.rows = {w: np.zeros((1024, w, FILTERS), np.float32) for w in self.model.filters}
        self.n = 1  # row 0 is the padding behind a text

    def _ids(self, text: list[bytes]) -> np.ndarray:
        seen = self.seen
        new = list(set(text) - seen.keys())
        if new:
            if self.n + len(new) > CACHE and self.n > 1:
                self._reset()
                return self._ids(text)
            at = np.arange(self.n, self.n + len(new))
            seen.update(zip(new, at.tolist()))
            vectors = self.model.table[np.array([features(w) for w in new])].sum(axis=1)
            for w, kernel in self.model.filters.items():
                rows = self.rows[w]
                if len(rows) <= at[-1]:
                    rows = self.rows[w] = np.concatenate([rows, np.zeros((int(at[-1]) + 1, w, FILTERS), np.float32)])
                rows[at] = (vectors @ kernel.transpose(1, 0, 2).reshape(DIM, w * FILTERS)).reshape(-1, w, FILTERS)
            self.n = int(at[-1]) + 1
        return np.fromiter(map(seen.__getitem__, text), np.int64, len(text))

    def score(self, text: list[bytes]) -> float:
        """The score of one text of any length, block by block."""
        if self.model.prior is not None:
            return self.model.prior
        best = {w: np.full((1, FILTERS), -np.inf, np.float32) for w in self.model.filters}
        for start in range(0, max(1, len(text)), BLOCK):
            ids = np.concatenate([self._ids(text[start : start + BLOCK + _PAD]), np.zeros(_PAD, np.int64)])
            n = max(1, min(BLOCK, len(text) - start))
            for w in best:
                best[w] = np.maximum(best[w], self._windows(ids, w)[:n].max(axis=0))
        return float(self._finish(best)[0])

    def scores(self, texts: list[list[bytes]]) -> list[float]:
        """The scores of many texts; the short ones are convolved together."""
        if self.model.prior is not None:
            return [self.model.prior] * len(texts)
        out, group, size = [0.0] * len(texts), [], 0
        for i, text in enumerate(texts):
            if len(text) > BLOCK:
                out[i] = self.score(text)
                continue
            if size + len(text) > BLOCK:
                self._group(texts, group, out)
                group, size = [], 0
            group.append(i)
            size += len(text)
        self._group(texts, group, out)
        return out

    def _group(self, texts: list[list[bytes]], group: list[int], out: list[float]) -> None:
        if not group:
            return
        flat = self._ids([w for i in group for w in texts[i]])
        sizes = np.array([len(texts[i]) for i in group])
        starts = np.r_[0, np.cumsum(sizes + _PAD)[:-1]]
        ids = np.zeros(int(sizes.sum()) + _PAD * len(group), np.int64)
        ids[np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(len(flat))] = flat
        # A window may begin at a text's words, or at its first padding if it has none.
        ends = starts + np.maximum(sizes, 1)
        bounds = np.c_[starts, ends].ravel()
        best = {w: np.maximum.reduceat(self._windows(ids, w), bounds, axis=0)[::2] for w in self.model.filters}
        for i, p in zip(group, self._finish(best)):
            out[i] = float(p)

    def _windows(self, ids: np.ndarray, w: int) -> np.ndarray:
        rows = self.rows[w]
        total = rows[ids, 0]
        for k in range(1, w):
            total[: len(ids) - k] += rows[ids[k:], k]
        return total

    def _finish(self, best: dict[int, np.ndarray]) -> np.ndarray:
        logit = self.model.shift + sum((np.maximum(b + self.model.bias[w], 0) * self.model.out[w]).sum(axis=1, dtype=np.float64) for w, b in best.items())
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def train(texts: list[bytes], toxic: list[int], calibrate: list[bool], langs: list[str | None], seed: int = 7) -> Model:
    """A model from UTF-8 texts, tokenised one at a time. Deterministic for the same rows in the same order."""
    y = np.array(toxic, np.float32)
    fit = np.flatnonzero(~np.array(calibrate, bool))
    if len(set(y[fit].tolist())) < 2:
        return _untrained(float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    ids = []
    for text in texts:
        w = words(text)
        ids.append(np.fromiter((vocabulary.setdefault(x, len(vocabulary) + 1) for x in w), np.int32, len(w)))
    hashed = np.zeros((len(vocabulary) + 1, 1 + len(STEMS)), np.int32)
    for w, i in vocabulary.items():
        hashed[i] = features(w)
    del vocabulary

    counts = np.zeros((2, TABLE))
    for i in fit:
        counts[toxic[i], np.unique(hashed[np.unique(ids[i])])] += 1
    positives, negatives = y[fit].sum(), len(fit) - y[fit].sum()
    odds = np.log((counts[1] + 0.5) / (positives + 1)) - np.log((counts[0] + 0.5) / (negatives + 1))
    odds *= counts.sum(axis=0) >= 4
    table = rng.normal(0, 0.05, (TABLE, DIM)).astype(np.float32)
    table[:, 0] = odds / 4
    filters = {w: rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for kernel in filters.values():
        kernel[:, 0, : FILTERS // 2] = 1 / len(kernel)
    params = {("f", w): f for w, f in filters.items()} | {("b", w): np.full(FILTERS, -0.5, np.float32) for w in WIDTHS} | {("o", w): np.where(np.arange(FILTERS) < FILTERS // 2, 0.3, 0.05).astype(np.float32) for w in WIDTHS} | {"s": np.array([-2.0], np.float32), "t": table}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    pad, step = _PAD, 0
    for _ in range(EPOCHS):
        for chosen in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            step += 1
            flat = np.concatenate([x for i in chosen for x in (ids[i], np.zeros(pad, np.int32))])
            size = np.array([len(ids[i]) for i in chosen]) + pad
            starts = np.r_[0, np.cumsum(size)[:-1]]
            used, at = np.unique(flat, return_inverse=True)
            vectors = table[hashed[used]].sum(axis=1)
            vectors[used == 0] = 0
            grads = {k: np.zeros_like(v) for k, v in params.items() if k != "t"}
            logit, peaks = np.full(len(chosen), params["s"][0]), {}
            for w in WIDTHS:
                product = np.einsum("nd,wdf->nwf", vectors, params["f", w])
                total = product[at, 0]
                for k in range(1, w):
                    total[: len(at) - k] += product[at[k:], k]
                where = np.stack([s + total[s : s + n - pad or 1].argmax(axis=0) for s, n in zip(starts, size)])
                pre = np.take_along_axis(total, where, axis=0) + params["b", w]
                peaks[w] = where, pre
                logit += np.maximum(pre, 0) @ params["o", w]
            p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            error = ((p - y[chosen]) * np.where(y[chosen] > 0, 3.0, 1.0) / len(chosen)).astype(np.float32)
            grads["s"][0] = error.sum()
            in_vectors = np.zeros_like(vectors)
            for w, (where, pre) in peaks.items():
                grads["o", w] = np.maximum(pre, 0).T @ error
                back = error[:, None] * params["o", w] * (pre > 0)
                grads["b", w] = back.sum(axis=0)
                for k in range(w):
                    rows = at[np.minimum(where + k, len(at) - 1)]
                    grads["f", w][k] = np.einsum("bfd,bf->df", vectors[rows], back)
                    np.add.at(in_vectors, rows, back[:, :, None] * params["f", w][k].T[None])
            in_vectors[used == 0] = 0
            touched, inverse = np.unique(hashed[used], return_inverse=True)
            in_table = np.zeros((len(touched), DIM), np.float32)
            np.add.at(in_table, inverse.reshape(len(used), -1), np.broadcast_to(in_vectors[:, None, :], (len(used), hashed.shape[1], DIM)))
            fade = np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * RATE
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= (fade * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            moved = np.flatnonzero(np.abs(in_table).sum(axis=1))
            rows, g = touched[moved], in_table[moved]
            m, v = moments["t"]
            m[rows] += 0.1 * (g - m[rows])
            v[rows] += 0.001 * (g * g - v[rows])
            table[rows] -= (fade * m[rows] / (np.sqrt(v[rows]) + 1e-8)).astype(np.float32)
    model = Model(table, {w: params["f", w] for w in WIDTHS}, {w: params["b", w] for w in WIDTHS}, {w: params["o", w] for w in WIDTHS}, float(params["s"][0]))
    _calibrate(model, texts, y, np.flatnonzero(np.array(calibrate, bool)), langs)
    return model


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between scores at which F1 is best; of several, the widest gap."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    after = np.r_[s[1:], s[-1] - 1]
    f1[s == after] = -1
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = top[np.argmax((s - after)[top])]
    return float((s[k] + after[k]) / 2)


def _calibrate(model: Model, texts: list, y: np.ndarray, rows: np.ndarray, langs: list) -> None:
    if len(rows) == 0 or len(set(y[rows].tolist())) < 2:
        return
    scorer = Scorer(model)
    logit = lambda p: np.log(p) - np.log1p(-p)
    def score_all() -> np.ndarray:
        return np.clip([p for k in range(0, len(rows), 256) for p in scorer.scores([words(texts[i]) for i in rows[k : k + 256]])], 1e-12, 1 - 1e-12)

    scores = score_all()
    model.shift += logit(THRESHOLD) - best_threshold(logit(scores), y[rows])
    scores = score_all()
    names = np.array([str(langs[i]) for i in rows])
    for lang in sorted(set(names.tolist())):
        own = names == lang
        if y[rows][own].sum() >= LANGUAGE_LEAST and len(set(y[rows][own].tolist())) == 2:
            x = best_threshold(logit(scores[own]), y[rows][own])
            model.thresholds[lang] = model.probability(x)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on labelled rows that are not held out."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    # The sample is drawn from the labels alone; its size is a constant, so it may be broadcast, and no text is shuffled.
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), lang.alias("lang"))
    rows = texts.join(F.broadcast(chosen), "doc_id")
    # One row for each doc_id; what reaches the driver is bounded in rows, then in bytes.
    one = stored(rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "lang", "toxic"), F.struct(F.sha2("text", 256), F.coalesce("lang", F.lit("")))).alias("r")).select("doc_id", "r.*"))
    taken, size = [], 0
    for r in one.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if size + r.size <= TRAIN_BYTES:
            taken.append(r.doc_id)
            size += r.size
    got = sorted(one.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in taken], one.select("doc_id").schema)), "doc_id").collect(), key=lambda r: r.doc_id) if taken else []
    return train([bytes(r.text) for r in got], [int(r.toxic > 0) for r in got], [zlib.crc32(str(r.doc_id).encode()) % 4 == 3 for r in got], [r.lang for r in got])


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the score as one more double column, and that column's name."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), fresh_name(docs, "toxicity")

    def make():
        scorer = Scorer(shared.value)

        def run(texts: list[bytes | None]) -> list[float]:
            out: list[float] = []
            for i in range(0, len(texts), 256):
                out += scorer.scores([words(x) for x in texts[i : i + 256]])
            return out

        return run

    return add_column(docs, name, T.DoubleType(), text, make), name


def rejected(docs: DataFrame, model: Model, score_column: str) -> F.Column:
    """The decision at the threshold of the document's language, or the common one."""
    threshold = F.lit(THRESHOLD)
    if "lang" in docs.columns and model.thresholds:
        table = F.create_map(*(F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair))
        threshold = F.coalesce(F.element_at(table, F.coalesce(F.col("lang"), F.lit("None"))), threshold)
    return F.col(score_column) >= threshold


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, rejected."""
    model = fit(docs, labels)
    own = docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else []))
    found, c = score(own, model)
    return found.select("doc_id", held_out().alias("held_out"), F.col(c).alias("score"), (F.col(c) >= THRESHOLD).cast("int").alias("predicted"), rejected(own, model, c).alias("rejected"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    model = fit(docs, labels)
    found, c = score(docs, model)
    return found.where(~rejected(docs, model, c)).drop(c)
