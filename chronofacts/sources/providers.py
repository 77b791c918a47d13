"""Pluggable models: row-wise structured calls and embeddings, with validation, retries, a timeout budget and a result cache.

A provider is an object with ``call(task, text) -> str`` (JSON) or ``embed(texts) -> list of vectors``. It is pickled to the executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from typing import Protocol

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import Pieces

TRIPLE = "array<string>"
SCHEMAS = {
    "decompose": f"anchor_triples array<{TRIPLE}>, search_triple {TRIPLE}",
    "align": f"anchor_triples array<{TRIPLE}>, search_triple {TRIPLE}, problem boolean",
    "constrain": "constraints array<struct<anchor_kind:string,relation:string,anchor_index:int,time_text:string,interval_start:string,interval_end:string,granularity:string,offset_days:int>>, ranking struct<rank:string,rank_k:int>",
    "answer": "answers array<string>, thought string",
    "filter": "keep array<int>",
    "pseudo": "document string",
    "agent": "action string, query string, answers array<string>",
    "polish": "question string, answer array<string>, thought string",
}


class Caller(Protocol):
    def call(self, task: str, text: str) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class Lookup:
    """Answers from a table of (task, input) to JSON text; anything else is an error. For tests and replays."""

    table: dict[tuple[str, str], str]

    def call(self, task: str, text: str) -> str:
        return self.table[task, text]


@dataclass
class Rules:
    """Answers from functions by task."""

    tasks: dict[str, Callable[[str], object]] = field(default_factory=dict)

    def call(self, task: str, text: str) -> str:
        return json.dumps(self.tasks[task](text))


@dataclass
class Http:
    """Posts {task, input} as JSON to a service and returns its body."""

    url: str
    timeout: float = 60.0

    def call(self, task: str, text: str) -> str:
        from urllib.request import Request, urlopen

        request = Request(self.url, json.dumps({"task": task, "input": text}).encode(), {"Content-Type": "application/json"})
        with urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
            return reply.read().decode()


@dataclass
class HashEmbedder:
    """Deterministic vectors from character trigrams: a stand-in where no model is at hand."""

    dim: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        from zlib import crc32

        out = []
        for text in texts:
            v = [0.0] * self.dim
            padded = f"  {text.lower()} "
            for i in range(len(padded) - 2):
                h = crc32(padded[i : i + 3].encode())
                v[h % self.dim] += 1.0 if h >> 16 & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


def call_key(task: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{task}\n"), text), 256)


def call(rows: DataFrame, task: str, text: str, provider: Caller, retries: int = 2, timeouts: int = 20, schema: str | None = None, failures: Accumulator | None = None) -> DataFrame:
    """``rows`` with ``result`` (struct of the task's schema, null on failure) and ``error``.

    Each attempt after the first carries the last error. A task stops asking after ``timeouts`` timeouts; its further rows fail with that reason.
    ``failures`` counts the timeouts of all tasks, for a stage's budget (``call_in_pieces``).
    """
    shape = T.StructType.fromDDL(schema or SCHEMAS[task])
    required = {f.name for f in shape.fields}
    out_schema = T.StructType([*rows.schema.fields, T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent = 0
        for batch in batches:
            raws, errors = [], []
            for value in batch[text]:
                raw, error, attempt = None, None, 0
                while raw is None and attempt <= retries and spent < timeouts:
                    try:
                        reply = provider.call(task, value if error is None else f"{value}\nprevious error: {error}")
                        if not isinstance(found := json.loads(reply), dict) or not required & found.keys():
                            raise ValueError("the reply lacks the required fields")
                        raw = reply
                    except TimeoutError as x:
                        error, spent = f"timeout: {x}", spent + 1
                        if failures is not None:
                            failures.add(1)
                    except Exception as x:  # noqa: BLE001  whatever a provider raises is a row's error
                        error = f"{type(x).__name__}: {x}"
                    attempt += 1
                raws.append(raw)
                errors.append(None if raw is not None else error or "timeout budget spent")
            yield batch.assign(raw=raws, error=errors)

    return rows.mapInPandas(run, out_schema).withColumn("result", F.from_json("raw", shape)).drop("raw")


def call_in_pieces(rows: DataFrame, key: str, task: str, text: str, provider: Caller, folder: str, pieces: int = 8, timeouts: int = 20, **options) -> DataFrame:
    """``call`` as work that resumes (``pieces.Pieces``): key, result and error of each row. A new start asks only rows without a result; failed ones again. ``timeouts`` is the budget of the whole stage."""
    schema = T.StructType([rows.schema[key], T.StructField("result", T.StructType.fromDDL(options.get("schema") or SCHEMAS[task])), T.StructField("error", T.StringType())])
    work = Pieces(rows.sparkSession, folder, key, schema, pieces, timeouts)
    step = lambda part, failures: call(part, task, text, provider, timeouts=timeouts, failures=failures, **options)
    return work.run(rows.select(key, text), step, lambda e: e.isNotNull(), "error")


def call_cached(rows: DataFrame, task: str, text: str, provider: Caller, cache: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """As ``call``, for inputs that ``cache`` (key, result) lacks only. Returns the rows and the grown cache."""
    keyed = rows.withColumn("key", call_key(task, F.col(text)))
    fresh = call(keyed.select("key", text).dropDuplicates(["key"]).join(cache, "key", "left_anti"), task, text, provider, **options)
    grown = cache.unionByName(fresh.where("result IS NOT NULL").select("key", "result"))
    return keyed.join(grown, "key", "left").drop("key"), grown


def embed(rows: DataFrame, text: str, embedder: Embedder, name: str = "embedding") -> DataFrame:
    """``rows`` with vectors of a text column, computed in Arrow batches with one embedder for each task. Null texts have null vectors."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s[s.notna()]
            yield pd.Series(embedder.embed(list(known)) if len(known) else [], index=known.index, dtype=object).reindex(s.index)

    return rows.withColumn(name, run(F.col(text)))


def stable_key(*parts: str) -> str:
    return sha256("\n".join(parts).encode()).hexdigest()
