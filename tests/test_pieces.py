"""Work in pieces: a job that breaks in the middle, a resume, budgets and compaction."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofacts.sources import providers as M
from chronofacts.sources.pieces import BudgetSpent, Pieces

SCHEMA = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("twice", T.IntegerType())])


def asked(log):
    return Counter(int(x) for name in os.listdir(log) for x in open(f"{log}/{name}").read().split())


def doubling(log, broken):
    """Doubles k and notes each k it was asked for; the task that meets ``broken`` fails, a little later than the others end."""

    def step(rows, failures):
        def run(batches):
            for batch in batches:
                for k in batch["k"]:
                    with open(f"{log}/{os.getpid()}", "a") as f:
                        f.write(f"{k}\n")
                    if k == broken:
                        time.sleep(3)
                        raise RuntimeError("broken")
                yield batch.assign(twice=batch["k"] * 2)[["k", "twice"]]

        return rows.select("k").repartition(4, "k").mapInPandas(run, SCHEMA)

    return step


def test_a_broken_job_keeps_its_finished_tasks(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    todo = spark.createDataFrame([(k,) for k in range(200)], "k int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with pytest.raises(Exception, match="broken"):
            Pieces(spark, f"{tmp_path}/w", "k", SCHEMA, 2).run(todo, doubling(log, 77))
        kept = {r.k for r in Pieces(spark, f"{tmp_path}/w", "k", SCHEMA, 2).results().collect()}
        before = asked(log)
        assert kept and 77 not in kept and kept < set(range(200))
        got = Pieces(spark, f"{tmp_path}/w", "k", SCHEMA, 2).run(todo, doubling(log, None))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.k, r.twice) for r in got.collect()) == [(k, 2 * k) for k in range(200)]
    after = asked(log)
    assert all(after[k] == 1 for k in kept) and all(after[k] - before[k] == 1 for k in set(range(200)) - kept)
    # A third start has nothing left to ask.
    Pieces(spark, f"{tmp_path}/w", "k", SCHEMA, 2).run(todo, doubling(log, None))
    assert asked(log) == after


def sometimes(bad):
    """A provider that times out for texts that the file ``bad`` names and answers others."""

    class Sometimes:  # made here, so that workers need not import this file
        def call(self, task, text):
            if text in open(bad).read().split():
                raise TimeoutError(text)
            return json.dumps({"document": f"about {text}"})

    return Sometimes()


def test_one_budget_for_the_whole_stage(spark, tmp_path):
    bad = tmp_path / "bad"
    bad.write_text(" ".join(f"t{k}" for k in range(0, 40, 2)))
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(40)] + [(None, "null key"), (3, "t3")], "id int, text string").repartition(6)
    ask = lambda: M.call_in_pieces(rows, "id", "pseudo", "text", sometimes(str(bad)), f"{tmp_path}/w", pieces=10, timeouts=8, retries=0)
    with pytest.raises(BudgetSpent):
        ask()
    log = Pieces(spark, f"{tmp_path}/w", "id", SCHEMA).log()
    first = log.count()
    assert 0 < first < 10 and log.agg(F.max("failures")).first()[0] >= 8
    # The next start asks what has no answer: the rest and what failed.
    bad.write_text("")
    got = ask().collect()
    assert len(got) == 41 and all(r.error is None and r.result.document for r in got)
    assert Counter(r.id for r in got)[None] == 1


def test_latest_attempt_wins_and_compaction_keeps_it(spark, tmp_path):
    todo = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, w string")
    schema = T.StructType.fromDDL("k int, w string, note string")
    work = Pieces(spark, f"{tmp_path}/w", "k", schema, 3)
    step = lambda note: lambda rows, _: rows.withColumn("note", F.lit(note))
    assert sorted(map(tuple, work.run(todo, step("old")).collect())) == [(1, "a", "old"), (2, "c", "old")]
    again = work.run(todo.where("k = 2"), step("new"), lambda c: c == "old", "note")
    assert sorted(map(tuple, again.collect())) == [(1, "a", "old"), (2, "c", "new")]
    small = work.compact(f"{tmp_path}/small")
    assert small._rows().count() == 2 and sorted(map(tuple, small.results().collect())) == sorted(map(tuple, again.collect()))
    assert work.run(todo.limit(0), step("x")).count() == 2
    assert Pieces(spark, f"{tmp_path}/none", "k", schema).run(todo.limit(0), step("x")).count() == 0
