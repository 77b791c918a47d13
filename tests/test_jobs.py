"""The staged job, the retrieval baselines and the stateful stream, with deterministic providers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronofacts.operators import alignment, rag
from chronofacts.plans.question_answering import Job, evaluation, with_ledger
from chronofacts.sources import providers as M
from chronofacts.streaming import facts as stream

FACTS = [("ann", "met", "bob", "2000-01-01"), ("ann", "met", "cid", "2001-01-01"), ("ann", "met", "dan", "2002-01-01"), ("eve", "met", "bob", "2001-06-01")]


def facts(spark):
    return spark.createDataFrame(FACTS, "head string, relation string, tail string, timestamp string")


def test_job(spark, tmp_path):
    rules = M.Rules({
        "decompose": lambda q: {"anchor_triples": [["eve", "met", "bob"]], "search_triple": ["ann", "met", "?"]},
        "align": lambda t: {"anchor_triples": [["eve", "met", "bob"]], "search_triple": ["ann", "met", "?"], "problem": False},
        "constrain": lambda t: {"constraints": [{"anchor_kind": "event", "relation": "after", "anchor_index": 0}], "ranking": None},
        "answer": lambda t: {"answers": [line.split(" | ")[2] for line in t.split("\n")[1:]], "thought": ""},
    })
    questions = spark.createDataFrame([("q1", "Whom did Ann meet after Eve met Bob?")], "qid string, question string")
    job = Job(str(tmp_path), rules, facts(spark))
    r = job.run(questions).first()
    assert r.predict_answer == ["dan"] and r.status["answer"] == "SUCCESS" and r.retrieved_count == 3 and r.final_count == 1
    broken = Job(str(tmp_path), M.Lookup({}), facts(spark))
    assert broken.run(questions).first().predict_answer == ["dan"]  # every stage is read back, none is asked again


def test_job_without_constraints(spark, tmp_path):
    triples = {"anchor_triples": [["eve", "met", "bob"]], "search_triple": ["ann", "met", "?"]}
    rules = M.Rules({
        "decompose": lambda q: triples,
        "align": lambda t: triples | {"problem": False},
        "constrain": lambda t: {"constraints": [{"anchor_kind": "event", "relation": "after", "anchor_index": 0}], "ranking": None},
        "answer": lambda t: {"answers": [line.split(" | ")[2] for line in t.split("\n")[1:]], "thought": ""},
    })
    questions = spark.createDataFrame([("q1", "Whom did Ann meet after Eve met Bob?")], "qid string, question string")
    r = Job(str(tmp_path), rules, facts(spark), ablation="no_constraint").run(questions).first()
    assert r.predict_answer == ["bob", "cid", "dan"] and r.status["constraint"] == "SKIPPED"
    with pytest.raises(ValueError, match="unknown ablation"):
        Job(str(tmp_path), rules, facts(spark), ablation="no_such")


def test_alignment_gives_gold_lists_and_turns_the_search(spark, tmp_path):
    def align(text):
        t = json.loads(text)
        assert t["gold_relations"][0] == "met" and set(t["gold_entities"]) >= {"ann", "eve", "bob"} and t["gold_triples"][0] == ["bob", "met", "eve"], t
        return {"anchor_triples": [["ann", "met", "cid"]], "search_triple": ["?", "met", "ann"], "problem": False}

    rules = M.Rules({
        "decompose": lambda q: {"anchor_triples": [["bob", "mett", "eve"]], "search_triple": ["ann", "met", "?"]},
        "align": align,
        "constrain": lambda t: {"constraints": [{"anchor_kind": "explicit", "relation": "after", "time_text": "2001-06"}], "ranking": None},
        "answer": lambda t: {"answers": [line.split(" | ")[2] for line in t.split("\n")[1:]], "thought": ""},
    })
    questions = spark.createDataFrame([("q1", "Whom did Ann meet?", "simple", "x", ["dan"])], "qid string, question string, question_level string, question_type string, answer array<string>")
    out = Job(str(tmp_path), rules, facts(spark), embedder=M.HashEmbedder()).run(questions)
    r = out.first()
    assert r.aligned_search == ["ann", "met", "?"] and r.status["align"] == "SUCCESS" and r.predict_answer == ["dan"], r
    tables = evaluation(out)
    assert {(t.scope, t.before, t.after) for t in tables["compression"].collect()} == {(s, r.retrieved_count, r.final_count) for s in ("level", "type", "overall")}
    assert {t.hits_1 for t in tables["hits"].collect()} == {1}


def test_triples_without_exact_matches_take_similar_facts(spark, tmp_path):
    triples = {"anchor_triples": [["Eve", "met", "Bob"]], "search_triple": ["Ann", "met", "?"]}
    rules = M.Rules({
        "decompose": lambda q: triples,
        "align": lambda t: triples | {"problem": False},
        "constrain": lambda t: {"constraints": [{"anchor_kind": "event", "relation": "after", "anchor_index": 0}], "ranking": None},
        "answer": lambda t: {"answers": [line.split(" | ")[2] for line in t.split("\n")[1:]], "thought": ""},
    })
    questions = spark.createDataFrame([("q1", "Whom did Ann meet after Eve met Bob?")], "qid string, question string")
    run = lambda name, **k: Job(str(tmp_path / name), rules, facts(spark), **k).run(questions).first()
    assert run("exact").predict_answer is None and run("near", embedder=M.HashEmbedder()).predict_answer == ["dan"]


def test_questions_without_triples_take_weak_anchors(spark, tmp_path):
    questions = spark.createDataFrame([("q1", "ann met"), ("q2", "zzzz"), ("q3", None)], "qid string, question string")
    job = Job(str(tmp_path), M.Rules({}), facts(spark).withColumn("tail", F.concat(F.lit("ann "), "tail")), ablation="no_triple", embedder=M.HashEmbedder())
    got = {r.qid: (r.anchor_triples, r.search_triple) for r in job.decompose(with_ledger(questions)).collect()}
    assert sorted(got["q1"][0]) == [["ann", "met", f"ann {x}"] for x in ("bob", "cid", "dan")] and got["q1"][1] == ["ann met"] * 3 and got["q2"][0] == [] and got["q3"][0] == []


def test_cascade_prefers_the_first_search_that_finds_any(spark):
    rows = [("q", 0, "ann", "met", "?"), ("q", 1, "?", "met", "ann"), ("q", 2, "nobody", "xx", "?"), ("q", alignment.SEARCH, "?", "?", "?")]
    triples = spark.createDataFrame(rows, "qid string, place int, head string, relation string, tail string")
    near = lambda *pairs: spark.createDataFrame(pairs, "text string, name string, sim double")
    ents, rels = near(("ann", "ann", 1.0), ("ann", "eve", 0.3)), near(("met", "met", 1.0))
    found = alignment.cascade(triples, facts(spark), ents, rels)
    assert {(r.place, r.branch, r.swapped, r.head, r.tail) for r in found.collect()} == {(0, 0, False, "ann", x) for x in ("bob", "cid", "dan")} | {(1, 1, True, "ann", x) for x in ("bob", "cid", "dan")}
    weak = alignment.cascade(triples, facts(spark), near(("ann", "eve", 0.3)), rels)
    assert {(r.place, r.branch, r.head) for r in weak.collect()} == {(0, 2, "eve"), (1, 3, "eve")}
    gold = alignment.gold_lists(triples, found, cap=2).first()
    assert gold.gold_entities == ["ann", "nobody"] and gold.gold_relations == ["met", "xx"] and gold.gold_triples == [["ann", "met", "bob"], ["ann", "met", "cid"]] and gold.problem


def test_baselines(spark, tmp_path):
    lines = facts(spark).select(F.monotonically_increasing_id().alias("id"), rag.sentence(F.col("head"), F.col("relation"), F.col("tail"), F.col("timestamp"), F.col("timestamp")).alias("sentence"))
    corpus = rag.build_corpus(lines, M.HashEmbedder(), str(tmp_path / "corpus"))
    turns = lambda t: {"action": "answer" if "0. " in t else "search", "query": "eve met bob", "answers": ["seen"]}
    rules = M.Rules({"answer": lambda t: {"answers": [t.split("0. ")[1].split("\n")[0]], "thought": ""}, "filter": lambda t: {"keep": [1, 99, 1]}, "pseudo": lambda q: {"document": "ann met dan on 2002-01-01"}, "agent": turns})
    questions = spark.createDataFrame([(1, "eve met bob on 2001-06-01")], "qid int, question string")
    ask = lambda mode, **k: rag.answer(questions, corpus, M.HashEmbedder(), rules, mode, **k).first().llm_answer
    assert ask("rag", k=2) == ["eve met bob on 2001-06-01"]
    assert ask("hyde", k=2) == ["ann met dan on 2002-01-01"]
    assert ask("rag_filter", k=1, before=3) != ["eve met bob on 2001-06-01"]
    assert ask("agent", k=1, steps=3) == ["seen"]
    assert ask("nonsense") == []


def test_provider_errors_and_cache(spark):
    rows = spark.createDataFrame([("known",), ("unknown",)], "question string")
    provider = M.Lookup({("pseudo", "known"): '{"document": "d"}'})
    got = {r.question: r for r in M.call(rows, "pseudo", "question", provider).collect()}
    assert got["known"].result.document == "d" and got["unknown"].result is None and got["unknown"].error.startswith("KeyError")
    empty = spark.createDataFrame([], "key string, result struct<document:string>")
    first, cache = M.call_cached(rows, "pseudo", "question", provider, empty)
    assert cache.count() == 1 and M.call_cached(rows, "pseudo", "question", M.Lookup({}), cache)[0].where("result IS NOT NULL").count() == 1


def test_union_stream_equals_batch(spark, tmp_path):
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(k)
    rows = [("a", day(0), day(3)), ("a", day(10), day(12)), ("b", day(1), day(1)), ("a", day(3), day(10))]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "key string, start date, end date").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, start date, end date").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.union_stream(source, "key").writeStream.outputMode("update").format("memory").queryName("islands").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("islands").collect()
    newest = {k: max(r.version for r in got if r.key == k) for k in "ab"}
    last = [r for r in got if r.version == newest[r.key]]
    assert sorted((r.key, r.start, r.end) for r in last) == [("a", day(0), day(12)), ("b", day(1), day(1))]


def test_repaired_cases_are_split(spark):
    from chronofacts.operators import programs

    rows = [(1, "simple", ["a"], ["a"]), (2, "simple", ["a"], ["a", "b"]), (3, "medium", ["a"], []), (4, "medium", [], ["b"]), (5, "simple", ["a", "b"], ["b"]), (6, "medium", None, ["b"])]
    cases = spark.createDataFrame(rows, "id int, question_level string, answer array<string>, semantic_gold array<string>")
    cases = cases.withColumn("repair_status", programs.compare_answers(cases["answer"], cases["semantic_gold"]))
    clean, exceptions = programs.clean_and_exceptions(cases, most=1)
    assert {(r.id, *r.answer) for r in clean.collect()} == {(1, "a"), (5, "b")}
    assert {r.id: r.retention_reason for r in exceptions.collect()} == {
        2: "SUBSET_BUT_SEMANTIC_GOLD_TOO_LARGE:2>1", 3: "REPAIR_STATUS_NOT_ACCEPTED:NO_REPAIRED_ANSWER", 4: "REPAIR_STATUS_NOT_ACCEPTED:DIFFERENT", 6: "REPAIR_STATUS_NOT_ACCEPTED:DIFFERENT",
    }
    exact, review = programs.exact_and_review(cases)
    assert [r.id for r in exact.collect()] == [1] and sorted(r.id for r in review.collect()) == [2, 3, 4, 5, 6]
    counts = {(r.question_level, r.repair_status): r.n for r in programs.levels_by_status(cases).collect()}
    assert counts["complex", None] == 0 and counts["medium", "DIFFERENT"] == 2 and sum(counts.values()) == 6
