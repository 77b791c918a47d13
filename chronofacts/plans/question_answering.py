"""The staged question-answering job: decompose, align, constrain, retrieve, answer.

Every stage is a DataFrame step over all questions, written as a table, so a rerun starts after the last complete stage.
A stage's state travels as columns: ``status`` and ``record`` are maps by stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import alignment, constraints, evaluate, match
from ..sources import providers as M
from ..sources.facts import stored

STAGES = ("decompose", "align", "constraint", "answer")
ABLATIONS = (None, "no_triple", "no_align", "no_constraint")


def with_ledger(questions: DataFrame) -> DataFrame:
    """All stages PENDING, where there is no ledger yet."""
    status = F.create_map(*(F.lit(x) for s in STAGES for x in (s, "PENDING")))
    out = questions if "status" in questions.columns else questions.withColumn("status", status)
    return out if "record" in out.columns else out.withColumn("record", F.create_map().cast("map<string,string>"))


def note(rows: DataFrame, stage: str, status: Column, message: Column) -> DataFrame:
    put = lambda m, v: F.map_concat(F.map_filter(F.col(m), lambda k, _: k != stage), F.create_map(F.lit(stage), v))
    return rows.withColumn("status", put("status", status)).withColumn("record", put("record", message))


@dataclass
class Job:
    """One run: where its tables lie, the model and the facts.

    With an embedder, alignment gives the model gold lists from the graph's vocabulary, and triples without exact matches take the 50 most similar facts
    unless ``similar`` finds others.
    """

    folder: str
    provider: M.Caller
    facts: DataFrame
    similar: Callable[[DataFrame], DataFrame] | None = None
    ablation: str | None = None
    embedder: M.Embedder | None = None
    stages: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.ablation not in ABLATIONS:
            raise ValueError(f"unknown ablation: {self.ablation}")

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table if it is complete, else made and written."""
        spark, path = self.facts.sparkSession, f"{self.folder}/{name}"
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            make().write.mode("overwrite").parquet(path)
        self.stages[name] = spark.read.parquet(path)
        return self.stages[name]

    @cached_property
    def words(self) -> dict[str, DataFrame]:
        """The vocabulary with its vectors, embedded once."""
        return {kind: stored(names) for kind, names in alignment.vocabulary(self.facts, self.embedder).items()}

    def decompose(self, questions: DataFrame) -> DataFrame:
        """Triples from the model; without any the question is skipped.

        ``no_triple`` searches with the question itself in every slot; with an embedder the three triples most similar to it stand for anchors.
        """
        if self.ablation == "no_triple":
            whole = F.array(F.col("question"), F.col("question"), F.col("question"))
            rows, anchors = questions, F.array().cast("array<array<string>>")
            if self.embedder is not None:
                asked = stored(questions.where("question IS NOT NULL").select("qid", F.lit(0).alias("place"), *(F.col("question").alias(s) for s in match.SLOTS)))
                weak = alignment.similar(asked, self.facts.select(*match.SLOTS).distinct(), self.words, self.embedder, 0.3, 3, prune=True)
                best = F.array_sort(F.collect_list(F.struct(-F.col("score_sum"), F.array(*match.SLOTS).alias("t"))))
                rows, anchors = rows.join(weak.groupBy("qid").agg(F.transform(best, lambda x: x["t"]).alias("_weak")), "qid", "left"), F.coalesce("_weak", anchors)
            return note(rows.withColumn("anchor_triples", anchors).withColumn("search_triple", whole).drop("_weak"), "decompose", F.lit("SKIPPED"), F.lit("no_triple"))
        got = M.call(questions, "decompose", "question", self.provider)
        out = got.withColumn("anchor_triples", F.coalesce("result.anchor_triples", F.array().cast("array<array<string>>"))).withColumn("search_triple", F.col("result.search_triple"))
        empty = (F.size("anchor_triples") == 0) & F.col("search_triple").isNull()
        return note(out, "decompose", F.when(F.col("error").isNotNull() | empty, "SKIPPED").otherwise("SUCCESS"), F.coalesce("error", F.when(empty, "no triples").otherwise(""))).drop("result", "error")

    def gold(self, rows: DataFrame, high: float = 0.4, low: float = 0.2, cap: int = 10) -> DataFrame:
        """Gold lists of each question from candidates of its triples: swapped and relaxed from ``high`` to ``low``."""
        slots = [F.get("t", F.lit(k)).alias(s) for k, s in enumerate(match.SLOTS)]
        each = rows.select("qid", F.posexplode("anchor_triples").alias("place", "t")).unionByName(rows.where("search_triple IS NOT NULL").select("qid", F.lit(alignment.SEARCH).alias("place"), F.col("search_triple").alias("t")))
        triples = stored(each.select("qid", "place", *slots))
        ents = stored(alignment.near_names(triples, ("head", "tail"), self.words["entity"], self.embedder, low))
        rels = stored(alignment.near_names(triples, ("relation",), self.words["relation"], self.embedder, low))
        found = stored(alignment.cascade(triples, self.facts, ents, rels, high))
        return alignment.gold_lists(triples, found, cap)

    def align(self, rows: DataFrame) -> DataFrame:
        """Triples in the graph's vocabulary from the model; a failure keeps the extracted ones. The search triple is turned as the anchors tell."""
        if self.ablation == "no_align":
            return note(rows.withColumn("aligned_anchors", F.col("anchor_triples")).withColumn("aligned_search", F.col("search_triple")), "align", F.lit("SKIPPED"), F.lit("no_align"))
        asked, lost = ["question", "anchor_triples", "search_triple"], F.lit(False)
        if self.embedder is not None:
            rows = rows.join(self.gold(rows).withColumnRenamed("problem", "_lost"), "qid", "left")
            asked, lost = [*asked, "gold_entities", "gold_relations", "gold_triples"], F.coalesce("_lost", F.lit(False))
        got = M.call(rows.withColumn("_text", F.to_json(F.struct(*asked))), "align", "_text", self.provider)
        out = got.withColumn("aligned_anchors", F.coalesce("result.anchor_triples", "anchor_triples")).withColumn("aligned_search", F.coalesce("result.search_triple", "search_triple"))
        out = out.withColumn("aligned_search", alignment.turned_search(F.col("aligned_anchors"), F.col("aligned_search")))
        problem = F.col("error").isNotNull() | F.coalesce("result.problem", F.lit(False)) | lost
        return note(out, "align", F.when(problem, "WARNING").otherwise("SUCCESS"), F.coalesce("error", F.lit(""))).drop("result", "error", "_text", "_lost", "gold_entities", "gold_relations", "gold_triples")

    def plan(self, rows: DataFrame) -> DataFrame:
        """Constraints and ranking from the model; questions without a search triple are not asked, and none is with ``no_constraint``."""
        if self.ablation == "no_constraint":
            return rows.withColumns({f.name: (F.array() if f.name == "constraints" else F.lit(None)).cast(f.dataType) for f in T.StructType.fromDDL(M.SCHEMAS["constrain"]).fields})
        none = rows.where("aligned_search IS NULL")
        got = M.call(rows.where("aligned_search IS NOT NULL").withColumn("_text", F.to_json(F.struct("question", "aligned_anchors", "aligned_search"))), "constrain", "_text", self.provider)
        kinds = {f.name: f.dataType for f in got.schema["result"].dataType.fields}
        empty = {"constraints": F.array().cast(kinds["constraints"]), "ranking": F.lit(None).cast(kinds["ranking"])}
        asked = got.withColumns({"constraints": F.coalesce("result.constraints", empty["constraints"]), "ranking": F.col("result.ranking")}).drop("result", "error", "_text")
        return asked.unionByName(none.withColumns(empty))

    def _candidates(self, rows: DataFrame, triple: Column, *extra: str) -> DataFrame:
        patterns = rows.select("qid", *extra, triple.alias("_t")).where("_t IS NOT NULL").select("qid", *extra, *(F.when(F.col("_t")[k] != "?", F.col("_t")[k]).alias(s) for k, s in enumerate(match.SLOTS)))
        found = match.exact(match.known_names(patterns, self.facts), self.facts)
        missing = patterns.join(found.select("qid", *extra).distinct(), ["qid", *extra], "left_anti")
        if self.similar is None and self.embedder is not None:
            near = alignment.similar(stored(missing.select(F.struct("qid", *extra).alias("qid"), F.lit(0).alias("place"), *match.SLOTS)), self.facts, self.words, self.embedder, 0.7, 50)
            found = found.unionByName(near.drop("place").select("qid.*", *(c for c in near.columns if c not in ("qid", "place"))), allowMissingColumns=True)
        if self.similar is not None:
            found = found.unionByName(self.similar(missing), allowMissingColumns=True)
        return found

    def retrieve(self, rows: DataFrame) -> DataFrame:
        """Evidence of each question as an array, with the accounting, and the stage's status."""
        plans = rows.select("qid", "constraints", "ranking")
        search = match.positions(self._candidates(rows, F.col("aligned_search")))
        exploded = rows.select("qid", F.posexplode("aligned_anchors").alias("anchor_index", "triple"))
        anchors = match.positions(self._candidates(exploded, F.col("triple"), "anchor_index"))
        tested = stored(constraints.apply_constraints(plans, search, anchors))
        evidence = constraints.constrained(plans, search, anchors, tested=tested)
        fields = F.struct("evidence_rank", "head", "relation", "tail", "timestamp", F.lit("search").alias("role"))
        by_search = evidence.groupBy("qid").agg(F.array_sort(F.collect_list(fields)).alias("evidence"))
        own = constraints.anchors_only(anchors).join(rows.where("aligned_search IS NULL").select("qid"), "qid")
        by_anchor = own.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("evidence_rank"), "head", "relation", "tail", "timestamp", F.lit("anchor").alias("role")))).alias("evidence"))
        stats = constraints.evidence_stats(plans, search, anchors, tested=tested)
        out = rows.join(by_search.unionByName(by_anchor), "qid", "left").join(stats, "qid", "left")
        nothing = F.col("evidence").isNull()
        status = F.when(nothing | (F.col("aligned_search").isNotNull() & (F.size("constraints") == 0)), "WARNING").otherwise("SUCCESS")
        if self.ablation == "no_constraint":
            return note(out, "constraint", F.when(nothing, "WARNING").otherwise("SKIPPED"), F.lit("no_constraint"))
        return note(out, "constraint", status, F.when(nothing, "no evidence").otherwise(""))

    def answer(self, rows: DataFrame) -> DataFrame:
        """The model's answers from the evidence text; without evidence, null and a warning."""
        text = F.concat(F.col("question"), F.lit("\n"), F.coalesce(F.array_join(F.transform("evidence", lambda e: F.concat_ws(" | ", e["head"], e["relation"], e["tail"], e["timestamp"])), "\n"), F.lit("")))
        got = M.call(rows.withColumn("_text", text), "answer", "_text", self.provider)
        out = got.withColumn("predict_answer", F.when(F.col("evidence").isNotNull(), F.col("result.answers"))).withColumn("predict_thought", F.col("result.thought"))
        return note(out, "answer", F.when(F.col("error").isNotNull() | F.col("evidence").isNull(), "WARNING").otherwise("SUCCESS"), F.coalesce("error", F.lit(""))).drop("result", "error", "_text")

    def run(self, questions: DataFrame) -> DataFrame:
        """All stages; the cleaned result keeps the question's own fields, answers, status and statistics."""
        rows = self.stage("decompose", lambda: self.decompose(with_ledger(questions)))
        aligned = self.stage("align", lambda: self.align(rows))
        planned = self.stage("plan", lambda: self.plan(aligned))
        found = self.stage("constraint", lambda: self.retrieve(planned))
        return self.stage("answer", lambda: self.answer(found)).drop("evidence", "anchor_triples", "search_triple")


def evaluation(results: DataFrame, level: str = "question_level", kind: str = "question_type") -> dict[str, DataFrame]:
    """Tables of a job's results by level, kind and overall: ``compression`` of the evidence and, where the questions carry ``answer``, ``hits`` at 1 and 10.

    Questions without evidence or without a search count with the counts they have; a question whose level or kind is missing is counted as unknown.
    """
    tables = {"compression": evaluate.by_groups(results, level, kind, *evaluate.compression("retrieved_count", "final_count"))}
    if "answer" in results.columns:
        tables["hits"] = evaluate.hits(results, "predict_answer", "answer", [level, kind])
    return tables
