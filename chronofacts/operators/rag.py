"""Retrieval baselines: facts as sentences, vector retrieval, model filters and answers, pseudo documents and an iterative agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import providers as M
from ..sources.facts import stored
from . import similarity

MODES = ("llm", "cot", "rag", "rag_filter", "hyde", "hyde_filter", "query2doc", "query2doc_filter", "agent")


def sentence(head: Column, relation: Column, tail: Column, start: Column, end: Column) -> Column:
    """``head relation tail on day`` or ``... from start to end``."""
    fact = F.concat_ws(" ", head, relation, tail)
    return F.when(start == end, F.concat(fact, F.lit(" on "), start)).otherwise(F.concat(fact, F.lit(" from "), start, F.lit(" to "), end))


def line_sentence(line: Column, compat: bool = False) -> Column:
    """A fact line as a sentence: 4 or 5 tab-separated parts. With ``compat`` parts end at any white space, so names with spaces give null."""
    parts = F.split(F.regexp_replace(F.trim(line), "_", "\u0001" if compat else " "), r"\s+" if compat else "\t")
    p = lambda k: F.translate(F.get(parts, F.lit(k)), "\u0001", " ")
    return F.when(F.size(parts) == 4, sentence(p(0), p(1), p(2), p(3), p(3))).when(F.size(parts) == 5, sentence(p(0), p(1), p(2), p(3), p(4)))


def fact_text(head: Column, relation: Column, tail: Column, timestamp: Column) -> Column:
    """``[head, relation, tail]`` with `` from A to B`` or `` on X``; without a time, the triple alone."""
    triple = F.concat(F.lit("["), F.concat_ws(", ", head, relation, tail), F.lit("]"))
    span = r"^(\d{4}-\d{2}-\d{2})-(\d{4}-\d{2}-\d{2})$"  # fixed value: how the data writes an interval
    return (
        F.when(timestamp.isNull() | timestamp.isin("", "None"), triple)
        .when(timestamp.rlike(span), F.concat(triple, F.lit(" from "), F.regexp_extract(timestamp, span, 1), F.lit(" to "), F.regexp_extract(timestamp, span, 2)))
        .otherwise(F.concat(triple, F.lit(" on "), timestamp))
    )


def flat_facts(facts: DataFrame, most: int = 50) -> DataFrame:
    """Distinct facts of each question as one text, a line each, in arrival order."""
    one = F.row_number().over(Window.partitionBy("qid", "head", "relation", "tail", "timestamp", "start", "end").orderBy("pos"))
    n = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    line = F.concat_ws(", ", "head", "relation", "tail", F.when(F.col("start").isNotNull(), F.concat(F.lit("start="), F.col("start").cast("string"), F.lit(", end="), F.col("end").cast("string"))).otherwise(F.concat(F.lit("time="), F.col("timestamp"))))
    kept = facts.withColumn("_one", one).where("_one = 1").withColumn("_n", n).where(F.col("_n") <= most)
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("t")))), lambda x: x["t"]), "\n").alias("context"))


def build_corpus(sentences: DataFrame, embedder: M.Embedder, path: str) -> DataFrame:
    """id, sentence and v, written once: an existing table is read."""
    spark = sentences.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        M.embed(sentences.where("sentence IS NOT NULL"), "sentence", embedder, "v").select("id", "sentence", "v").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def retrieve(questions: DataFrame, corpus: DataFrame, embedder: M.Embedder, k: int, query: str = "query") -> DataFrame:
    """qid and contexts: the k nearest sentences, best first, ties to the smaller id."""
    q = M.embed(questions.select(F.col("qid").alias("query_id"), F.col(query)), query, embedder, "v").where("v IS NOT NULL")
    found = similarity.top_k(q.select("query_id", "v"), corpus, k).join(corpus.select("id", "sentence"), "id")
    return found.groupBy(F.col("query_id").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]).alias("contexts"))


def keep_indices(indices: Column, contexts: Column, k: int) -> Column:
    """Contexts at valid, distinct indices in the model's order, filled up to ``k`` by the original order."""
    every = F.when(F.size(contexts) > 0, F.sequence(F.lit(0), F.size(contexts) - 1)).otherwise(F.array().cast("array<int>"))
    valid = F.array_distinct(F.filter(F.coalesce(indices, F.array().cast("array<int>")), lambda i: (i >= 0) & (i < F.size(contexts))))
    return F.transform(F.slice(F.array_union(valid, every), 1, k), lambda i: F.get(contexts, i))


def prompt(question: Column, contexts: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nFacts:\n"), F.array_join(F.transform(contexts, lambda x, i: F.concat(i.cast("string"), F.lit(". "), x)), "\n"))


def filter_contexts(rows: DataFrame, provider: M.Caller, k: int) -> DataFrame:
    """The model's choice of ``k`` contexts; few contexts pass unasked, a failure keeps the first ``k``."""
    few = rows.where(F.size("contexts") <= k)
    asked = M.call(rows.where(F.size("contexts") > k).withColumn("_text", prompt(F.col("question"), F.col("contexts"))), "filter", "_text", provider)
    return few.unionByName(asked.withColumn("contexts", keep_indices(F.col("result.keep"), F.col("contexts"), k)).select(*rows.columns))


def model_answers(rows: DataFrame, provider: M.Caller) -> DataFrame:
    """llm_answer: the model's answers, or its error as the one answer."""
    got = M.call(rows.withColumn("_text", prompt(F.col("question"), F.col("contexts"))), "answer", "_text", provider)
    return got.withColumn("llm_answer", F.when(F.col("result").isNull(), F.array(F.concat(F.lit("LLM_ERROR: "), F.col("error")))).otherwise(F.coalesce("result.answers", F.array().cast("array<string>")))).drop("result", "error", "_text")


def pseudo_documents(questions: DataFrame, provider: M.Caller) -> DataFrame:
    """``pseudo``: a made-up passage that would answer the question; empty on failure."""
    return M.call(questions, "pseudo", "question", provider).withColumn("pseudo", F.coalesce("result.document", F.lit(""))).drop("result", "error")


def answer(questions: DataFrame, corpus: DataFrame, embedder: M.Embedder, provider: M.Caller, mode: str = "rag", k: int = 20, before: int = 50, steps: int = 5) -> DataFrame:
    """qid, question and llm_answer in one of ``MODES``. An unknown mode answers nothing."""
    none = F.array().cast("array<string>")
    if mode not in MODES:
        return questions.select("qid", "question", none.alias("llm_answer"))
    if mode in ("llm", "cot"):
        return model_answers(questions.select("qid", "question", none.alias("contexts")), provider).drop("contexts")
    if mode == "agent":
        return agent(questions, corpus, embedder, provider, k, steps)
    q = questions.select("qid", "question").withColumn("query", F.col("question"))
    if mode.startswith(("hyde", "query2doc")):
        q = pseudo_documents(q, provider)
        made = F.col("pseudo") if mode.startswith("hyde") else F.concat(F.col("question"), F.lit("\n"), F.col("pseudo"))
        q = q.withColumn("query", F.when(F.col("pseudo") == "", F.col("question")).otherwise(made)).drop("pseudo")
    choose = mode.endswith("filter")
    rows = q.join(retrieve(q, corpus, embedder, before if choose else k), "qid", "left").withColumn("contexts", F.coalesce("contexts", none)).drop("query")
    return model_answers(filter_contexts(rows, provider, k) if choose else rows, provider).drop("contexts")


def agent(questions: DataFrame, corpus: DataFrame, embedder: M.Embedder, provider: M.Caller, k: int = 20, steps: int = 5) -> DataFrame:
    """Search and answer in turns: one batched model call and one retrieval for all live questions at each step, ``steps`` at most.

    An answer counts only after a search; an empty or repeated query costs its step. Questions that are live at the end are asked for an answer from what they have.
    """
    none = F.array().cast("array<string>")
    live = questions.select("qid", "question", none.alias("contexts"), none.alias("queries"), F.lit(None).cast("array<string>").alias("llm_answer"))
    for _ in range(steps):
        open_rows, done = live.where("llm_answer IS NULL"), live.where("llm_answer IS NOT NULL")
        asked = M.call(open_rows.withColumn("_text", prompt(F.col("question"), F.col("contexts"))), "agent", "_text", provider)
        asked = asked.withColumn("query", F.when(F.col("result.action") == "search", F.trim("result.query")))
        asked = asked.withColumn("query", F.when((F.col("query") != "") & ~F.array_contains("queries", F.col("query")), F.col("query")))
        asked = stored(asked.withColumn("llm_answer", F.when((F.col("result.action") == "answer") & (F.size("queries") > 0), F.coalesce("result.answers", none))).drop("result", "error", "_text"))
        found = retrieve(asked.where("query IS NOT NULL").select("qid", "query"), corpus, embedder, k).withColumnRenamed("contexts", "_new")
        more = asked.join(found, "qid", "left").withColumn("contexts", F.array_distinct(F.concat("contexts", F.coalesce("_new", none)))).withColumn("queries", F.when(F.col("query").isNotNull(), F.array_append("queries", F.col("query"))).otherwise(F.col("queries")))
        live = stored(done.unionByName(more.select(*live.columns)))
    rest = model_answers(live.where("llm_answer IS NULL").select("qid", "question", "contexts"), provider)
    return live.where("llm_answer IS NOT NULL").select("qid", "question", "llm_answer").unionByName(rest.select("qid", "question", "llm_answer"))


def pending(questions: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Test questions without a result yet."""
    return questions.where("split = 'test'").join(results.select(key).distinct(), key, "left_anti")
