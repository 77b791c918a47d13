"""Polishing of questions by a model, whose answers must stay what they are.

Every case is asked once; replies that break a rule are asked again with the rule's name as feedback, ``rounds`` times at most. A round is one batched call over the
cases that are left, and is stored. What fails at last keeps its question and answer and tells why.

``cases``: id, question, answer (array), answer_type and others. A null or empty question is not asked (``missing question``); a null answer counts as none; repeated
cases are asked each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import providers as M
from ..sources.facts import stored
from . import curate

PAYLOAD = ("question", "answer", "question_type", "answer_type", "temporal_relation", "events")


def _items(answers: Column) -> Column:
    return F.transform(F.coalesce(answers, F.array().cast("array<string>")), lambda x: X.collapse(F.coalesce(x, F.lit(""))))


def _asked_text(question: Column, fallback: Column) -> Column:
    """Single spaces, the old question where nothing is left, and a question mark at the end."""
    text = X.collapse(F.coalesce(question, F.lit("")))
    text = F.when(text == "", X.collapse(fallback)).otherwise(text)
    return F.when(text.endswith("?"), text).otherwise(F.concat(text, F.lit("?")))


def polished(cases: DataFrame, provider: M.Caller, rounds: int = 2, **options) -> DataFrame:
    """``cases`` with question and answer as polished, repair_thought, question_changed, answer_changed and polish_error (null where it worked)."""
    payload = F.to_json(F.struct(*(c for c in PAYLOAD if c in cases.columns)))
    none = F.lit(None).cast("string")
    left = cases.withColumns({"repair_thought": none, "question_changed": F.lit(False), "answer_changed": F.lit(False), "polish_error": none})
    empty = F.coalesce(F.trim("question"), F.lit("")) == ""
    finished = left.where(empty).withColumn("polish_error", F.lit("missing question"))
    left = left.where(~empty)
    for _ in range(rounds + 1):
        feedback = F.when(F.col("polish_error").isNotNull(), F.concat(F.lit("\nprevious error: "), F.col("polish_error"))).otherwise("")
        replies = stored(M.call(left.withColumn("_text", F.concat(payload, feedback)), "polish", "_text", provider, **options))
        new = _items(F.col("result.answer"))
        error = F.coalesce("error", F.when(F.col("result.answer").isNull(), "answer_missing"), curate.answer_change_error(F.coalesce("answer_type", F.lit("")), _items(F.col("answer")), new))
        judged = replies.withColumn("polish_error", error).withColumns({"_new": new, "_question": _asked_text(F.col("result.question"), F.col("question"))})
        kept = F.when(F.col("_new") == _items(F.col("answer")), F.col("answer")).otherwise(F.col("_new"))
        good = judged.where("polish_error IS NULL").withColumns({
            "repair_thought": X.collapse(F.coalesce("result.thought", F.lit(""))), "question_changed": F.col("_question") != F.col("question"), "answer_changed": ~kept.eqNullSafe(F.col("answer")), "question": F.col("_question"), "answer": kept,
        })
        finished = finished.unionByName(good.select(*finished.columns))
        left = stored(judged.where("polish_error IS NOT NULL").select(*finished.columns))
        if left.isEmpty():
            break
    return finished.unionByName(left)
