"""Polishing by a model: answers that may not change, feedback, and cases that fail at last."""

import json

from chronofacts.operators import polish


def model():
    class Model:  # made here, so that workers need not import this file
        def call(self, task, text):
            body, _, error = text.partition("\nprevious error: ")
            case = json.loads(body)
            q, a = case["question"], case.get("answer") or []
            if "stubborn" in q:
                return json.dumps({"question": "new", "answer": ["Eve"]})
            if "hasty" in q:
                return json.dumps({"question": f"Told {error}", "answer": a} if error else {"question": "x?", "answer": [*a, "more"]})
            if "year" in q:
                return json.dumps({"question": "When, exactly", "answer": ["2001-02-03"], "thought": " dates  it "})
            if "broken" in q:
                raise RuntimeError("no model")
            return json.dumps({"question": f"  Who   was {q}", "answer": [f" {x} " for x in a]})

    return Model()


ROWS = [(1, "plain", ["Bob"], "subject"), (2, "hasty", ["Bob"], "subject"), (3, "the year", ["2001"], "timestamp"), (4, "stubborn", ["Bob"], "subject"), (5, "broken", ["Bob"], "subject"), (6, None, ["Bob"], "subject"), (7, "no answer", None, "subject"), (8, "  ", [], None)]


def test_polish(spark):
    cases = spark.createDataFrame(ROWS, "id int, question string, answer array<string>, answer_type string").repartition(3)
    got = {r.id: r for r in polish.polished(cases, model(), retries=0).collect()}
    assert len(got) == len(ROWS)
    assert (got[1].question, got[1].answer, got[1].question_changed, got[1].answer_changed, got[1].polish_error) == ("Who was plain?", ["Bob"], True, False, None)
    assert (got[2].question, got[2].answer, got[2].polish_error) == ("Told answer_count_changed?", ["Bob"], None)
    assert (got[3].question, got[3].answer, got[3].answer_changed, got[3].repair_thought) == ("When, exactly?", ["2001-02-03"], True, "dates it")
    assert (got[4].question, got[4].answer, got[4].polish_error, got[4].question_changed) == ("stubborn", ["Bob"], "answer_must_not_change", False)
    assert got[5].question == "broken" and "no model" in got[5].polish_error
    assert got[6].polish_error == got[8].polish_error == "missing question"
    assert got[7].answer is None and got[7].polish_error is None and not got[7].answer_changed
    assert polish.polished(cases.limit(0), model()).count() == 0
