"""Interval relations of which one range or none is asked are counted without Python tasks."""

import datetime as dt
import random
from collections import Counter

import pytest

from chronofacts.operators import dominance, intervals


def _inclusive(xs, xe, ys, ye):
    return {
        "before": xe < ys, "after": xs > ye, "equal": xs == ys and xe == ye, "starts": xs == ys and xe <= ye, "started_by": xs == ys and xe >= ye,
        "finishes": xs >= ys and xe == ye, "finished_by": xs <= ys and xe == ye, "meets": xe == ys, "metby": xs == ye,
    }


@pytest.mark.parametrize("relation", list(_inclusive(0, 0, 0, 0)))
def test_one_range_needs_no_strips(spark, monkeypatch, relation):
    """A strip held by a Python task is what memory went to; keys, days and whole intervals repeat here, and some end before they start."""

    def strip(*_):
        raise AssertionError("a strip in Python")

    monkeypatch.setattr(dominance, "_strip", strip)
    dice = random.Random(5)
    spans = [(f"k{dice.randrange(3)}", s, s + dice.randrange(-2, 9)) for s in (dice.randrange(25) for _ in range(400))]
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(k)
    df = spark.createDataFrame([(k, day(s), day(e)) for k, s, e in spans] + [(None, day(1), day(2))], "key string, start date, end date")
    counted = Counter(spans)
    want = {(k, day(s), day(e)): (n, sum(m for (q, c, d), m in counted.items() if q == k and _inclusive(s, e, c, d)[relation])) for (k, s, e), n in counted.items()}
    assert {(r.key, r.start, r.end): (r.n, r.matches) for r in intervals.relation_counts(df, "key", relation).collect()} == want
