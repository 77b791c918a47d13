"""Counts of interval relations: strips are as many as the rows need, and days that share a place are asked once."""

import datetime as dt

import numpy as np

from chronofacts.operators import dominance, intervals


def test_strips_follow_the_rows(spark, monkeypatch):
    """A fixed number of shuffle partitions, or one by shuffled bytes, let strips grow with the table."""
    whole, most = dominance._strip, 400

    def watched(by, name):
        run = whole(by, name)

        def checked(batches):
            held = list(batches)
            assert sum(b.num_rows for b in held) <= most
            yield from run(iter(held))

        return checked

    monkeypatch.setattr(dominance, "_strip", watched)
    monkeypatch.setattr(dominance, "STRIP_ROWS", 150, raising=False)
    points = spark.range(1500).selectExpr("'k' AS key", "id AS s", "(id * 7) % 1500 AS e", "CAST(1 AS BIGINT) AS n")
    queries = spark.range(1500).selectExpr("'k' AS key", "id AS query", "(id * 11) % 1500 AS s", "(id * 13) % 1500 AS e")
    ends = np.arange(1500) * 7 % 1500
    brute = {k: int((ends[: k * 11 % 1500] < k * 13 % 1500).sum()) for k in range(1500)}
    assert {r.query: r.found for r in dominance.counts(points, queries).collect()} == {k: n for k, n in brute.items() if n}


def test_days_that_share_a_place_are_asked_once(spark, monkeypatch):
    """One key, many intervals, four different ends: no more queries than ends, and a point for each start."""
    sizes, counts = [], dominance.counts
    monkeypatch.setattr(dominance, "counts", lambda p, q: (sizes.append((p.count(), q.count())), counts(p, q))[1])
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(k)
    rows = [("k", day(s), day(100 + e)) for s in range(60) for e in range(4)] + [("k", day(101), day(102))]
    found = intervals.relation_counts(spark.createDataFrame(rows, "key string, start date, end date"), "key", "meets")
    assert {(r.start, r.end): r.matches for r in found.collect()} == {(s, e): int(e == day(101)) for _, s, e in rows}
    assert sizes == [(61, 8)]
