"""Stored facts (pruned files, no exchange on their side) and streams against their batch results."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from chronofacts.operators import intervals
from chronofacts.sources import store
from chronofacts.streaming import facts as stream

D = dt.date


def test_store_prunes_years_and_keeps_buckets(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for k in range(600):
        start = D(2000 + k % 10, 1 + k % 12, 1 + k % 28)
        rows.append((f"h{rnd.randrange(40)}" if k % 3 else "hot", rnd.choice("rs"), f"t{k % 7}", start, start + dt.timedelta(rnd.choice([0, 5, 900 if k % 49 == 0 else 30]))))
    rows += [(None, "r", "t", D(2001, 1, 1), D(2001, 1, 2)), ("hot", "r", "t", None, None), ("hot", "r", "t", D(2001, 1, 1), None)]
    facts = spark.createDataFrame(rows, "head string, relation string, tail string, start date, end date")
    folder = f"{tmp_path}/store"
    store.save_facts(facts, folder, 4)
    held = store.load_facts(spark, folder)
    assert Counter(map(tuple, held.facts().collect())) == Counter(rows)
    first, last = D(2003, 6, 1), D(2003, 7, 15)
    overlap = [r for r in rows if r[3] and r[4] and r[3] <= last and r[4] >= first]
    found = held.within(first, last)
    assert Counter(map(tuple, found.collect())) == Counter(overlap) and any(r[3].year < 2003 for r in overlap)
    years = {y for y, latest in held.years if y <= 2003 and latest >= first}
    assert years < {y for y, _ in held.years} and "PartitionFilters: [year" in found._jdf.queryExecution().toString()
    patterns = spark.createDataFrame([(1, "hot", "r", None), (2, "h3", None, "t1"), (3, None, "r", None), (4, "nobody", None, None)], "qid int, head string, relation string, tail string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = held.of_heads(patterns, first, last)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # One exchange, of the patterns; the facts come in their buckets.
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
        want = Counter((q, *r) for q, h, rel, t in ((1, "hot", "r", None), (2, "h3", None, "t1")) for r in overlap if r[0] == h and rel in (None, r[1]) and t in (None, r[2]))
        assert Counter(map(tuple, got.collect())) == want and want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_an_empty_store(spark, tmp_path):
    facts = spark.createDataFrame([], "head string, relation string, tail string, start date, end date")
    store.save_facts(facts, f"{tmp_path}/s", 2)
    held = store.load_facts(spark, f"{tmp_path}/s")
    assert held.facts().count() == 0 and held.within(D(2000, 1, 1), D(2001, 1, 1)).count() == 0


T0 = dt.datetime(2024, 1, 1)


def minutes(k):
    return None if k is None else T0 + dt.timedelta(minutes=k)


def test_streamed_islands_equal_the_batch_and_state_is_evicted(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), (s := rnd.randrange(20_000)), s + rnd.choice([0, 1, 5, 60])) for _ in range(1500)]
    rows += [("a", None, 5), ("a", 5, None), ("a", 9, 3), ("z", 10, 20), ("z", 20, 30), ("z", 32, 32)]
    table = spark.createDataFrame([(k, minutes(a), minutes(b)) for k, a, b in rows], "key string, start timestamp, end timestamp")
    batch = intervals.union(table.where("start <= end"), "key").select("key", "start", "end")
    assert Counter(map(tuple, stream.islands(table, "key").select("key", "start", "end").collect())) == Counter(map(tuple, batch.collect()))
    arriving = stream.replay(table, "start", f"{tmp_path}/in", slices=5, files=1)
    got = stream.collected(stream.islands(arriving, "key", late="2 hours"), f"{tmp_path}/out")
    mark = max(a for _, a, b in rows if a is not None and b is not None and a <= b) - 120
    closed = batch.where(F.col("end") < F.lit(minutes(mark)))
    assert Counter(tuple(r)[:3] for r in got.select("key", "start", "end").collect()) == Counter(map(tuple, closed.collect()))
    # A second start on the same progress brings nothing twice.
    again = stream.collected(stream.islands(arriving, "key", late="2 hours"), f"{tmp_path}/out")
    assert again.count() == got.count()


def test_stream_state_holds_open_islands_only(spark, tmp_path):
    table = spark.createDataFrame([("k", minutes(60 * h), minutes(60 * h + 5)) for h in range(240)], "key string, start timestamp, end timestamp")
    arriving = stream.replay(table, "start", f"{tmp_path}/in", slices=6, files=1)
    run = stream.islands(arriving, "key", late="3 hours").writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert len(states) >= 6 and states[-1] <= 4 and max(states) < 120
