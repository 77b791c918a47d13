"""Plain day texts are read as before and do not pay for the general parser."""

import time

from pyspark.sql import functions as F

from chronofacts.functions import timeparse as D


def test_plain_days_are_read_directly(spark):
    texts = ["2000-01-31", "2000-02-30", "0000-01-01", "2000-01-31-1999-01-01", "2000-01-31-2000-13-01", "2000-01-31\n", " 2000-01-31", "2000-01-31 - 2000-02-01", "1999-2000", "", None]
    same = [spark.createDataFrame([(t, None if t is None else f" {t} ") for t in texts], "a string, b string").select(f(F.col(c)).alias("t")).selectExpr("CASE WHEN t IS NOT NULL THEN concat_ws(',', t.start, t.end, t.granularity, t.is_interval) END AS t") for f in (D.normalize_time, D.normalize_time_strict) for c in ("a", "b")]
    plain, padded, strict, strict_padded = ([r.t for r in df.collect()] for df in same)
    assert plain == padded and strict == strict_padded and plain[0] and plain[3] and strict[3] is None

    def seconds(text):
        began = time.perf_counter()
        spark.range(0, 40_000, 1, 1).select(D.normalize_time(F.concat(text, F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))).alias("t")).agg(F.max("t.start")).collect()
        return time.perf_counter() - began

    for text in (F.lit("2000-01-"), F.lit(" 2000-01-")):
        seconds(text)
    assert seconds(F.lit("2000-01-")) < 0.6 * seconds(F.lit(" 2000-01-"))
