"""Facts and events as streams: windows, sessions, deduplication and interval union with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(stream: DataFrame, column: str = "ts", late: str = "1 day") -> DataFrame:
    """The column as a timestamp (watermarks refuse the zone-less type) with a watermark."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling(events: DataFrame, width: str, *keys: str, column: str = "ts", slide: str | None = None) -> DataFrame:
    """Counts and value sums by window and keys, for a stream or a table."""
    w = F.window(column, width, slide) if slide else F.window(column, width)
    out = events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, *keys: str, column: str = "ts") -> DataFrame:
    """Sessions of each key that a gap ends, for a stream or a table."""
    out = events.groupBy(F.session_window(column, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def distinct_facts(stream: DataFrame, key: str = "edge_id") -> DataFrame:
    """Each fact once within the watermark."""
    return stream.dropDuplicatesWithinWatermark([key])


def islands(facts: DataFrame, *keys: str, late: str | None = None) -> DataFrame:
    """Islands of intervals [start, end] (timestamps) of each key, as ``intervals.union`` makes them, for a stream or a table.

    An interval is a session whose gap is its own length, so Spark merges what overlaps or touches and keeps open islands only: with ``late``, an island comes
    out once, when the watermark has passed its end, and its state goes. Rows that start before the watermark are dropped. Rows without a
    start or an end, or with an end before the start, take no part.
    """
    rows = facts.where("start <= end").withColumns({"start": F.col("start").cast("timestamp"), "end": F.col("end").cast("timestamp")})
    rows = rows.withWatermark("start", late) if late is not None else rows
    # Sessions are open at their end: a microsecond more closes them, and points last as long.
    gap = F.concat((F.unix_micros("end") - F.unix_micros("start") + 1).cast("string"), F.lit(" microseconds"))
    found = rows.groupBy(F.session_window("start", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("facts"))
    return found.select(*keys, F.col("w.start").alias("start"), F.timestamp_micros(F.unix_micros("w.end") - 1).alias("end"), "facts")


def replay(table: DataFrame, column: str, folder: str, slices: int = 6, files: int = 4) -> DataFrame:
    """``table`` as a stream that brings its rows in the order of ``column``, some files a batch: slices at its quantiles are written one after another under ``folder``. Rows without the column come first."""
    spark = table.sparkSession
    at = F.unix_micros(F.col(column).cast("timestamp"))
    marks = [int(x) for x in table.select(at.cast("double").alias("at")).approxQuantile("at", [k / slices for k in range(1, slices)], 0.001)]
    place = F.size(F.filter(F.array(*(F.lit(m) for m in marks)), lambda m: at > m)) if marks else F.lit(0)
    for k in range(slices):
        table.where(F.coalesce(place, F.lit(0)) == k).coalesce(files).write.parquet(f"{folder}/slice={k}")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/slice=*")


def collected(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what there is, in append mode, and give its rows as a table; a second call with the same folder goes on where the first ended."""
    run = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def union_stream(stream: DataFrame, key: str) -> DataFrame:
    """The islands of each key as facts arrive: every batch emits the key's islands anew (update mode). Columns: key, start, end (days), version."""
    state, out = "starts array<date>, ends array<date>, version long", f"{key} string, start date, end date, version long"

    def run(name: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        starts, ends, version = held.get if held.exists else ([], [], 0)
        spans = list(zip(starts, ends))
        for batch in batches:
            spans += list(zip(batch["start"], batch["end"]))
        merged: list[list] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        held.update(([m[0] for m in merged], [m[1] for m in merged], version + 1))
        yield pd.DataFrame({key: [name[0]] * len(merged), "start": [m[0] for m in merged], "end": [m[1] for m in merged], "version": [version + 1] * len(merged)})

    return stream.groupBy(key).applyInPandasWithState(run, out, state, "update", "NoTimeout")
