"""Work that resumes where it was left: results are kept row by row as tasks end, and a stage has one budget of failures.

The rows to do are dealt into pieces by a hash of their key, and piece after piece is run as a Spark job that appends to ``rows``. Each task's file is moved to its place when the task ends
(committer algorithm 2), so what a killed job has finished stays; the next start takes only rows whose key has no result yet (an anti join), so none is asked twice but those of
tasks that were under way. ``log`` gets a record for each piece that ended, with the failures counted by an accumulator over all tasks of the stage. When the failures reach the budget,
the driver stops before the next piece, and what is left keeps for another start.

A key may have several results (a task that was run twice, or another start that asked failed rows again): the latest attempt wins, and ``compact`` leaves only that.
Null keys are one key. Rows that agree in their key are one piece of work: the first by the order of their other columns is done. An empty table gives no results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .facts import stored_table


class BudgetSpent(RuntimeError):
    """The stage has failed as often as it may."""


@dataclass
class Pieces:
    """``folder``: a shared folder of this stage alone; ``schema``: columns of a result, with ``key`` among them."""

    spark: SparkSession
    folder: str
    key: str
    schema: T.StructType
    pieces: int = 8
    budget: int | None = None

    @property
    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("_attempt", T.LongType()), T.StructField("_part", T.StringType())])

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _rows(self) -> DataFrame:
        if not self._there("rows"):
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).option("recursiveFileLookup", True).parquet(f"{self.folder}/rows")

    def results(self) -> DataFrame:
        """The latest result of each key, of finished tasks."""
        order = Window.partitionBy(self.key).orderBy(F.desc("_attempt"), "_part", *(f.name for f in self.schema.fields if not isinstance(f.dataType, T.MapType)))
        return self._rows().withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*self.schema.names)

    def log(self) -> DataFrame:
        schema = "attempt long, piece int, failures long"
        return self.spark.read.schema(schema).json(f"{self.folder}/log") if self._there("log") else self.spark.createDataFrame([], schema)

    def _attempt(self) -> int:
        last = self._rows().agg(F.max("_attempt").alias("r")).first().r, self.log().agg(F.max("attempt").alias("r")).first().r
        return 1 + max((x for x in last if x is not None), default=0)

    def run(self, todo: DataFrame, step: Callable[[DataFrame, Accumulator], DataFrame], again: Callable[[Column], Column] | None = None, failed: str | None = None) -> DataFrame:
        """Results of all rows of ``todo``: earlier ones and those that ``step(rows, failures)`` gives now, where tasks add to ``failures``.

        With ``again`` and ``failed``, results whose column ``failed`` meets the condition are asked for again. Raises ``BudgetSpent`` when the failures of this start reach the budget.
        """
        done = self.results()
        if again is not None and failed is not None:
            done = done.where(~F.coalesce(again(F.col(failed)), F.lit(False)))
        by_key = Window.partitionBy(self.key).orderBy(*([c for c in todo.columns if c != self.key] or [self.key]))
        once = todo.withColumn("_n", F.row_number().over(by_key)).where("_n = 1").drop("_n")
        known = done.select(F.col(self.key).alias("_known"))
        piece = F.pmod(F.xxhash64(self.key), F.lit(self.pieces)).cast("int")
        left = once.join(known, F.col(self.key).eqNullSafe(F.col("_known")), "left_anti").withColumn("_piece", piece)
        left = stored_table(left)
        failures, attempt = self.spark.sparkContext.accumulator(0), self._attempt()
        for k in range(self.pieces):
            if self.budget is not None and failures.value >= self.budget:
                raise BudgetSpent(f"{failures.value} failures before piece {k} of {self.pieces}")
            made = step(left.where(F.col("_piece") == k).drop("_piece"), failures).select(*self.schema.names)
            tagged = made.withColumns({"_attempt": F.lit(attempt).cast("long"), "_part": F.lit(uuid.uuid4().hex)})
            # Each start and piece writes to a folder of its own: a job that is killed leaves its finished tasks' files there.
            tagged.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.folder}/rows/attempt={attempt}-{k}")
            self.spark.createDataFrame([(attempt, k, failures.value)], "attempt long, piece int, failures long").coalesce(1).write.mode("append").json(f"{self.folder}/log")
        return self.results()

    def compact(self, folder: str) -> Pieces:
        """The same stage under another folder, with the latest result of each key alone."""
        tagged = self.results().withColumns({"_attempt": F.lit(0).cast("long"), "_part": F.lit(uuid.uuid4().hex)})
        tagged.write.parquet(f"{folder}/rows/attempt=0")
        return Pieces(self.spark, folder, self.key, self.schema, self.pieces, self.budget)
