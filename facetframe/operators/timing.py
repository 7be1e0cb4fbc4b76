"""Stage times taken from the queries themselves: wall clock around an action, rows by observation inside it."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.frames import exists
from . import rollup

_CALL = "run string, call long, stage string, seconds double, rows long"


class Stages:
    """Calls of stages of one run. Rows are counted as they pass through the query that is running; nothing is run twice."""

    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.run, self.calls = spark, run, []

    @contextmanager
    def stage(self, name: str) -> Iterator[callable]:
        """Times the actions inside; what it gives is a function that marks the table whose rows are the stage's."""
        seen: list[Observation] = []

        def watched(df: DataFrame) -> DataFrame:
            seen.append(Observation())
            return df.observe(seen[-1], F.count(F.lit(1)).alias("rows"))

        began = time.perf_counter()
        yield watched
        seconds = time.perf_counter() - began
        rows = sum(o.get["rows"] for o in seen) if seen else None
        self.calls.append((self.run, len(self.calls), name, seconds, rows))

    def table(self) -> DataFrame:
        """run, call, stage, seconds and rows of each call."""
        return self.spark.createDataFrame(self.calls, _CALL)

    def breakdown(self) -> DataFrame:
        """Seconds, calls, mean milliseconds and rows of each stage, longest first."""
        return rollup.timers(self.table()).join(self.table().groupBy("stage").agg(F.sum("rows").alias("rows")), "stage").orderBy(F.desc("seconds"))

    def append(self, path: str) -> None:
        """Adds the run to the table at ``path``; a run that is there already is left as it is, so an append may be repeated."""
        mine = self.table()
        if exists(self.spark, path):
            mine = mine.join(read(self.spark, path).select("run").distinct(), "run", "left_anti")
        mine.coalesce(1).write.mode("append").option("header", True).csv(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(_CALL).csv(path)
