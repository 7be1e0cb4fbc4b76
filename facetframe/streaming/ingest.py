"""Structured Streaming over newly landed frames: the batch operators, kept up to date as scenes arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics


def contingency_stream(spark: SparkSession, source: str, schema: str, files: int = 4) -> DataFrame:
    """Contingency counts of frames from a folder that label tables land in. The state is one row a label pair of a frame."""
    landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return metrics.contingency(landed)


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "update") -> None:
    """Processes what has landed, keeping each batch's changes as files of its own number.

    A batch that is run again after a failure replaces its own files, so the sink is exactly-once.
    """
    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{table}/batch_id={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, table: str, keys: list[str], value: str) -> DataFrame:
    """The latest value of each key among the changes written by ``run_available``."""
    return spark.read.parquet(table).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def windowed(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts of tumbling windows; rows that come later than ``late`` behind the newest are dropped (works on streams and tables)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
