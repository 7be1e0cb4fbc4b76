"""Canonical storage of frames: a row with array columns for each frame, partitioned by scene.

Arrays keep a frame's raster together (one row, not one row a pixel); ``exploded`` gives the relational view of the columns asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import written

LABEL_MOST = 65535
#: Pixels that are worth a file, and a task to write it.
FILE_PIXELS = 1 << 18


def packed(px: DataFrame, values: list[str]) -> DataFrame:
    """Pixels (scene_id, frame_id, v, u, values) to frames with h, w and an array for each value, rows first."""
    ordered = px.groupBy("scene_id", "frame_id").agg(F.sort_array(F.collect_list(F.struct("v", "u", *values))).alias("p"), (F.max("v") + 1).alias("h"), (F.max("u") + 1).alias("w"))
    return ordered.select("scene_id", "frame_id", "h", "w", *[F.col(f"p.{c}").alias(c) for c in values])


def exploded(frames: DataFrame, values: list[str], whole: list[str] | None = None) -> DataFrame:
    """Frames to pixels; only the arrays named are read. Each pixel has the frame's columns ``whole`` too."""
    own = whole or []
    rows = frames.select("scene_id", "frame_id", *own, "w", F.posexplode(F.arrays_zip(*values)).alias("k", "p"))
    return rows.select("scene_id", "frame_id", *own, F.floor(F.col("k") / F.col("w")).cast("int").alias("v"), (F.col("k") % F.col("w")).cast("int").alias("u"), *[F.col(f"p.{c}").alias(c) for c in values])


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def save(frames: DataFrame, path: str, labels: str | None = None, files: int = 8) -> None:
    """Adds the frames that the table at ``path`` does not have yet, so that a save may be repeated.

    A scene's frames go to ``files`` files at most, each made by a task; a scene of ``FILE_PIXELS`` or fewer is one file. A label beyond
    16 bits is an error and nothing is written.
    """
    if labels:
        worst = F.array_max(labels)
        checked = F.when(worst > LABEL_MOST, F.raise_error(F.concat(F.lit("label overflow in frame "), F.col("frame_id").cast("string")))).otherwise(F.col(labels))
        frames = frames.withColumn(labels, checked)
    if exists(frames.sparkSession, path):
        frames = not_yet(frames, path)
    _dealt(frames, files).sortWithinPartitions("scene_id", "frame_id").write.mode("append").partitionBy("scene_id").parquet(path)


def _dealt(frames: DataFrame, files: int) -> DataFrame:
    """Frames by scene and file, over as many tasks as their pixels are worth.

    Spark would choose tasks by shuffled bytes, and frames alike compress to next to none: one task would write every scene's files. Only
    scenes of more than ``FILE_PIXELS`` are broadcast.
    """
    pixels = F.sum(F.col("h").cast("long") * F.col("w")) if {"h", "w"} <= set(frames.columns) else F.count("*") * FILE_PIXELS
    scenes = written(frames.groupBy("scene_id").agg(F.least(F.lit(files), pixels / FILE_PIXELS).alias("worth")))
    tasks = math.ceil(scenes.agg(F.sum("worth")).first()[0] or 1)
    large = scenes.where("worth > 1").select(F.col("scene_id").alias("_scene"), F.ceil("worth").alias("_files"))
    known = frames.join(F.broadcast(large), F.col("scene_id").eqNullSafe(F.col("_scene")), "left")
    return known.repartition(tasks, "scene_id", F.pmod(F.xxhash64("frame_id"), F.coalesce("_files", F.lit(1)))).drop("_scene", "_files")


def read(spark: SparkSession, path: str, scenes: list | None = None) -> DataFrame:
    """The table, or some scenes of it: other partitions are not listed."""
    table = spark.read.parquet(path)
    return table.where(F.col("scene_id").isin(scenes)) if scenes is not None else table


def not_yet(frames: DataFrame, path: str) -> DataFrame:
    """Frames that are not in the table at ``path``: what a run that is resumed has left to do."""
    done = frames.sparkSession.read.parquet(path).select(F.col("scene_id").cast(frames.schema["scene_id"].dataType).alias("scene_id"), "frame_id")
    return frames.join(done, ["scene_id", "frame_id"], "left_anti")


def half(column: str) -> F.Column:
    """A value rounded to the 11 significant bits of a 16-bit float, in its normal range."""
    c = F.col(column).cast("double")
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(c))) - 10)
    return F.when(c == 0, 0.0).otherwise(F.rint(c / unit) * unit).cast("float")
