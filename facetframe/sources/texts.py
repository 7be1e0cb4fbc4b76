"""Text, CSV and JSON sources: scene lists, extrinsics, poses, segments, legends, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSES = "map<string, struct<intrinsic: array<array<double>>, aligned_pose: array<array<double>>>>"


def scene_list(lines: DataFrame) -> DataFrame:
    """Scene names of lines (value): one a line or with commas between; empty lines and comments are left out."""
    each = lines.select(F.explode(F.split("value", ",")).alias("scene")).select(F.trim("scene").alias("scene"))
    return each.where((F.col("scene") != "") & ~F.col("scene").startswith("#"))


def extrinsics(lines: DataFrame, camera: int = 0) -> DataFrame:
    """frame_id (five digits) and 16 numbers of a pose from lines ``frame camera r11 ... 1``; other lines are left out."""
    word = F.split(F.trim("value"), r"\s+")
    rows = lines.select(word.alias("w")).where((F.size("w") == 18) & (F.get("w", F.lit(1)).try_cast("int") == camera))
    return rows.select(F.lpad(F.get("w", F.lit(0)), 5, "0").alias("frame_id"), F.transform(F.slice("w", 3, 16), lambda x: x.cast("double")).alias("pose"))


def poses(files: DataFrame) -> DataFrame:
    """frame_id, fx, fy, cx, cy and the 12 numbers of the pose from JSON text (value) of frame to intrinsic and aligned_pose."""
    rows = files.select(F.explode(F.from_json("value", POSES)).alias("frame_id", "p"))
    at = lambda i, j: F.col("p.intrinsic")[i][j]
    return rows.select("frame_id", at(0, 0).alias("fx"), at(1, 1).alias("fy"), at(0, 2).alias("cx"), at(1, 2).alias("cy"), F.flatten(F.slice("p.aligned_pose", 1, 3)).alias("pose"))


def segment_labels(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Label of each vertex from its segment (scene_id, segIndices) and the groups' segments; the last group wins, ``unannotated`` else."""
    vertex = segments.select("scene_id", F.posexplode("segIndices").alias("vid", "segment"))
    owner = groups.select("scene_id", F.posexplode("segGroups").alias("k", "g")).select("scene_id", "k", F.col("g.label").alias("label"), F.explode("g.segments").alias("segment"))
    owner = owner.groupBy("scene_id", "segment").agg(F.max_by("label", "k").alias("label"))
    return vertex.join(owner, ["scene_id", "segment"], "left").select("scene_id", "vid", F.coalesce("label", F.lit("unannotated")).alias("label"))


def group_names(rows: DataFrame, most: int) -> DataFrame:
    """Names for ids 0 to ``most``; ids without one are ``unknown_<id>``."""
    ids = rows.sparkSession.range(most + 1).withColumnRenamed("id", "group_id")
    return ids.join(rows.select("group_id", "group_name"), "group_id", "left").select("group_id", F.coalesce("group_name", F.concat(F.lit("unknown_"), F.col("group_id").cast("string"))).alias("group_name"))


def save_results(frames: DataFrame, scenes: DataFrame, dataset: DataFrame, path: str) -> None:
    """The three levels of results as CSV folders."""
    for table, name in ((frames, "results"), (scenes, "results_per_scene"), (dataset, "results_dataset")):
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def append_runtimes(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)
