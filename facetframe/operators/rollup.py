"""Roll-ups of frame metrics to scenes, datasets and methods, and of run-time records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_scene(frames: DataFrame, metrics: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each metric over the frames of a scene (NaN and null left out) and the number of frames, within ``keys``."""
    return frames.groupBy(*keys, "scene_id").agg(F.count("*").alias("num_frames"), *[F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))).alias(m) for m in metrics])


def dataset(scenes: DataFrame, metrics: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and sample deviation of the scene means, within ``keys``; a frame's weight depends on its scene's size."""
    stats = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return scenes.groupBy(*keys).agg(F.count("*").alias("num_scenes"), F.sum("num_frames").alias("num_frames_total"), *stats)


def precision_recall_f1(scenes: DataFrame, precision: str, recall: str, key: str = "method") -> DataFrame:
    """Summary of a method: F1 is of the mean precision and the mean recall, not a mean of F1."""
    means = scenes.groupBy(key).agg(F.avg(precision).alias("precision"), F.avg(recall).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return means.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def timers(calls: DataFrame) -> DataFrame:
    """Seconds, calls and mean milliseconds of each stage (stage, seconds)."""
    by = calls.groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("calls"))
    return by.withColumn("avg_ms", 1000 * F.col("seconds") / F.col("calls"))


def clock(seconds: str) -> F.Column:
    """HH:MM:SS.mmm of a number of seconds."""
    ms = F.floor(F.col(seconds) * 1000)
    part = lambda div, mod: F.floor(ms / div) % mod if mod else F.floor(ms / div)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws("", two(part(3_600_000, 0)), F.lit(":"), two(part(60_000, 60)), F.lit(":"), two(part(1000, 60)), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def depth_losses(px: DataFrame, least: float = 0.1, most: float = 300.0) -> DataFrame:
    """Planar pixels of a scene whose valid depth is outside the range, their share, and the deepest one."""
    planar = (F.col("label") > 0) & (F.col("z") > 0)
    lost = planar & ~((F.col("z") > least) & (F.col("z") < most))
    sums = px.groupBy("scene_id").agg(F.count_if(planar).alias("planar"), F.count_if(lost).alias("lost"), F.max(F.when(planar, F.col("z"))).alias("max_depth"), F.count_distinct("frame_id").alias("frames"))
    return sums.withColumn("lost_share", F.col("lost") / F.greatest("planar", F.lit(1)))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key from concatenated shards: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
