"""Frame sources by name: each gives scene_id, frame_id, h, w, depth and label arrays, and takes every ``step``-th frame of a scene.

A new source is a function in ``ADAPTERS``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from . import arrays, frames

COLUMNS = ["scene_id", "frame_id", "h", "w", "depth", "label"]


def table(spark: SparkSession, path: str) -> DataFrame:
    """Canonical Parquet frames."""
    return frames.read(spark, path).select(*COLUMNS)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """A folder of NPZ archives named <scene>_<frame>_d2.npz."""
    found = arrays.read(spark, path)
    name = F.regexp_extract("path", r"([0-9]+)_([0-9]+)_d2[.]npz$", 1), F.regexp_extract("path", r"([0-9]+)_([0-9]+)_d2[.]npz$", 2)
    return found.select(name[0].cast("long").alias("scene_id"), name[1].cast("long").alias("frame_id"), "h", "w", "depth", "label")


ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"table": table, "archives": archives}


def scenes(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return ADAPTERS[kind](spark, path).select("scene_id").distinct()


def read(spark: SparkSession, kind: str, path: str, step: int = 1) -> DataFrame:
    rows = ADAPTERS[kind](spark, path)
    return rows if step == 1 else sampling.stride(rows, ["scene_id"], "frame_id", step).drop("pos")
