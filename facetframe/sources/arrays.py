"""NPZ archives of single frames, read by Spark's binary file source and decoded in batches."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

FRAMES = "path string, h int, w int, depth array<float>, label array<int>, planes array<array<float>>, fx double, fy double, cx double, cy double"

#: Pixels of decoded archives that a task holds at once; an archive is never cut.
HELD = 1 << 20

INTRINSIC = {"fx": (0, 0), "fy": (1, 1), "cx": (0, 2), "cy": (1, 2)}


def decode(raw: bytes, nonplanar: int = 20) -> dict:
    """Depth, labels (0 for non-planar, the others moved up by one), n/d planes and intrinsics, null without any, of one archive."""
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        k = z["intrinsic"].astype(float) if "intrinsic" in z.files else np.full((3, 3), np.nan)
        depth, seg, planes = z["depth"].astype(np.float32), z["segmentation"].astype(np.int32), z["plane"].astype(np.float32)
    label = np.where(seg == nonplanar, 0, seg + 1)
    return {"h": seg.shape[0], "w": seg.shape[1], "depth": depth.ravel(), "label": label.ravel(), "planes": list(planes), **{n: None if np.isnan(k[at]) else k[at] for n, at in INTRINSIC.items()}}


def encode(depth: np.ndarray, seg: np.ndarray, planes: np.ndarray, intrinsic: np.ndarray | None = None) -> bytes:
    out = io.BytesIO()
    np.savez(out, depth=depth, segmentation=seg, plane=planes, **({} if intrinsic is None else {"intrinsic": intrinsic}))
    return out.getvalue()


def decoded(rows: DataFrame) -> DataFrame:
    """Frames of archives given as (path, content); empty files are left out."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, pixels = [], 0
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                held.append({"path": path, **decode(raw)})
                pixels += held[-1]["h"] * held[-1]["w"]
                if pixels >= HELD or len(held) >= 1000:
                    yield pd.DataFrame(held)
                    held, pixels = [], 0
        if held:
            yield pd.DataFrame(held)

    return rows.where(F.length("content") > 0).select("path", "content").mapInPandas(run, FRAMES)


def read(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder)
    return decoded(found.where("length > 0").select("path", "content"))


def at_size(rows: DataFrame, height: int, width: int) -> DataFrame:
    """Frames at another size: labels and depth take the pixel each new one falls on, the intrinsics go with the size."""
    from .predictions import resized

    new = rows.withColumns({"_h": F.lit(height), "_w": F.lit(width)})
    x, y = F.col("_w") / F.col("w"), F.col("_h") / F.col("h")
    moved = {**{c: resized(c, ("h", "w"), ("_h", "_w")) for c in ("depth", "label")}, "fx": F.col("fx") * x, "cx": F.col("cx") * x, "fy": F.col("fy") * y, "cy": F.col("cy") * y}
    return new.withColumns(moved).drop("h", "w").withColumnsRenamed({"_h": "h", "_w": "w"})
