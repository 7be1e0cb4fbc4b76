"""Stored predictions of several methods, met with a ground truth frame by frame: keys, sizes and labels made alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["scene_id", "frame_id"]


@dataclass(frozen=True)
class Method:
    """A method's frames (scene_id, frame_id, h, w, label); without any, the ground truth itself.

    ``nonplanar`` becomes 0, then ``offset`` is added to every label. ``by_place``: frames are numbered anew, so one whose own
    number is not stored takes the stored frame at its place in the scene.
    """

    name: str
    stored: DataFrame | None = None
    offset: int = 0
    nonplanar: int | None = None
    by_place: bool = False

    def labels(self) -> Column:
        own = lambda x: F.when(x == self.nonplanar, 0).otherwise(x) if self.nonplanar is not None else x
        return F.transform("label", lambda x: (own(x) + self.offset).cast("int"))


def resized(label: str, size: tuple[str, str], new: tuple[str, str]) -> Column:
    """An array of a raster (rows first) at another size: each new pixel takes the pixel that it falls on."""
    (h, w), (H, W) = ([F.col(c).cast("long") for c in pair] for pair in (size, new))
    place = lambda k: F.floor(F.floor(k / W) * h / H) * w + F.floor((k % W) * w / W)
    taken = F.transform(F.sequence(F.lit(0).cast("long"), H * W - 1), lambda k: F.get(label, place(k).cast("int")))
    return F.when((h == H) & (w == W), F.col(label)).otherwise(taken)


def _placed(keys: DataFrame, within: list[str]) -> DataFrame:
    return keys.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy("frame_id")))


def resolved(truth: DataFrame, stored: DataFrame, by_place: list[str]) -> DataFrame:
    """method, scene_id, frame_id and ``own``, the stored frame that answers it; keys only.

    ``stored``: method, scene_id, frame_id. The frame's own number comes first; methods ``by_place`` take what is left by the
    place in the scene. Frames that nothing answers have no row.
    """
    theirs = stored.withColumnRenamed("frame_id", "own")
    direct = truth.withColumn("own", F.col("frame_id")).join(theirs, ["scene_id", "own"])
    direct = direct.select("method", *FRAME, "own")
    if not by_place:
        return direct
    numbered = _placed(stored.where(F.col("method").isin(by_place)), ["method", "scene_id"]).withColumnRenamed("frame_id", "own")
    rest = _placed(truth, ["scene_id"]).join(numbered, ["scene_id", "place"]).join(direct, ["method", *FRAME], "left_anti")
    return direct.union(rest.select("method", *FRAME, "own"))


def met(truth: DataFrame, methods: list[Method]) -> DataFrame:
    """The rows of ``truth`` (scene_id, frame_id, h, w, label and more) once for each method that has the frame, with ``method`` and ``pred``.

    Keys are resolved first, on tables without arrays; then each array is shuffled once, to the frame that it answers. A frame
    that is stored twice is an error of the caller's: both rows stay.
    """
    named = [(m, m.stored if m.stored is not None else truth) for m in methods]
    parts = [t.select(F.lit(m.name).alias("method"), *FRAME, F.col("h").alias("ph"), F.col("w").alias("pw"), m.labels().alias("pred")) for m, t in named]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    keys = resolved(truth.select(*FRAME), every.select("method", *FRAME), [m.name for m in methods if m.by_place])
    own = every.withColumnRenamed("frame_id", "own").hint("merge").join(keys, ["method", "scene_id", "own"]).drop("own")
    # arrays are small in their files and large in memory, so neither side may be broadcast by its size
    return truth.hint("merge").join(own, FRAME).withColumn("pred", resized("pred", ("ph", "pw"), ("h", "w"))).drop("ph", "pw")
