"""Scans of whole datasets over tables of frames: planes joined with semantics, depth and poses, scenes from split lists.

A dataset is a folder of tables made by ``frames.save``; what a scan may lack is joined by key and stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names
from ..operators import sampling
from . import frames, texts

KEY = ["scene_id", "frame_id"]
IDENTITY = [float(i % 5 == 0) for i in range(16)]


def split_scenes(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Scenes of a split's list in natural order; ``most`` of them."""
    scenes = texts.scene_list(spark.read.text(path)).distinct()
    return scenes if most is None else sampling.position(scenes, names.natural("scene")).where(F.col("pos") < most).select("scene")


def _of(table: DataFrame, scenes: DataFrame | None) -> DataFrame:
    named = table.withColumn("scene_id", F.col("scene_id").cast("long"))
    return named if scenes is None else named.join(scenes.select(F.col("scene").cast("long").alias("scene_id")), "scene_id", "left_semi")


def indoor(spark: SparkSession, root: str, split: str, need_planes: bool = True, most: int | None = None) -> DataFrame:
    """scene_id, frame_id, h, w, label, semantic, depth (metres) and c2w of a split's frames.

    Frames are those of ``depth``, which has millimetres; a frame without a pose is left out, one without planes too unless
    ``need_planes`` is false. Semantics may be missing. Planes without depth are an error.
    """
    scenes = split_scenes(spark, f"{root}/splits/{split}.txt", most)
    table = lambda name, *columns: _of(frames.read(spark, f"{root}/{name}"), scenes).select(*KEY, *columns)
    depth = table("depth", "h", "w", F.transform("mm", lambda x: x / 1000.0).alias("depth"))
    planes = table("planes", "label").withColumn("_has", F.lit(True))
    poses = _of(spark.read.schema("scene_id long, frame_id long, c2w array<double>").json(f"{root}/poses"), scenes)
    both = depth.join(planes.hint("merge"), KEY, "full")
    unseen = F.when(F.col("depth").isNull(), F.raise_error(F.concat(F.lit("no depth of frame "), F.col("frame_id").cast("string")))).otherwise(F.col("label"))
    both = both.withColumn("label", unseen)
    both = both.where("_has") if need_planes else both
    return both.drop("_has").join(table("semantics", "semantic").hint("merge"), KEY, "left").join(poses.hint("merge"), KEY).select(*KEY, "h", "w", "label", "semantic", "depth", "c2w")


def cameras(spark: SparkSession, root: str, matrix: list[list[float]], width: int, height: int, ray_cast: bool = True) -> DataFrame:
    """scene_id, cam, frame_id, v, u, label and z of renders by camera: Euclidean depth turned to z, or ray-cast z where there is one."""
    key = ["scene_id", "cam", "frame_id"]
    own = spark.read.parquet(f"{root}/renders").withColumn("scene_id", F.col("scene_id").cast("long"))
    px = own.select(*key, F.posexplode(F.arrays_zip("label", "distance")).alias("k", "p")).select(*key, F.floor(F.col("k") / width).cast("int").alias("v"), (F.col("k") % width).cast("int").alias("u"), "p.label", "p.distance")
    px = px.withColumn("z", G.matrix_euclidean_to_z("distance", matrix, width, height)).drop("distance")
    if not ray_cast:
        return px
    cast = spark.read.parquet(f"{root}/ray_cast").withColumn("scene_id", F.col("scene_id").cast("long")).select(*key, F.posexplode("zdepth").alias("k", "ray"))
    cast = cast.select(*key, F.floor(F.col("k") / width).cast("int").alias("v"), (F.col("k") % width).cast("int").alias("u"), "ray")
    # a raster's file says little of its rows: by its size, pixels by the million would be broadcast
    return px.join(cast.hint("merge"), [*key, "v", "u"], "left").withColumn("z", F.coalesce("ray", "z")).drop("ray")


def save_outdoor(rows: DataFrame, planes: DataFrame, attributes: DataFrame, root: str) -> None:
    """An outdoor dataset's three tables: frames with arrays, planes (a row each) and a scene's attributes (fx, fy, cx, cy, unit)."""
    frames.save(rows, f"{root}/frames", "label")
    planes.write.mode("overwrite").json(f"{root}/planes")
    attributes.write.mode("overwrite").json(f"{root}/attributes")


def outdoor(spark: SparkSession, root: str, samples: int | None = None) -> DataFrame:
    """Frames of an outdoor dataset with the camera of their scene; without a pose they have the identity. ``samples`` evenly spaced ones of a scene."""
    rows = _of(frames.read(spark, f"{root}/frames"), None)
    if "c2w" not in rows.columns:
        rows = rows.withColumn("c2w", F.lit(None).cast("array<double>"))
    camera = spark.read.schema("scene_id long, fx double, fy double, cx double, cy double").json(f"{root}/attributes")
    rows = rows.join(camera, "scene_id").withColumn("c2w", F.coalesce("c2w", F.lit(IDENTITY)))
    return rows if samples is None else sampling.linspace(rows, "frame_id", samples, ["scene_id"]).drop("pos")


def variants(spark: SparkSession, root: str, wanted: list[str]) -> DataFrame:
    """Frames of a dataset by scene and variant; other variants' folders are not read. A frame without a pose has the identity."""
    rows = spark.read.parquet(root).where(F.col("variant").isin(wanted))
    return rows.withColumns({"scene_id": F.col("scene_id").cast("long"), "c2w": F.coalesce("c2w", F.lit(IDENTITY))})


def mesh_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Faces with 0-based corners and their name, and the legend, from the tables faces (scene_id, fid, a, b, c), semantics and names.

    Indices are shifted by one in the scenes where the least is 1.
    """
    faces, semantic, legend = (spark.read.parquet(f"{root}/{n}") for n in ("faces", "semantics", "names"))
    base = faces.groupBy("scene_id").agg(F.when(F.min(F.least("a", "b", "c")) == 1, 1).otherwise(0).alias("base"))
    shifted = faces.join(base, "scene_id").select("scene_id", "fid", *[(F.col(c) - F.col("base")).alias(f"v{k}") for k, c in enumerate("abc")])
    named = shifted.join(semantic, ["scene_id", "fid"], "left").join(legend, "semantic", "left").select("scene_id", "fid", "v0", "v1", "v2", F.coalesce("name", F.lit("unannotated")).alias("name"))
    counts = named.groupBy("name").agg(F.count("*").alias("face_count"))
    return named, counts
