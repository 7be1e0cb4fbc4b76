"""Queries that write datasets as tables of frames and scan them: joins, pruning and checks as a reader of them needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import datasets, frames
from ._common import registrar, rounded
from .fixtures import sql, view
from .frame_queries import MATRIX

QUERIES, query = registrar()

PX, FACES = sql("px_grid"), sql("mesh_faces")
def _pose():
    """A pose that is moved by the frame's number along x."""
    moved = [F.lit(v) for v in datasets.IDENTITY]
    return F.array(*moved[:3], F.col("frame_id").cast("double"), *moved[4:])


def _indoor_root(spark, sf):
    """Planes of three frames in four, semantics of every third, poses of four in five; the list names even scenes."""
    at, px = shared_path(spark, "indoor"), view(spark, sf, "px_grid")
    packed = frames.packed(px.withColumns({"mm": F.rint(F.col("z") * 1000).cast("int"), "semantic": F.col("label") + 10}), ["mm", "label", "semantic"]).cache()
    frames.save(packed.drop("label", "semantic"), f"{at}/depth")
    frames.save(packed.where("frame_id % 4 <> 0").drop("mm", "semantic"), f"{at}/planes", "label")
    frames.save(packed.where("frame_id % 3 = 0").drop("mm", "label"), f"{at}/semantics")
    packed.where("frame_id % 5 <> 0").select("scene_id", "frame_id", _pose().alias("c2w")).write.json(f"{at}/poses")
    packed.where("scene_id % 2 = 0").select(F.col("scene_id").cast("string").alias("value")).distinct().union(spark.createDataFrame([("# test scenes",)], "value string")).write.text(f"{at}/splits/test.txt")
    packed.unpersist()
    return at


_INDOOR = f"select scene_id, frame_id, count(*) as pixels, count(*) filter (label > 0) as planar, round(sum(round_even(z * 1000, 0)) / 1000, 3) as depth, case when frame_id % 3 = 0 then sum(label + 10)::bigint end as semantic, frame_id::double as tx from {PX} p where scene_id % 2 = 0 and frame_id % 5 <> 0 {{0}} group by scene_id, frame_id"


def _summed(scan):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda z, x: z + x)
    return scan.select("scene_id", "frame_id", (F.col("h") * F.col("w")).cast("bigint").alias("pixels"), F.coalesce(F.size(F.filter("label", lambda x: x > 0)), F.lit(0)).cast("bigint").alias("planar"), F.round(total("depth"), 3).alias("depth"), total(F.transform("semantic", lambda x: x.cast("double"))).cast("bigint").alias("semantic"), F.get("c2w", F.lit(3)).alias("tx"))


@query("s04_indoor_frames", _INDOOR.format("and frame_id % 4 <> 0"))
def s04(spark, sf):
    return _summed(datasets.indoor(spark, _indoor_root(spark, sf), "test"))


@query("s04_frames_without_planes", _INDOOR.format("").replace("count(*) filter (label > 0) as planar", "case when frame_id % 4 = 0 then -1 else count(*) filter (label > 0) end as planar"))
def s04b(spark, sf):
    scan = _summed(datasets.indoor(spark, _indoor_root(spark, sf), "test", need_planes=False))
    return scan.withColumn("planar", F.when(F.col("frame_id") % 4 == 0, -1).otherwise(F.col("planar")).cast("bigint"))


_A, _B = "((u + 0.5) * 2.0 / 32 - 1)", "(1 - (v + 0.5) * 2.0 / 24)"
_RAY = f"sqrt(({_A} * 0.6 + 0.01) * ({_A} * 0.6 + 0.01) + ({_B} * 0.45 - 0.02) * ({_B} * 0.45 - 0.02) + 1)"


@query("s05_camera_scan", f"select scene_id, 'cam_0' || (frame_id % 2)::varchar as cam, frame_id, v, u, label, round(case when frame_id % 3 = 0 then z else z / {_RAY} end, 6) as z from {PX} p")
def s05(spark, sf):
    """Renders by camera; every third frame has ray-cast depth."""
    at = shared_path(spark, "cameras")
    cam = F.concat(F.lit("cam_0"), (F.col("frame_id") % 2).cast("string"))
    packed = frames.packed(view(spark, sf, "px_grid"), ["label", "z"]).withColumn("cam", cam)
    packed.withColumnRenamed("z", "distance").write.partitionBy("scene_id", "cam").parquet(f"{at}/renders")
    packed.where("frame_id % 3 = 0").withColumnRenamed("z", "zdepth").drop("label").write.partitionBy("scene_id", "cam").parquet(f"{at}/ray_cast")
    return rounded(datasets.cameras(spark, at, MATRIX, 32, 24))


def _outdoor_root(spark, sf):
    at, px = shared_path(spark, "outdoor"), view(spark, sf, "px_grid")
    rows = frames.packed(px, ["z", "label"])
    planes = px.where("label > 0").groupBy("scene_id", "frame_id", "label").agg(F.count("*").alias("pixels"))
    scenes = px.select("scene_id").distinct().select("scene_id", F.lit(40.0).alias("fx"), F.lit(40.0).alias("fy"), F.lit(15.5).alias("cx"), (F.col("scene_id") + 0.5).alias("cy"), F.lit("m").alias("unit"))
    datasets.save_outdoor(rows, planes, scenes, at)
    return at


@query("s09_outdoor_scan", f"with g as (select scene_id, frame_id, count(*) as pixels from {PX} p group by all), f as (select *, row_number() over (partition by scene_id order by frame_id) - 1 as pos, count(*) over (partition by scene_id) as n from g) select scene_id, frame_id, pixels, 40.0::double as fx, scene_id + 0.5::double as cy, 1.0::double as c2w_first, 0.0::double as c2w_second from f where n <= 3 or pos in (0, (n - 1) // 2, n - 1)")
def s09(spark, sf):
    scan = datasets.outdoor(spark, _outdoor_root(spark, sf), 3)
    return scan.select("scene_id", "frame_id", F.size("z").cast("bigint").alias("pixels"), "fx", "cy", F.get("c2w", F.lit(0)).alias("c2w_first"), F.get("c2w", F.lit(1)).alias("c2w_second"))


@query("s13_outdoor_tables", f"select scene_id, frame_id, label, count(*) as pixels from {PX} p where label > 0 group by all")
def s13(spark, sf):
    """The sink's planes, read again and held against its frames."""
    at = _outdoor_root(spark, sf)
    stored = spark.read.schema("scene_id long, frame_id long, label int, pixels long").json(f"{at}/planes")
    px = frames.exploded(frames.read(spark, f"{at}/frames").withColumn("scene_id", F.col("scene_id").cast("long")), ["label"])
    counted = px.where("label > 0").groupBy("scene_id", "frame_id", "label").agg(F.count("*").alias("counted"))
    return stored.join(counted, ["scene_id", "frame_id", "label"]).where("pixels = counted").drop("counted")


@query("s10_variant_scan", f"select scene_id, frame_id, case frame_id % 3 when 0 then 'clone' else 'fog' end as variant, case when frame_id % 2 = 0 then frame_id::double else 0.0 end as tx from (select distinct scene_id, frame_id from {PX} p) q where frame_id % 3 < 2")
def s10(spark, sf):
    """Two of three variants; frames of odd numbers have no pose."""
    at = shared_path(spark, "variants")
    kind = F.when(F.col("frame_id") % 3 == 0, "clone").when(F.col("frame_id") % 3 == 1, "fog").otherwise("rain")
    rows = frames.packed(view(spark, sf, "px_grid"), ["z"]).withColumns({"variant": kind, "c2w": F.when(F.col("frame_id") % 2 == 0, _pose())})
    rows.write.partitionBy("scene_id", "variant").parquet(at)
    return datasets.variants(spark, at, ["clone", "fog"]).select("scene_id", "frame_id", "variant", F.get("c2w", F.lit(3)).alias("tx"))


def _mesh_root(spark, sf):
    """Scenes of even number count their vertices from 1."""
    at, f = shared_path(spark, "mesh"), view(spark, sf, "mesh_faces")
    one = F.when(F.col("scene_id") % 2 == 0, 1).otherwise(0)
    f.select("scene_id", "fid", *[(F.col(f"v{k}") + one).alias(c) for k, c in enumerate("abc")]).write.parquet(f"{at}/faces")
    f.where("plane_id > 0").select("scene_id", "fid", F.col("plane_id").alias("semantic")).write.parquet(f"{at}/semantics")
    spark.createDataFrame([(1, "wall"), (3, "floor")], "semantic int, name string").write.parquet(f"{at}/names")
    return at


@query("s25_mesh_tables", f"select scene_id, fid, v0, v1, v2, case when plane_id = 1 then 'wall' else 'unannotated' end as name from {FACES} f")
def s25(spark, sf):
    return datasets.mesh_tables(spark, _mesh_root(spark, sf))[0]


@query("s25_mesh_legend", f"select case when plane_id = 1 then 'wall' else 'unannotated' end as name, count(*) as face_count from {FACES} f group by all")
def s25b(spark, sf):
    return datasets.mesh_tables(spark, _mesh_root(spark, sf))[1]


@query("s16_repeated_save", f"select distinct scene_id, frame_id from {PX} p")
def s16(spark, sf):
    """A save that broke off and is repeated adds what is missing and nothing twice."""
    at, packed = shared_path(spark, "again"), frames.packed(view(spark, sf, "px_grid"), ["label"])
    for part in ("frame_id % 2 = 0", "frame_id % 3 = 0", "true"):
        frames.save(packed.where(part), at, "label")
    return frames.read(spark, at).select(F.col("scene_id").cast("bigint").alias("scene_id"), "frame_id")
