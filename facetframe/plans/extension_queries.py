"""Queries through the extension points: SQL functions, gate modes, grouped and table-shaped kernels, named sources."""

from __future__ import annotations

from math import cos, radians

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import sql as sql_functions
from ..operators import joins, mesh, sampling
from ..params import Evaluation, Extraction, Outdoor, Segmentation, cast
from ..session import shared_path
from ..sources import arrays, frames
from ._common import registrar, rounded
from .fixtures import sql, view
from .frame_queries import CAMERA, X, Y
from .mesh_queries import _SH, _shapes

QUERIES, query = registrar()


@query("d02_sql_functions", f"select scene_id, frame_id, v, u, round({X}, 7) + 0.0 as x, round({Y}, 7) + 0.0 as y, round(degrees(acos(greatest(-1.0, least(1.0, nz)))), 7) as tilt, case when label - 1 < 0 then 0 else label end::bigint as shifted from {sql('px_grid')} p where z > 0")
def d02(spark, sf):
    sql_functions.register(spark, CAMERA)
    return rounded(spark.sql("select scene_id, frame_id, v, u, camera_x(u, z) as x, camera_y(v, z) as y, normal_angle(nx, ny, nz, 0, 0, 1) as tilt, label_shift(label - 1) as shifted from {px} where valid_depth(z)", px=view(spark, sf, "px_grid")), digits=7)


_GATES = {"none": "true", "centroid": "abs(cz - 0.1) <= 0.15", "kof3": "(abs(z0 - 0.1) <= 0.15)::int + (abs(z1 - 0.1) <= 0.15)::int + (abs(z2 - 0.1) <= 0.15)::int >= 3"}


@query("d03_gate_modes", f"with {_SH} " + " union all ".join(f"select '{g}' as gate, scene_id, count(*) as faces from sh where nz >= {cos(radians(60.0))!r} and {c} group by scene_id" for g, c in _GATES.items()))
def d03(spark, sf):
    shapes = _shapes(spark, sf)
    plane = shapes.select("scene_id", "label_int").distinct().withColumns({"plane_id": F.lit(1), "a": F.lit(0.0), "b": F.lit(0.0), "c": F.lit(1.0), "d": F.lit(-0.1)})
    each = [mesh.swept(shapes, plane, 60.0, 0.15, gate=g).withColumn("gate", F.lit(g)) for g in _GATES]
    return each[0].union(each[1]).union(each[2]).groupBy("gate", "scene_id").agg(F.count("*").alias("faces"))


@query("d12_has_scene", "select n_nationkey, n_nationkey in (select c_nationkey from customer where c_acctbal > 9000) as found from nation")
def d12(spark, sf):
    scenes = view(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return joins.matched(view(spark, sf, "nation").select("n_nationkey"), scenes, ["n_nationkey"])


@query("f20_image_plane", f"select scene_id, frame_id, v, u, round({X} / z * 40.0 + 15.5, 6) + 0.0 as pu, round({Y} / z * 40.0 + 11.5, 6) + 0.0 as pv from {sql('px_grid')} p")
def f20(spark, sf):
    x, y, z = G.backproject(CAMERA)
    px = view(spark, sf, "px_grid").select("scene_id", "frame_id", "v", "u", x.alias("x"), y.alias("y"), z.alias("z"))
    return rounded(px.select("scene_id", "frame_id", "v", "u", (F.col("x") / F.col("z") * CAMERA.fx + CAMERA.cx).alias("pu"), (F.col("y") / F.col("z") * CAMERA.fy + CAMERA.cy).alias("pv")))


_STRIP = "regexp_replace({0}, '^0+(.)', '\\1')"


@query("s03_padded_keys", f"with k as (select * from {sql('keys_fx')} x) select a.gt_key, coalesce(b.pred_key, c.pred_key) as match from k a left join k b on a.gt_key = b.pred_key left join k c on {_STRIP.format('a.gt_key')} = {_STRIP.format('c.pred_key')} where coalesce(b.pred_key, c.pred_key) is not null")
def s03(spark, sf):
    k = view(spark, sf, "keys_fx")
    return joins.prioritised(k.select("gt_key"), k.select("pred_key"), ordinal=None).where("rule < 2").select("gt_key", "match")


@query("s08_archive_paths", f"select distinct 'chess' as scene, 'seq-' || cast(scene_id as varchar) as seq, frame_id from {sql('px_grid')} p")
def s08(spark, sf):
    """Archives at <scene>/seq-<n>/frame-<id>_d2.npz; one empty file is skipped."""
    seg = arrays.encode(np.ones((2, 2)), np.zeros((2, 2)), np.eye(3))
    path = F.concat(F.lit("/data/chess/seq-"), F.col("scene_id").cast("string"), F.lit("/frame-"), F.col("frame_id").cast("string"), F.lit("_d2.npz"))
    found = view(spark, sf, "px_grid").select("scene_id", "frame_id").distinct().select(path.alias("path"), F.lit(bytearray(seg)).alias("content"))
    found = found.union(spark.createDataFrame([("/data/chess/seq-0/frame-99999_d2.npz", bytearray(b""))], "path string, content binary"))
    part = F.split("path", "/")
    return arrays.decoded(found).select(F.element_at(part, -3).alias("scene"), F.element_at(part, -2).alias("seq"), F.regexp_extract("path", r"frame-([0-9]+)_", 1).cast("long").alias("frame_id"))


@query("s09_uniform_frames", f"with f as (select scene_id, frame_id, row_number() over (partition by scene_id order by frame_id) - 1 as pos, count(*) over (partition by scene_id) as n from {sql('metrics_fx')} x) select scene_id, frame_id, pos::int as pos from f where n <= 4 or pos in (0, cast(floor((n - 1) / 3.0) as bigint), cast(floor(2 * (n - 1) / 3.0) as bigint), n - 1)")
def s09(spark, sf):
    return sampling.linspace(view(spark, sf, "metrics_fx").select("scene_id", "frame_id"), "frame_id", 4, ["scene_id"])


@query("s15_camera_sinks", f"select scene_id, concat('cam_', lpad(cast(frame_id % 2 as varchar), 2, '0')) as cam, frame_id, count(*) as pixels from {sql('px_grid')} p group by all")
def s15(spark, sf):
    at = shared_path(spark, "cameras")
    packed = frames.packed(view(spark, sf, "px_grid"), ["z"])
    packed.withColumn("cam", F.concat(F.lit("cam_"), F.lpad((F.col("frame_id") % 2).cast("string"), 2, "0"))).write.partitionBy("scene_id", "cam").parquet(at)
    return spark.read.parquet(at).select(F.col("scene_id").cast("bigint").alias("scene_id"), "cam", "frame_id", F.size("z").cast("bigint").alias("pixels"))


@query("s23_scene_scan", f"select f.scene_id, f.fid, n_name as scene, r_name as split from {sql('mesh_faces')} f join nation on n_nationkey = f.scene_id join region on r_regionkey = n_regionkey where f.label_int = 1")
def s23(spark, sf):
    scenes = view(spark, sf, "nation").select(F.col("n_nationkey").alias("scene_id"), F.col("n_name").alias("scene"), "n_regionkey")
    splits = view(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("split"))
    return view(spark, sf, "mesh_faces").where("label_int = 1").join(scenes, "scene_id").join(splits, "n_regionkey").select("scene_id", "fid", "scene", "split")


@query("s26_legend_file", "with c as (select p_type as name, count(*) as face_count from part group by 1) select (row_number() over (order by name) - 1)::int as semantic_id, name, face_count from c")
def s26(spark, sf):
    at = shared_path(spark, "legend")
    mesh.legend(view(spark, sf, "part").withColumnRenamed("p_type", "name"), "name").select("semantic_id", "name", "face_count").write.option("header", True).csv(at)
    return spark.read.option("header", True).schema("semantic_id int, name string, face_count long").csv(at)


@query("s34_prediction_sink", f"select scene_id, frame_id, label, count(*) as n from {sql('px_grid')} p group by all")
def s34(spark, sf):
    at = shared_path(spark, "single")
    view(spark, sf, "px_grid").select("scene_id", "frame_id", "v", "u", "label").repartition("scene_id").sortWithinPartitions("scene_id", "frame_id").write.parquet(at)
    return spark.read.parquet(at).groupBy("scene_id", "frame_id", "label").agg(F.count("*").alias("n"))


@query("s36_typed_parameters", "select * from (values ('Segmentation', 'degrees', 7.5::double), ('Evaluation', 'gate', 0.5::double), ('Extraction', 'least_faces', 12.0::double), ('Outdoor', 'cosine', 0.9::double)) t(kind, name, number)")
def s36(spark, sf):
    given = [(Segmentation, "degrees", "7.5"), (Evaluation, "gate", "0.5"), (Extraction, "least_faces", "12"), (Outdoor, "cosine", "0.9")]
    rows = [(kind.__name__, name, float(getattr(cast(kind, {name: text}), name))) for kind, name, text in given]
    return spark.createDataFrame(rows, "kind string, name string, number double")
