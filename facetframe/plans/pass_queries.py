"""Queries over the label pass, file sinks with a commit, guarded shards and observed stages."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import extraction, mesh, stencil, timing
from ..params import Extraction, LabelPass, Quality, Tiers
from ..session import shared_path
from ..sources import meshes, shards, sinks
from ._common import registrar, rounded
from .fixtures import sql, view
from .frame_queries import PX, _frames
from .mesh_queries import _SH, FACES, VERTS, _faces, _verts

QUERIES, query = registrar()

#: Gates for meshes whose cells are a unit wide.
COARSE = LabelPass(
    growth=Extraction(grow_degrees=12.0, grow_distance=0.2, least_faces=4, least_area=0.5, sweep_degrees=15.0, sweep_distance=0.25, sweep_share=0.6, merge_degrees=25.0, merge_distance=0.6),
    quality=Quality(p95=0.4, inlier_frac=0.4, inlier_distance=0.25, thickness=1.0, degrees=25.0, width=0.5, fill=0.1),
    saturation=Quality(p95=0.4, inlier_frac=0.4, inlier_distance=0.3, thickness=1.2, degrees=30.0, width=0.5, fill=0.1),
    saturation_degrees=20.0, saturation_distance=0.3, saturation_rounds=1, offset_gap=0.3,
)


def _low(spark, sf):
    """The mesh below the origin, where planes with d >= 0 face as their faces do; and its adjacency."""
    faces = _faces(spark, sf)
    return mesh.shapes(faces, _verts(spark, sf).withColumn("z", F.col("z") - 5.0)), mesh.adjacency(faces)


def _patches(shapes):
    return shapes.where("plane_id > 0").select("scene_id", "label_int", F.col("plane_id").alias("patch"), "fid")


@query("g05_conditional_merges")
def g05(spark, sf):
    shapes, near = _low(spark, sf)
    members = _patches(shapes)
    planes = extraction.judged(members, shapes, extraction.PATCH, COARSE.quality).select(*extraction.PATCH, "a", "b", "c", "d")
    g = COARSE.growth
    return extraction.merged(members, planes, shapes, near, g.merge_degrees, g.merge_distance, g.sweep_degrees, g.sweep_distance, g.sweep_share, COARSE.quality)[0]


@query("g06_saturation_rounds")
def g06(spark, sf):
    shapes, near = _low(spark, sf)
    members = _patches(shapes)
    planes = extraction.judged(members, shapes, extraction.PATCH, COARSE.quality).select(*extraction.PATCH, "a", "b", "c", "d")
    return extraction.saturated(members, planes, shapes, near, COARSE)[0]


@query("g07_label_pass")
def g07(spark, sf):
    return extraction.extract(*_low(spark, sf), COARSE)


@query("g08_tiered_pass")
def g08(spark, sf):
    """Two tiers of the mesh's faces are big or huge, the others normal."""
    t = Tiers(small=0.1, normal=0.55, big=0.7, distance=0.1, degrees=12.0, iterations=60, quality=COARSE.quality, merge_degrees=15.0, merge_distance=0.3)
    return extraction.tiered(*_low(spark, sf), COARSE, t)


@query("g09_recovery_pass")
def g09(spark, sf):
    """What no plane has yet, with wider gates, one neighbour and no runs of offsets."""
    shapes, near = _low(spark, sf)
    wide = LabelPass(growth=Extraction(grow_degrees=30.0, grow_distance=0.5, least_faces=2, least_area=0.1, sweep_degrees=30.0, sweep_distance=0.5, sweep_share=0.6, merge_degrees=30.0, merge_distance=0.8), quality=COARSE.saturation, saturation=COARSE.saturation, saturation_rounds=0, consensus=1, clusters=False)
    return extraction.extract(shapes.where("label_int = 1 or plane_id = -1"), near, wide)


@query("g10_stealing_growth")
def g10(spark, sf):
    shapes, near = _low(spark, sf)
    return extraction.relaxed(shapes, near, _patches(shapes).where("fid % 5 <> 0"), 0.8, 40.0, 0.3, 1.2)


_PARTS, _LEAST = 8, 3


def _split_sql() -> str:
    """Level after level: stats of the parts, halves at the median of the widest axis, the first ones of a label within its budget."""
    steps = ["l0 as (select scene_id, label_int, fid, 1 as part, round(cx, 9) as cx, round(cy, 9) as cy, round(cz, 9) as cz from sh)"]
    key = "scene_id, label_int, part"
    for k in range(4):
        axis = "case when vx >= vy and vx >= vz then cx when vy >= vz then cy else cz end"
        steps += [
            f"s{k} as (select {key}, count(*) as n, round(var_pop(cx), 9) as vx, round(var_pop(cy), 9) as vy, round(var_pop(cz), 9) as vz from l{k} group by all)",
            f"p{k} as (select l{k}.*, {axis} as t from l{k} join s{k} using ({key}) where n >= {2 * _LEAST})",
            f"m{k} as (select {key}, quantile_cont(t, 0.5) as cut from p{k} group by all)",
            f"h{k} as (select {key}, cut, count(*) as n, count(*) filter (t > cut) as m from p{k} join m{k} using ({key}) group by all)",
            f"f{k} as (select *, row_number() over (partition by scene_id, label_int order by part) as turn from h{k} where m >= {_LEAST} and n - m >= {_LEAST})",
            f"b{k} as (select scene_id, label_int, count(distinct part) as have from l{k} group by all)",
            f"c{k} as (select {key}, cut from f{k} join b{k} using (scene_id, label_int) where turn + have <= {_PARTS})",
            f"l{k + 1} as (select l.scene_id, l.label_int, l.fid, case when c.cut is null then l.part else 2 * l.part + (p.t > c.cut)::int end as part, l.cx, l.cy, l.cz from l{k} l left join c{k} c using ({key}) left join p{k} p on p.scene_id = l.scene_id and p.fid = l.fid)",
        ]
    return f"with {_SH}, {', '.join(steps)} select scene_id, label_int, fid, part::bigint as part from l4"


@query("g11_recursive_split", _split_sql())
def g11(spark, sf):
    shapes = mesh.shapes(_faces(spark, sf), _verts(spark, sf)).withColumns({f"c{a}": F.round(f"c{a}", 9) for a in "xyz"})
    return extraction.split_labels(shapes, 1, _LEAST, _PARTS).select("scene_id", "label_int", "fid", "part")


@query("g12_split_pass")
def g12(spark, sf):
    shapes, near = _low(spark, sf)
    return extraction.by_parts(shapes.withColumn("label_int", F.lit(0)), near, COARSE, 4, 20, 2)


@query("g13_guarded_leftovers")
def g13(spark, sf):
    shapes, near = _low(spark, sf)
    return extraction.leftover_planes(shapes, near, _patches(shapes), 0.1, 25.0, 60, 4, 0.5, 0.1, 8, 987).select("scene_id", "label_int", "component", "plane", "fid")


_PLANES = "select cast(n_nationkey as bigint) as scene_id, cast(k.i as int) as plane_id, 7 as label_int, n_name as label_raw, 0.0e0 as a, 0.6e0 as b, 0.8e0 as c, 1.5e0 + k.i as d, 2.25e0 as area, cast(k.i * 37 as int) as red, 91 as green, 151 as blue from nation cross join (select 1 as i union all select 2) k"


def _mesh_files(spark, sf):
    at = shared_path(spark, "meshes")
    view(spark, sf, "nation").createOrReplaceTempView("nation")
    sinks.save_meshes(view(spark, sf, "mesh_vertices"), view(spark, sf, "mesh_faces"), spark.sql(_PLANES), at)
    return meshes.from_folder(spark, at)


@query("s20_plane_mesh", f"select scene_id, fid, v0, v1, v2, plane_id, label_int from {FACES} f")
def s20(spark, sf):
    return meshes.read_faces(_mesh_files(spark, sf))


@query("s20_mesh_vertices", f"select scene_id, vid, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from {VERTS} v")
def s20v(spark, sf):
    return rounded(meshes.read_vertices(_mesh_files(spark, sf)), digits=4)


@query("s20_plane_header", f"select scene_id, plane_id, label_int, label_raw, a, b, c, d, area, red, green, blue from ({_PLANES}) t")
def s20h(spark, sf):
    return sinks.read_plane_comments(_mesh_files(spark, sf))


_MARKS = sql("px_marks")
_AT = r"/(\d+)/(\d+)[.]png$"


@query("s33_label_png", f"select scene_id, frame_id, v, u, cast(case label when 1 then 70 when 2 then 65535 else 0 end as bigint) as label from {_MARKS} p")
def s33(spark, sf):
    """Labels remapped, those beyond 16 bits clipped, written as PNG files and read again."""
    at = shared_path(spark, "png")
    table = spark.createDataFrame([(1, 70), (2, 70_000)], "old int, new int")
    sinks.save_rasters(sinks.remapped(view(spark, sf, "px_marks"), "label", table, "old", "new"), at)
    got = sinks.read_rasters(spark, at, _AT, ["scene_id", "frame_id"])
    return got.select(*[F.col(c).cast("bigint").alias(c) for c in ("scene_id", "frame_id")], "v", "u", F.col("label").cast("bigint").alias("label"))


@query("s33_unmapped_labels", f"select count(*) as pixels, count(*) filter (label <> 1) as unmapped from {_MARKS} p")
def s33u(spark, sf):
    table, told = spark.createDataFrame([(1, 70)], "old int, new int"), Observation()
    sinks.save_rasters(sinks.remapped(view(spark, sf, "px_marks"), "label", table, "old", "new", told), shared_path(spark, "png"))
    return spark.createDataFrame([(told.get["pixels"], told.get["unmapped"])], "pixels long, unmapped long")


@query("s34_npy_prediction", f"select scene_id, frame_id, v, u, round(z, 6) as z from {_MARKS} p")
def s34(spark, sf):
    at = shared_path(spark, "npy")
    sinks.save_rasters(view(spark, sf, "px_marks"), at, "{scene_id}/{frame_id}.npy", "z", "raster_npy")
    got = sinks.read_rasters(spark, at, r"/(\d+)/(\d+)[.]npy$", ["scene_id", "frame_id"], "z")
    return rounded(got.select(*[F.col(c).cast("bigint").alias(c) for c in ("scene_id", "frame_id")], "v", "u", "z"))


@query("s12_whole_frames", f"select distinct scene_id, frame_id from {_MARKS} p where frame_id % 4 <> 1 and frame_id % 3 <> 2")
def s12(spark, sf):
    """Files of two kinds, some frames lacking one: the listing tells which are whole."""
    at, px = shared_path(spark, "frames"), view(spark, sf, "px_marks")
    sinks.save_rasters(px.where("frame_id % 4 <> 1"), at, "{scene_id}/labels/{frame_id}.png")
    sinks.save_rasters(px.where("frame_id % 3 <> 2"), at, "{scene_id}/depth/{frame_id}.npy", "z", "raster_npy")
    found = sinks.listed(spark, at, r"/(\d+)/(\w+)/(\d+)[.](?:png|npy)$", ["scene_id", "kind", "frame_id"])
    return sinks.whole_frames(found, ["scene_id", "frame_id"], ["labels", "depth"]).select(*[F.col(c).cast("bigint").alias(c) for c in ("scene_id", "frame_id")])


@query("s15_resumed_cameras", f"select scene_id, cam, frame_id, count(*) as pixels, round(sum(z), 4) as z from (select *, concat('cam_', lpad(cast(frame_id % 2 as varchar), 2, '0')) as cam from {_MARKS} p) q group by all")
def s15(spark, sf):
    """A save by camera that broke off after some frames, and goes on with the others."""
    at, template, pattern = shared_path(spark, "cameras"), "{scene_id}/{cam}/{frame_id}.npy", r"/(\d+)/(cam_\d+)/(\d+)[.]npy$"
    px = view(spark, sf, "px_marks").withColumn("cam", F.concat(F.lit("cam_"), F.lpad((F.col("frame_id") % 2).cast("string"), 2, "0")))
    sinks.save_missing(px.where("frame_id % 5 < 2"), at, template, pattern, "z")
    sinks.save_missing(px, at, template, pattern, "z")
    got = sinks.read_rasters(spark, at, pattern, ["scene_id", "cam", "frame_id"], "z")
    return got.groupBy(F.col("scene_id").cast("bigint").alias("scene_id"), "cam", F.col("frame_id").cast("bigint").alias("frame_id")).agg(F.count("*").alias("pixels"), F.round(F.sum("z"), 4).alias("z"))


@query("u02_guarded_shards", f"with m as (select *, 0 as shard from {sql('metrics_fx')} a union all select scene_id, frame_id, n, m1 + 1, m2, 1 from {sql('metrics_fx')} b where n > 10) select scene_id, frame_id, n, round(arg_max(m1, shard), 4) as m1 from m group by scene_id, frame_id, n")
def u02(spark, sf):
    """Two shards of a run beside one that another run has left, read by the manifest."""
    at, f = shared_path(spark, "shards"), view(spark, sf, "metrics_fx")
    shards.save_shard(f.where("n > 20"), at, "older", 1, 2)
    shards.save_shard(f, at, "run", 0, 2)
    shards.save_shard(f.where("n > 10").withColumn("m1", F.col("m1") + 1), at, "run", 1, 2)
    return rounded(shards.merged_run(spark, at, "run", ["scene_id", "frame_id"]).select("scene_id", "frame_id", "n", "m1"), digits=4)


@query("a22_observed_stages", "select 'orders' as stage, 2 as calls, (select count(*) from orders) + (select count(*) from orders where o_orderkey % 2 = 0) as rows_seen union all select 'join', 1, (select count(*) from orders join customer on o_custkey = c_custkey)")
def a22(spark, sf):
    """Calls and rows that running queries were seen to pass; their seconds are in the breakdown."""
    stages, orders = timing.Stages(spark, uuid.uuid4().hex), view(spark, sf, "orders")
    for part in (orders, orders.where("o_orderkey % 2 = 0")):
        with stages.stage("orders") as watched:
            watched(part).write.format("noop").mode("overwrite").save()
    with stages.stage("join") as watched:
        watched(orders.join(view(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))).write.format("noop").mode("overwrite").save()
    at = shared_path(spark, "runtimes")
    stages.append(at)
    stages.append(at)
    return timing.read(spark, at).groupBy("stage").agg(F.count("*").alias("calls"), F.sum("rows").alias("rows_seen"))


def _shares(new: int, old: int) -> str:
    return f"(select i, s as src, (least((i + 1) * {old} / {new}.0, s + 1) - greatest(i * {old} / {new}.0, s)) * {new} / {old}.0 as w from (select unnest(range({new}))::int as i) a, (select unnest(range({old}))::int as s) b where least((i + 1) * {old} / {new}.0, s + 1) - greatest(i * {old} / {new}.0, s) > 1e-9)"


@query("f16_area_resize", f"select a.scene_id, a.frame_id, v.i as v, u.i as u, round(sum(a.z * v.w * u.w), 6) as z from {PX} a join {_shares(10, 24)} v on a.v = v.src join {_shares(20, 32)} u on a.u = u.src group by all")
def f16(spark, sf):
    return rounded(stencil.area_resize(_frames(spark, sf), 24, 32, 10, 20, "z"))
