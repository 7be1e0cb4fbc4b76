"""Queries over plane extraction, merging and the remaining sources."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, growth, kernels, mesh, planes, raycast, sampling
from ..params import Evaluation, Extraction, scaled
from ..session import shared_path
from . import benchmark
from ._common import registrar, rounded
from .fixtures import sql, view
from .frame_queries import _W2, CAMERA, X, Y
from .label_queries import _BP, _CL, _SC, PX
from .mesh_queries import _RAYS, _SH, _camera_faces, _faces, _shapes
from .plane_queries import _cloud, _fit
from .plane_queries import KEYS as SEGMENT

QUERIES, query = registrar()

FRAME = ["scene_id", "frame_id"]
GRID = f"(select scene_id, frame_id, label, {X} as x, {Y} as y, z from {sql('px_grid')} p where label > 0)"
SMALL = Extraction(grow_degrees=12.0, grow_distance=0.2, least_faces=4, least_area=0.5, sweep_degrees=15.0, sweep_distance=0.25, sweep_share=0.6, merge_distance=0.3, rounds=1)


def _patches(spark, sf):
    """The mesh's own plane ids as patches."""
    return _shapes(spark, sf).where("plane_id > 0").withColumn("patch", F.col("plane_id"))


_PT = "pt as (select scene_id, label_int, plane_id as patch, x0 as x, y0 as y, z0 as z from sh where plane_id > 0 union all select scene_id, label_int, plane_id, x1, y1, z1 from sh where plane_id > 0 union all select scene_id, label_int, plane_id, x2, y2, z2 from sh where plane_id > 0)"
_ABC = "abs(f.a * p.x + f.b * p.y + f.c * p.z + f.d)"


@query("x05_patch_fits", f"with {_SH}, {_PT}, {_fit('pt', 'scene_id, label_int, patch')}, n as (select scene_id, label_int, plane_id as patch, count(*) as faces, sum(area) as area from sh where plane_id > 0 group by all) select scene_id, label_int, patch, faces, round(area, 6) as area, round(abs(c), 5) as c, round(d, 5) + 0.0 as d, round(rms, 5) as rms from fit join n using (scene_id, label_int, patch)")
def x05(spark, sf):
    fits = growth.patch_planes(_patches(spark, sf))
    return rounded(fits.select("scene_id", "label_int", "patch", "faces", F.round("area", 6).alias("area"), F.abs("c").alias("c"), "d", "rms"), digits=5).withColumn("area", F.col("area"))


@query("g05_merge_pairs", f"with {_SH}, {_PT}, {_fit('pt', 'scene_id, label_int, patch')}, pr as (select a.scene_id, a.label_int, a.patch as p, b.patch as q from fit a join fit b on a.scene_id = b.scene_id and a.label_int = b.label_int and a.patch < b.patch and abs(a.a*b.a + a.b*b.b + a.c*b.c) >= {cos(radians(25.0))!r}), ways as (select *, p as own, q as other from pr union all select *, q, p from pr), fa as (select w.scene_id, w.label_int, w.p, w.q, w.own, quantile_cont({_ABC}, 0.85) as far from ways w join pt p on p.scene_id = w.scene_id and p.label_int = w.label_int and p.patch = w.own join fit f on f.scene_id = w.scene_id and f.label_int = w.label_int and f.patch = w.other group by all) select scene_id, label_int, p, q, round(max(far), 5) as far from fa group by all having max(far) <= 0.5")
def g05(spark, sf):
    patches = _patches(spark, sf)
    return rounded(growth.merge_pairs(patches, growth.patch_planes(patches), 25.0, 0.5), digits=5)


@query("g05_merged_patches")
def g05b(spark, sf):
    return growth.merged(_patches(spark, sf), 25.0, 0.5).groupBy("scene_id", "label_int", "patch").agg(F.count("*").alias("faces"))


@query("g06_saturation")
def g06(spark, sf):
    patches = _patches(spark, sf)
    return growth.swept_patches(_shapes(spark, sf), growth.patch_planes(patches), mesh.adjacency(_faces(spark, sf)), 20.0, 0.3, 0.66, 1)


@query("g07_label_extraction")
def g07(spark, sf):
    return growth.extract(_shapes(spark, sf), mesh.adjacency(_faces(spark, sf)), SMALL)


@query("g09_recovery")
def g09(spark, sf):
    """What extraction left over, once more with wider gates."""
    shapes, near = _shapes(spark, sf), mesh.adjacency(_faces(spark, sf))
    first = growth.extract(shapes, near, SMALL)
    left = shapes.join(first.select("scene_id", "fid"), ["scene_id", "fid"], "left_anti")
    wide = Extraction(grow_degrees=30.0, grow_distance=0.5, least_faces=1, least_area=0.0, sweep_degrees=30.0, sweep_distance=0.5, sweep_share=0.6, merge_distance=0.5, rounds=0)
    return first.withColumn("stage", F.lit(1)).union(growth.extract(left, near, wide).withColumn("stage", F.lit(2)))


@query("g10_relaxed_growth")
def g10(spark, sf):
    shapes, patches = _shapes(spark, sf), _patches(spark, sf)
    return growth.attach(shapes, mesh.adjacency(_faces(spark, sf)), patches.select("scene_id", "fid", "patch"), growth.patch_planes(patches), 40.0, 0.8, 1.0)


@query("g11_median_split", f"with {_SH}, ro as (select scene_id, label_int, round(cx, 9) as cx, round(cy, 9) as cy, round(cz, 9) as cz from sh), st as (select scene_id, label_int, var_pop(cx) as vx, var_pop(cy) as vy, var_pop(cz) as vz, quantile_cont(cx, 0.5) as mx, quantile_cont(cy, 0.5) as my, quantile_cont(cz, 0.5) as mz from ro group by all having count(*) > 20), c as (select *, case when vx >= vy and vx >= vz then 'x' when vy >= vz then 'y' else 'z' end as axis from st) select scene_id, label_int, case when c.axis is null then 1 else 2 + (case c.axis when 'x' then cx > mx when 'y' then cy > my else cz > mz end)::int end as part, count(*) as faces from ro left join c using (scene_id, label_int) group by all")
def g11(spark, sf):
    shapes = _shapes(spark, sf).withColumns({**{f"c{a}": F.round(f"c{a}", 9) for a in "xyz"}, "part": F.lit(1)})
    return growth.split_by_median(shapes, ["scene_id", "label_int"], most=20).groupBy("scene_id", "label_int", "part").agg(F.count("*").alias("faces"))


@query("g13_leftover_planes")
def g13(spark, sf):
    """Planes in the unlabelled components of each scene, by sequential RANSAC over their centroids."""
    free = _shapes(spark, sf).where("plane_id = -1")
    near = mesh.adjacency(_faces(spark, sf))
    ids = lambda c: free.select("scene_id", F.col("fid").alias(c))
    inside = near.join(ids("f1"), ["scene_id", "f1"], "left_semi").join(ids("f2"), ["scene_id", "f2"], "left_semi")
    parts = graph.components(free, inside, ["scene_id"], "fid", "f1", "f2")
    points = free.join(parts, ["scene_id", "fid"]).select("scene_id", "component", F.col("fid").alias("idx"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "nx", "ny", "nz")
    return kernels.sequential_planes(points, ["scene_id", "component"], 0.1, 0.9, 60, 4, 8, seed=987)


@query("x07_face_ransac")
def x07(spark, sf):
    return kernels.face_planes(_shapes(spark, sf), ["scene_id", "label_int"], 0.05, 25.0, 100, seed=123)


def _merge_segments(spark, sf):
    return growth.merge_segments(_cloud(spark, sf), FRAME, 60.0, 1.0, raster=view(spark, sf, "px_grid"), gap=2, near=0.2)


@query("g14_segment_merge")
def g14(spark, sf):
    return _merge_segments(spark, sf)[0]


@query("g14_merge_log")
def g14b(spark, sf):
    return _merge_segments(spark, sf)[1]


def _pairs_sql(signed: bool) -> str:
    dots = "(a.a*b.a + a.b*b.b + a.c*b.c)"
    gap = f"case when {dots} < 0 then abs(a.d + b.d) else abs(a.d - b.d) end" if signed else "abs(a.d - b.d)"
    return f"with {_fit(GRID, 'scene_id, frame_id, label')} select a.scene_id, a.frame_id, a.label as a, b.label as b, round({gap}, 4) as gap from fit a join fit b on a.scene_id = b.scene_id and a.frame_id = b.frame_id and a.label < b.label and abs({dots}) >= {cos(radians(70.0))!r} and {gap} <= 5.0"


@query("j17_segment_pairs", _pairs_sql(True))
def j17(spark, sf):
    return rounded(growth.segment_pairs(planes.fit(_cloud(spark, sf), SEGMENT), FRAME, 70.0, 5.0), digits=4)


@query("g16_unsigned_pairs", _pairs_sql(False))
def g16(spark, sf):
    return rounded(growth.segment_pairs(planes.fit(_cloud(spark, sf), SEGMENT), FRAME, 70.0, 5.0, signed=False), digits=4)


@query("j16_median_distance", f"with {_fit(GRID, 'scene_id, frame_id, label')}, pr as (select a.scene_id, a.frame_id, a.label as a, b.label as b from fit a join fit b on a.scene_id = b.scene_id and a.frame_id = b.frame_id and a.label < b.label and abs(a.a*b.a + a.b*b.b + a.c*b.c) >= 0.3), ways as (select *, a as own, b as other from pr union all select *, b, a from pr), fa as (select w.scene_id, w.frame_id, w.a, w.b, w.own, quantile_cont({_ABC}, 0.5) as far from ways w join {GRID} p on p.scene_id = w.scene_id and p.frame_id = w.frame_id and p.label = w.own join fit f on f.scene_id = w.scene_id and f.frame_id = w.frame_id and f.label = w.other group by all) select scene_id, frame_id, a, b, round(max(far), 4) as far from fa group by all having max(far) < 2.0")
def j16(spark, sf):
    cloud = _cloud(spark, sf)
    return rounded(growth.merge_outdoor(cloud, planes.fit(cloud, SEGMENT), FRAME, 0.3, 2.0, 0.0), digits=4)


@query("j18_near_in_space", f"select distinct a.scene_id, a.frame_id, a.label as a, b.label as b from {GRID} a join {GRID} b on a.scene_id = b.scene_id and a.frame_id = b.frame_id and a.label < b.label where sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.75")
def j18(spark, sf):
    return growth.near_in_space(_cloud(spark, sf), FRAME, 0.75)


@query("j22_euclidean_depth", f"""with {_SH}, t as (select scene_id, fid, x0-2.5 as x0, y0-2.5 as y0, z0+6 as z0, x1-2.5 as x1, y1-2.5 as y1, z1+6 as z1, x2-2.5 as x2, y2-2.5 as y2, z2+6 as z2 from sh),
    m as (select r.scene_id, r.v, r.u, (r.u - 15.5) / 40.0 as dx, (r.v - 11.5) / 40.0 as dy, x0, y0, z0, x1-x0 as ex, y1-y0 as ey, z1-z0 as ez, x2-x0 as gx, y2-y0 as gy, z2-z0 as gz from {_RAYS} r join t using (scene_id)),
    h as (select *, dy*gz - gy as hx, gx - dx*gz as hy, dx*gy - dy*gx as hz from m), d as (select *, ex*hx + ey*hy + ez*hz as det, -y0*ez + z0*ey as qx, -z0*ex + x0*ez as qy, -x0*ey + y0*ex as qz from h),
    b as (select *, (-x0*hx - y0*hy - z0*hz) / det as bu, (dx*qx + dy*qy + qz) / det as bv, (gx*qx + gy*qy + gz*qz) / det as tt from d where abs(det) > 1e-12)
    select scene_id, v, u, round(min(tt) * sqrt(max(dx)*max(dx) + max(dy)*max(dy) + 1) * 0.0254, 6) as metres from b where bu >= -1e-9 and bv >= -1e-9 and bu + bv <= 1 + 1e-9 and tt > 1e-6 group by all""")
def j22(spark, sf):
    rays = spark.range(24 * 32).select(F.floor(F.col("id") / 32).cast("int").alias("v"), (F.col("id") % 32).cast("int").alias("u"))
    scenes = view(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("scene_id"))
    hits = raycast.nearest_hits(scenes.crossJoin(F.broadcast(rays)), _camera_faces(_shapes(spark, sf)), CAMERA)
    return rounded(hits.select("scene_id", "v", "u", (F.col("z") * G.ray_length(CAMERA) * 0.0254).alias("metres")))


@query("t02_top_before_pairs", f"with s as (select scene_id, frame_id, label, count(*) as n from {GRID} p group by all), r as (select *, row_number() over (partition by scene_id, frame_id order by n desc, label) as rn from s) select scene_id, frame_id, label, n from r where rn <= 1")
def t02(spark, sf):
    return growth.top_labels(_cloud(spark, sf), FRAME, 1)


@query("f12_unit_scaling", "select cast(n_nationkey as bigint) as scene_id, round(0.015 / (0.01 * (n_nationkey + 1)), 6) as distance, round(0.1 / (0.01 * (n_nationkey + 1)) / (0.01 * (n_nationkey + 1)), 6) as area from nation")
def f12(spark, sf):
    sizes = [(k, scaled(Extraction(), "metric", 0.01 * (k + 1))) for k in range(25)]
    table = spark.createDataFrame([(k, p.grow_distance, p.least_area) for k, p in sizes], "scene_id long, distance double, area double")
    scenes = view(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("scene_id"))
    return rounded(scenes.join(F.broadcast(table), "scene_id"))


@query("f17_normal_colours", f"select scene_id, frame_id, v, u, cast(floor((nx + 1) / 2 * 255) as int) as r, cast(floor((nz + 1) / 2 * 255) as int) as b from {sql('px_grid')} p")
def f17(spark, sf):
    channel = lambda c: F.floor((F.col(c) + 1) / 2 * 255).cast("int")
    return view(spark, sf, "px_grid").select("scene_id", "frame_id", "v", "u", channel("nx").alias("r"), channel("nz").alias("b"))


@query("x08_outdoor_planes")
def x08(spark, sf):
    pixels = _cloud(spark, sf).withColumnRenamed("label", "class_id")
    return growth.outdoor_planes(pixels, FRAME, 0.02, 0.5, 60, 50, 4)


@query("x09_unit_offset_planes", f"with s as (select scene_id, frame_id, label, sum(x*x) as xx, sum(y*y) as yy, sum(z*z) as zz, sum(x*y) as xy, sum(x*z) as xz, sum(y*z) as yz, sum(x) as sx, sum(y) as sy, sum(z) as sz from {GRID} p group by all), d as (select *, xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz) as det from s) select scene_id, frame_id, label, round((sx*(yy*zz - yz*yz) - xy*(sy*zz - yz*sz) + xz*(sy*yz - yy*sz)) / det, 4) + 0.0 as a, round((xx*(sy*zz - yz*sz) - sx*(xy*zz - yz*xz) + xz*(xy*sz - sy*xz)) / det, 4) + 0.0 as b, round((xx*(yy*sz - sy*yz) - xy*(xy*sz - sy*xz) + sx*(xy*yz - yy*xz)) / det, 4) + 0.0 as c from d where abs(det) > 1e-12")
def x09(spark, sf):
    return rounded(growth.unit_offset_fit(_cloud(spark, sf), SEGMENT), digits=4)


@query("x10_point_map", f"select scene_id, frame_id, v, u, case when label > 0 then round({X}, 7) + 0.0 end as x, case when label > 0 then round({Y}, 7) + 0.0 end as y, case when label > 0 then round(z, 7) end as z from {sql('px_grid')} p")
def x10(spark, sf):
    xyz = G.backproject(CAMERA)
    px = view(spark, sf, "px_grid")
    return rounded(px.select("scene_id", "frame_id", "v", "u", *[F.when(F.col("label") > 0, c).alias(n) for c, n in zip(xyz, "xyz", strict=True)]), digits=7)


@query("x11_plane_cloud", f"with {_fit(GRID, 'scene_id, frame_id, label')} select p.scene_id, p.frame_id, p.label, count(*) as points, round(max({_ABC}), 4) as moved from {GRID} p join fit f using (scene_id, frame_id, label) group by all")
def x11(spark, sf):
    cloud = _cloud(spark, sf)
    fits = planes.fit(cloud, SEGMENT).select(*SEGMENT, "a", "b", "c", "d")
    p, n = [F.col(k) for k in "xyz"], [F.col(k) for k in "abc"]
    flat = cloud.join(fits, SEGMENT)
    moved = G.norm(*[q - o for q, o in zip(G.onto_plane(p, n, F.col("d")), p, strict=True)])
    return rounded(flat.withColumn("m", moved).groupBy(*SEGMENT).agg(F.count("*").alias("points"), F.max("m").alias("moved")), digits=4)


@query("s05_depth_choice", "select o_orderkey, coalesce(case when o_orderstatus = 'F' then o_totalprice end, o_totalprice / 2) as depth from orders")
def s05(spark, sf):
    o = view(spark, sf, "orders")
    ray = o.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("ray"))
    return o.join(ray, "o_orderkey", "left").select("o_orderkey", F.coalesce("ray", F.col("o_totalprice") / 2).alias("depth"))


@query("s06_split_csv", "select c_custkey, case when c_custkey % 5 = 0 then 'val' else 'train' end as split from customer where c_custkey % 5 <> 0")
def s06(spark, sf):
    at = shared_path(spark, "splits")
    view(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "val").otherwise("train").alias("split")).write.option("header", True).csv(at)
    return spark.read.option("header", True).schema("c_custkey long, split string").csv(at).where("split = 'train'")


@query("s10_variant_pruning", "select l_orderkey, l_linenumber, l_returnflag as variant from lineitem where l_returnflag in ('A', 'R')")
def s10(spark, sf):
    at = shared_path(spark, "variants")
    view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("variant")).write.partitionBy("variant").parquet(at)
    return spark.read.parquet(at).where(F.col("variant").isin("A", "R"))


@query("s12_frame_discovery", "select l_orderkey as frame_id from lineitem where l_returnflag in ('A', 'N', 'R') group by 1 having count(distinct l_returnflag) = 3")
def s12(spark, sf):
    kinds = view(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("frame_id")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.count("l_linenumber"))
    return kinds.dropna().select("frame_id")


@query("s13_planes_json", f"select plane_id, round(nx, 6) + 0.0 as nx, round(d, 6) as d, label as class_name from {sql('planes_fx')} p")
def s13(spark, sf):
    at = shared_path(spark, "planes")
    view(spark, sf, "planes_fx").select("plane_id", F.array("nx", "ny", "nz").alias("n"), "d", F.col("label").alias("class_name")).write.json(at)
    got = spark.read.schema("plane_id long, n array<double>, d double, class_name string").json(at)
    return rounded(got.select("plane_id", F.get("n", F.lit(0)).alias("nx"), "d", "class_name"))


@query("s25_one_based_faces", "with f as (select l_orderkey, l_partkey as a from lineitem) select l_orderkey, a - (select case when min(a) = 1 then 1 else 0 end from f) as a from f")
def s25(spark, sf):
    f = view(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"))
    base = f.agg(F.when(F.min("a") == 1, 1).otherwise(0).alias("base"))
    return f.crossJoin(F.broadcast(base)).select("l_orderkey", (F.col("a") - F.col("base")).alias("a"))


@query("s31_runtimes", "select n_regionkey as stage, count(*) as calls from nation group by 1 union all select n_regionkey, count(*) from nation where n_nationkey > 10 group by 1")
def s31(spark, sf):
    from ..sources import texts

    at = shared_path(spark, "runtimes")
    n = view(spark, sf, "nation")
    for rows in (n, n.where("n_nationkey > 10")):
        texts.append_runtimes(rows.groupBy(F.col("n_regionkey").alias("stage")).agg(F.count("*").alias("calls")), at)
    return spark.read.option("header", True).schema("stage int, calls long").csv(at)


@query("s33_label_clip", "select l_orderkey, l_linenumber, cast(least(greatest(l_partkey * 10 - 50, 0), 65535) as bigint) as label from lineitem")
def s33(spark, sf):
    return view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.least(F.greatest(F.col("l_partkey") * 10 - 50, F.lit(0)), F.lit(65535)).cast("bigint").alias("label"))


@query("s30_sorted_predictions", f"select scene_id, frame_id, row_number() over (partition by scene_id order by frame_id)::int as place from (select distinct scene_id, frame_id from {sql('px_seg')} p) t")
def s30(spark, sf):
    frames = view(spark, sf, "px_seg").select("scene_id", "frame_id").distinct()
    return sampling.position(frames, ["frame_id"], ["scene_id"]).select("scene_id", "frame_id", (F.col("pos") + 1).alias("place"))


@query("s37_scaled_planes", f"select plane_id, round(nx / (nx*nx + ny*ny + nz*nz + d*d), 6) + 0.0 as a, round(d / (nx*nx + ny*ny + nz*nz + d*d), 6) as d from {sql('planes_fx')} p")
def s37(spark, sf):
    size = sum((F.col(c) * F.col(c) for c in ("ny", "nz", "d")), F.col("nx") * F.col("nx"))
    return rounded(view(spark, sf, "planes_fx").select("plane_id", (F.col("nx") / size).alias("a"), (F.col("d") / size).alias("d")))


@query("s02_scene_predictions", f"select scene_id, frame_id, v, u, label from {sql('px_grid')} p where scene_id = 5")
def s02(spark, sf):
    from ..sources import frames

    at = shared_path(spark, "predictions")
    frames.save(frames.packed(view(spark, sf, "px_grid"), ["label"]), at, "label")
    one = frames.read(spark, at, [5]).withColumn("scene_id", F.col("scene_id").cast("bigint"))
    return frames.exploded(one, ["label"])


@query("s04_indoor_scan", "select o_orderkey as frame_id, c_custkey as scene_id, c_acctbal as pose, greatest(o_custkey - 50, 0) as label from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' and o_orderkey in (select l_orderkey from lineitem)")
def s04(spark, sf):
    frames_, poses = view(spark, sf, "orders"), view(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    complete = view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = frames_.join(poses, frames_["o_custkey"] == poses["c_custkey"]).join(complete, "o_orderkey", "left_semi")
    return rows.select(F.col("o_orderkey").alias("frame_id"), F.col("c_custkey").alias("scene_id"), F.col("c_acctbal").alias("pose"), F.greatest(F.col("o_custkey") - 50, F.lit(0)).alias("label"))


@query("s11_adapter_step", f"with f as (select distinct scene_id, frame_id from {sql('px_grid')} p), n as (select *, row_number() over (partition by scene_id order by frame_id) - 1 as pos from f) select scene_id, frame_id, 24::int as h, 32::int as w, 768::bigint as pixels from n where pos % 2 = 0")
def s11(spark, sf):
    from ..sources import adapters, frames

    at = shared_path(spark, "adapter")
    px = view(spark, sf, "px_grid").withColumnRenamed("z", "depth")
    frames.save(frames.packed(px, ["depth", "label"]), at)
    got = adapters.read(spark, "table", at, 2)
    return got.select(F.col("scene_id").cast("bigint").alias("scene_id"), "frame_id", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.size("depth").cast("bigint").alias("pixels"))


@query("s16_replaced_table", "select n_nationkey, n_name from nation where n_regionkey = 2")
def s16(spark, sf):
    at = shared_path(spark, "replaced")
    n = view(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for rows in (n, n.where("n_regionkey = 2")):
        rows.drop("n_regionkey").write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


@query("s20_plane_palette", f"select plane_id, label, (plane_id * 37 % 256)::int as r, (plane_id * 91 % 256)::int as g, (plane_id * 151 % 256)::int as b from {sql('planes_fx')} p")
def s20(spark, sf):
    at = shared_path(spark, "palette")
    colour = F.array(*[((F.col("plane_id") * k) % 256).cast("int") for k in (37, 91, 151)])
    view(spark, sf, "planes_fx").select("plane_id", "label", colour.alias("color_rgb")).write.json(at)
    got = spark.read.schema("plane_id long, label string, color_rgb array<int>").json(at)
    return got.select("plane_id", "label", *[F.get("color_rgb", F.lit(k)).alias(c) for k, c in enumerate("rgb")])


@query("g08_tiered_seeds", f"with {_SH} select scene_id, label_int, case when area < 0.55 then 'small' when area < 0.6 then 'normal' when area < 0.7 then 'big' else 'huge' end as tier, count(*) as faces from sh group by all")
def g08(spark, sf):
    shapes = _shapes(spark, sf)
    return shapes.withColumn("tier", mesh.tiers("area", 0.55, 0.6, 0.7)).groupBy("scene_id", "label_int", "tier").agg(F.count("*").alias("faces"))


@query("g12_cross_split_merge")
def g12(spark, sf):
    """Labels split for size and joined again where their parts are one plane."""
    parts = growth.split_by_median(_shapes(spark, sf).withColumn("part", F.lit(1)), ["scene_id", "label_int"], most=20)
    merged = growth.merged(parts.withColumn("patch", F.col("part")), 10.0, 0.1)
    return merged.groupBy("scene_id", "label_int", "patch").agg(F.count("*").alias("faces"))


JUDGED = Evaluation(thresholds=(0.005, 0.02, 0.05), gate=0.5)


def _benchmark_sql() -> str:
    """The whole frame row: label metrics, then planes of the predicted segments and their gated inliers."""
    labels = ", ".join(x.replace(PX, "px2") for x in (_SC, _CL, _BP))
    pixels = f"px2 as (select * from ({_W2} select px.*, px.label as gt, case when c.n >= 8 then case when px.u < 15 then 1 else 2 end else 0 end as pred from px left join c using (scene_id, frame_id, v, u)) q)"
    points = f"pts as (select scene_id, frame_id, pred as label, {X} as x, {Y} as y, z from px2)"
    fit = _fit("(select * from pts where label > 0)", "scene_id, frame_id, label")
    cells = ", ".join(f"count(*) filter ({_ABC} < {t}) as k{i}" for i, t in enumerate(JUDGED.thresholds))
    per = f"per as (select p.scene_id, p.frame_id, p.label, count(*) as k, {cells} from pts p join fit f using (scene_id, frame_id, label) group by all)"
    kept = ", ".join(f"sum(case when k{i} >= {JUDGED.gate} * k then k{i} else 0 end)::double as g{i}" for i in range(len(JUDGED.thresholds)))
    names = benchmark.plane_columns(JUDGED)
    gated = f"gt9 as (select scene_id, frame_id, sum(k) as fitted, {kept} from per group by all), al as (select scene_id, frame_id, count(*) as n9 from pts group by all), pm as (select scene_id, frame_id, " + ", ".join(f"coalesce(g{i} / fitted, 0) as {names[2 * i]}, coalesce(g{i} / n9, 0) as {names[2 * i + 1]}" for i in range(len(JUDGED.thresholds))) + " from al left join gt9 using (scene_id, frame_id))"
    means = ", ".join(f"round(avg({c}), 6) as {c}" for c in benchmark.METRICS + names)
    return f"with {pixels}, {labels}, {points}, {fit}, {per}, {gated} select scene_id, count(*) as num_frames, {means} from sc join cl using (scene_id, frame_id) join bp using (scene_id, frame_id) join pm using (scene_id, frame_id) group by scene_id"


@query("d06_benchmark", _benchmark_sql())
def d06(spark, sf):
    px = view(spark, sf, "px_grid")
    frames = benchmark.evaluated(benchmark.segmented(px), px, CAMERA, JUDGED, benchmark.least_squares_fits)
    return rounded(benchmark.results(frames, JUDGED)[0])


@query("d06_robust_benchmark")
def d06b(spark, sf):
    """With planes by RANSAC at each threshold."""
    px = view(spark, sf, "px_grid")
    return benchmark.results(benchmark.evaluated(benchmark.segmented(px), px, CAMERA, JUDGED), JUDGED)[1]
