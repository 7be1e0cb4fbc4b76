"""Queries over plane fits, plane pairs and inlier metrics."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import kernels, metrics, planes
from ._common import registrar, rounded
from .fixtures import sql, view
from .frame_queries import CAMERA, X, Y

QUERIES, query = registrar()

PL = sql("planes_fx")
PTS = sql("points")
GRID = f"(select scene_id, frame_id, label, {X} as x, {Y} as y, z from {sql('px_grid')} p where label > 0)"
KEYS = ["scene_id", "frame_id", "label"]


def _cloud(spark, sf):
    xyz = G.backproject(CAMERA)
    px = view(spark, sf, "px_grid").where("label > 0")
    return px.select("scene_id", "frame_id", "label", (F.col("v") * 32 + F.col("u")).cast("long").alias("idx"), "nx", "ny", "nz", *[c.alias(n) for c, n in zip(xyz, "xyz", strict=True)])


def _fit(source: str, keys: str) -> str:
    """Closed-form least-squares planes as CTEs ending in ``fit``."""
    return f"""m as (select {keys}, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, covar_pop(x, x) as xx, covar_pop(y, y) as yy, covar_pop(z, z) as zz, covar_pop(x, y) as xy, covar_pop(x, z) as xz, covar_pop(y, z) as yz from {source} s group by {keys} having count(*) >= 3),
    e as (select *, (xx + yy + zz) / 3 as q from m), f as (select *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz)) / 6) as p from e),
    g as (select *, ((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)) / (p*p*p) as det from f),
    h as (select *, q + 2 * p * cos(acos(greatest(-1.0, least(1.0, det / 2))) / 3 + 2.0943951023931953) as low from g),
    c as (select *, [xy*yz - xz*(yy-low), xz*xy - (xx-low)*yz, (xx-low)*(yy-low) - xy*xy] as c0, [xy*(zz-low) - xz*yz, xz*xz - (xx-low)*(zz-low), (xx-low)*yz - xy*xz] as c1, [(yy-low)*(zz-low) - yz*yz, yz*xz - xy*(zz-low), xy*yz - (yy-low)*xz] as c2 from h),
    z as (select *, c0[1]*c0[1]+c0[2]*c0[2]+c0[3]*c0[3] as s0, c1[1]*c1[1]+c1[2]*c1[2]+c1[3]*c1[3] as s1, c2[1]*c2[1]+c2[2]*c2[2]+c2[3]*c2[3] as s2 from c),
    w as (select *, case when s2 >= s1 and s2 >= s0 then c2 when s1 >= s0 then c1 else c0 end as b, greatest(s0, s1, s2) as s from z),
    r as (select *, b[1]/sqrt(s) as a0, b[2]/sqrt(s) as b0, b[3]/sqrt(s) as c9, -(b[1]*mx + b[2]*my + b[3]*mz)/sqrt(s) as d0 from w where s > 1e-30),
    fit as (select {keys}, n as num_points, a0 * sg as a, b0 * sg as b, c9 * sg as c, d0 * sg as d, sqrt(greatest(low, 0)) as rms from (select *, case when d0 < 0 then -1.0 else 1.0 end as sg from r) t)"""


@query("x02_least_squares_planes", f"with {_fit(GRID, 'scene_id, frame_id, label')} select scene_id, frame_id, label, num_points, round(a, 5) + 0.0 as a, round(b, 5) + 0.0 as b, round(c, 5) + 0.0 as c, round(d, 5) + 0.0 as d, round(rms, 5) + 0.0 as rms from fit")
def x02(spark, sf):
    return rounded(planes.fit(_cloud(spark, sf), KEYS).drop("mx", "my", "mz"), digits=5)


@query("x02_label_clouds", f"with {_fit(PTS, 'label')} select label, num_points, round(abs(a), 5) as a, round(abs(b), 5) as b, round(abs(c), 5) as c, round(d, 5) + 0.0 as d, round(rms, 5) as rms from fit")
def x02b(spark, sf):
    fits = planes.fit(view(spark, sf, "points"), ["label"]).drop("mx", "my", "mz")
    return rounded(fits.withColumns({k: F.abs(k) for k in "abc"}), digits=5)


_RES = "abs(f.a * p.x + f.b * p.y + f.c * p.z + f.d)"


@query("p06_support_gate", f"with {_fit(PTS, 'label')} select label, count(*) as points, count(*) filter ({_RES} < 0.07) as refined_inliers, round(count(*) filter ({_RES} < 0.07)::double / count(*), 6) as inlier_ratio_refined from {PTS} p join fit f using (label) group by label having count(*) filter ({_RES} < 0.07) >= 3")
def p06(spark, sf):
    pts = view(spark, sf, "points")
    return rounded(planes.inlier_table(pts, planes.fit(pts, ["label"]), ["label"], 0.07, 3))


@query("p07_ratio_filter", f"with {_fit(PTS, 'label')}, t as (select label, count(*) as points, count(*) filter ({_RES} < 0.07) as k from {PTS} p join fit f using (label) group by label) select label, points, k as refined_inliers from t where k::double / points >= 0.4")
def p07(spark, sf):
    pts = view(spark, sf, "points")
    return planes.inlier_table(pts, planes.fit(pts, ["label"]), ["label"], 0.07).where("inlier_ratio_refined >= 0.4").select("label", "points", "refined_inliers")


@query("p08_outlier_flags", f"with {_fit(PTS, 'label')}, t as (select label, count(*) as points, count(*) filter ({_RES} < 0.07) as k from {PTS} p join fit f using (label) group by label) select label, k::double / points < 0.45 as is_outlier, case when k::double / points < 0.45 then 0 else k end as refined_inliers from t")
def p08(spark, sf):
    pts = view(spark, sf, "points")
    table = planes.inlier_table(pts, planes.fit(pts, ["label"]), ["label"], 0.07)
    return planes.split_by_ratio(table, 0.45).select("label", "is_outlier", F.col("refined_inliers").cast("bigint").alias("refined_inliers"))


def _gated(gates: str, thresholds: str) -> str:
    return f"""with {_fit(PTS, 'label')}, th as (select unnest({thresholds}) as threshold), ga as (select unnest({gates}) as gate),
    per as (select f.label, th.threshold, count(*) as n, count(*) filter ({_RES} < th.threshold) as k from {PTS} p join fit f using (label), th where f.label <> 0 group by all),
    s as (select threshold, gate, sum(case when k >= gate * n then k else 0 end) as kept, sum(n) as fitted from per, ga group by all),
    res as (select threshold, gate, round(kept::double / fitted, 6) as precision, round(kept::double / (select count(*) from {PTS} q), 6) as recall from s)"""


def _gated_run(spark, sf, thresholds, gates):
    pts = view(spark, sf, "points")
    return metrics.gated(pts, planes.fit(pts.where("label <> 0"), ["label"]), thresholds, gates, [])


@query("a05_gated_precision_recall", _gated("[0.3]::double[]", "[0.05]::double[]") + " select * from res")
def a05(spark, sf):
    return rounded(_gated_run(spark, sf, [0.05], [0.3]))


@query("a05_gated_by_frame", f"""with pts as (select *, label % 3 as frame_id from {PTS} q), {_fit('(select * from pts where frame_id <> 0)', 'label')}, per as (select p.frame_id, p.label, count(*) as n, count(*) filter ({_RES} < 0.05) as k from pts p join fit f using (label) group by all),
    s as (select frame_id, sum(case when k >= 0.3 * n then k else 0 end) as kept, sum(n) as fitted from per group by all) select e.frame_id, 0.05::double as threshold, 0.3::double as gate, round(coalesce(kept::double / fitted, 0), 6) as precision, round(coalesce(kept::double / total, 0), 6) as recall from (select frame_id, count(*) as total from pts group by all) e left join s using (frame_id)""")
def a05b(spark, sf):
    """By frame; a frame without a fitted segment has zeros."""
    pts = view(spark, sf, "points").withColumn("frame_id", F.col("label") % 3)
    fits = planes.fit(pts.where("frame_id <> 0"), ["frame_id", "label"])
    return rounded(metrics.gated(pts, fits, [0.05], [0.3], ["frame_id"]))


@query("a07_multi_threshold", _gated("[0.3]::double[]", "[0.02, 0.05, 0.1]::double[]") + " select * from res")
def a07(spark, sf):
    return rounded(_gated_run(spark, sf, [0.02, 0.05, 0.1], [0.3]))


@query("a08_gate_pivot", _gated("[0.3, 0.5]::double[]", "[0.05, 0.1]::double[]") + " select " + ", ".join(f"max({m}) filter (threshold = {t} and gate = {g}) as {n}_{int(t * 100)}cm_gate{str(g).replace('.', '_')}" for t in (0.05, 0.1) for g in (0.3, 0.5) for m, n in (("precision", "prec"), ("recall", "rec"))) + " from res")
def a08(spark, sf):
    return rounded(metrics.wide(_gated_run(spark, sf, [0.05, 0.1], [0.3, 0.5]), [], [0.05, 0.1], [0.3, 0.5]))


@query("a06_inlier_indices", f"with {_fit(PTS, 'label')}, rs as (select p.idx, p.label, {_RES} < 0.05 as near, avg(case when {_RES} < 0.05 then 1.0 else 0.0 end) over (partition by p.label) as share from {PTS} p join fit f using (label)) select idx, label from rs where near and share >= 0.3")
def a06(spark, sf):
    pts = view(spark, sf, "points")
    near = pts.join(planes.fit(pts, ["label"]).select("label", "a", "b", "c", "d"), "label").withColumn("near", planes.residual() < 0.05)
    share = F.avg(F.col("near").cast("int")).over(Window.partitionBy("label"))
    return near.withColumn("share", share).where("near and share >= 0.3").select("idx", "label")


@query("a09_plane_precision_recall", "select p_partkey as label, round(p_size::double / greatest(p_size + 10, 1), 6) as precision, round(p_size::double / greatest((select sum(p_size) from part), 1), 6) as recall from part")
def a09(spark, sf):
    part = view(spark, sf, "part").select(F.col("p_partkey").alias("label"), F.col("p_size").alias("refined_inliers"), (F.col("p_size") + 10).alias("num_points"))
    total = part.agg(F.sum("refined_inliers").alias("total"))
    return rounded(metrics.plane_precision_recall(part.crossJoin(F.broadcast(total)), F.col("total")).select("label", "precision", "recall"))


@query("a19_segment_means", f"select scene_id, frame_id, label, count(*) as n, round(avg(nz) / sqrt(avg(nx)*avg(nx) + avg(ny)*avg(ny) + avg(nz)*avg(nz)), 6) as nz, round(avg(z), 6) as z from {sql('px_grid')} p where label > 0 group by all having count(*) >= 50")
def a19(spark, sf):
    px = view(spark, sf, "px_grid").where("label > 0").groupBy(*KEYS).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("nx", "ny", "nz", "z")]).where("n >= 50")
    return rounded(px.select(*KEYS, "n", G.unit([F.col(c) for c in ("nx", "ny", "nz")])[2].alias("nz"), "z"))


@query("a20_distance_percentiles", f"with {_fit(PTS, 'label')} select label, " + ", ".join(f"round(quantile_cont({_RES}, {q}), 6) as p{int(q * 100)}" for q in (0.2, 0.5, 0.85, 0.95)) + f" from {PTS} p join fit f using (label) group by label")
def a20(spark, sf):
    pts = view(spark, sf, "points")
    return rounded(planes.distance_quantiles(pts, planes.fit(pts, ["label"]), ["label"], {f"p{int(q * 100)}": q for q in (0.2, 0.5, 0.85, 0.95)}))


@query("a24_robust_scale", f"with {_fit(PTS, 'label')}, rs as (select p.label, {_RES} as dist from {PTS} p join fit f using (label)) select label, round(1.4826 * quantile_cont(dist, 0.5), 6) as sigma from rs group by label")
def a24(spark, sf):
    pts = view(spark, sf, "points")
    return rounded(planes.distance_quantiles(pts, planes.fit(pts, ["label"]), ["label"], {"m": 0.5}).select("label", (1.4826 * F.col("m")).alias("sigma")))


@query("a25_depth_range", f"select frame_id, round(quantile_cont(z, 0.9), 6) as p90, round(list_sort(list(z))[cast(floor(count(*) * 0.99) as int) + 1], 6) as p99_sorted from {sql('px_grid')} p group by frame_id")
def a25(spark, sf):
    w = Window.partitionBy("frame_id")
    px = view(spark, sf, "px_grid").select("frame_id", "z", F.row_number().over(w.orderBy("z")).alias("rn"), F.count("*").over(w).alias("n"))
    at = F.max(F.when(F.col("rn") == F.floor(F.col("n") * 0.99) + 1, F.col("z")))
    return rounded(px.groupBy("frame_id").agg(F.percentile("z", F.lit(0.9)).alias("p90"), at.alias("p99_sorted")))


_COP = f"select a.label, a.plane_id as a_id, b.plane_id as b_id, round(abs(a.d - b.d), 6) as \"offset\" from {PL} a join {PL} b on a.plane_id < b.plane_id and abs(a.d - b.d) <= {{tol}} and a.nx*b.nx + a.ny*b.ny + a.nz*b.nz >= {{cos!r}}"


@query("j15_param_merge_pairs", (_COP + " and a.label = b.label").format(tol=0.05, cos=cos(radians(12.0))))
def j15(spark, sf):
    return rounded(planes.coplanar_pairs(view(spark, sf, "planes_fx"), 12.0, 0.05, ["label"]).select("label", "a_id", "b_id", "offset"), quick=True)


@query("j15_global_pairs", f"select count(*) as pairs, round(sum(\"offset\"), 4) as total from ({_COP.format(tol=0.01, cos=cos(radians(3.0)))}) t")
def j15b(spark, sf):
    return rounded(planes.coplanar_totals(view(spark, sf, "planes_fx"), 3.0, 0.01), digits=4)


@query("j17_signed_offsets", f"select a.plane_id as a_id, b.plane_id as b_id, round(case when a.nx*b.nx + a.ny*b.ny + a.nz*b.nz < 0 then abs(a.d + b.d) else abs(a.d - b.d) end, 6) as gap from {PL} a join {PL} b on a.label = b.label and a.plane_id < b.plane_id and abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) >= {cos(radians(10.0))!r} and case when a.nx*b.nx + a.ny*b.ny + a.nz*b.nz < 0 then abs(a.d + b.d) else abs(a.d - b.d) end <= 0.1")
def j17(spark, sf):
    return rounded(planes.facing_pairs(view(spark, sf, "planes_fx"), 10.0, 0.1, ["label"]).select("a_id", "b_id", "gap"), quick=True)


@query("g01_plane_components", f"with recursive e as ({_COP.format(tol=0.05, cos=cos(radians(12.0)))} and a.label = b.label), both_ as (select label, a_id as x, b_id as y from e union select label, b_id, a_id from e), reach as (select label, plane_id as x, plane_id as y from {PL} n union select r.label, r.x, b.y from reach r join both_ b on r.y = b.x and r.label = b.label) select label, x as plane_id, min(y) as component from reach group by all")
def g01(spark, sf):
    return planes.coplanar_components(view(spark, sf, "planes_fx"), 12.0, 0.05, ["label"])


@query("w05_gap_clusters", f"with g as (select plane_id, label, d, case when d - lag(d) over (partition by label order by d) > 0.01 then 1 else 0 end as o from {PL} p), c as (select label, sum(o) over (partition by label order by d rows between unbounded preceding and current row) as cluster from g) select label, cluster::bigint as cluster, count(*) as n from c group by all")
def w05(spark, sf):
    return planes.gap_clusters(view(spark, sf, "planes_fx"), ["label"], "d", 0.01).groupBy("label", "cluster").agg(F.count("*").alias("n"))


@query("f05_normalise_planes", "select p_partkey, round((p_size - 25.0) / s, 6) + 0.0 as a, round(1.0 / s, 6) as c, round(p_retailprice / s, 6) as d from (select *, sqrt((p_size - 25.0) * (p_size - 25.0) + 1.0) as s from part) t")
def f05(spark, sf):
    a, _, c, d = G.upright([-(F.col("p_size") - 25.0), F.lit(0.0), F.lit(-1.0)], -F.col("p_retailprice"))
    return rounded(view(spark, sf, "part").select("p_partkey", a.alias("a"), c.alias("c"), d.alias("d")))


@query("f06_three_point_planes", f"with t as (select label, min(idx) as i from {PTS} p group by 1), q as (select t.label, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz, c.x as cx, c.y as cy, c.z as cz from t join {PTS} a on a.idx = t.i join {PTS} b on b.idx = t.i + 1 join {PTS} c on c.idx = t.i + 2), n as (select *, (by_-ay)*(cz-az) - (bz-az)*(cy-ay) as nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) as ny, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) as nz from q), m as (select *, sqrt(nx*nx+ny*ny+nz*nz) as s, -(nx*ax+ny*ay+nz*az) as d0 from n) select label, round(nx/s*case when d0<0 then -1 else 1 end, 6) + 0.0 as a, round(ny/s*case when d0<0 then -1 else 1 end, 6) + 0.0 as b, round(nz/s*case when d0<0 then -1 else 1 end, 6) + 0.0 as c, round(abs(d0)/s, 6) as d from m")
def f06(spark, sf):
    pts = view(spark, sf, "points")
    first = pts.groupBy("label").agg(F.min("idx").alias("i"))
    for k, n in enumerate("pqr"):
        first = first.join(pts.select((F.col("idx") - k).alias("i"), *[F.col(c).alias(f"{n}{c}") for c in "xyz"]), "i")
    p = [[F.col(f"{n}{c}") for c in "xyz"] for n in "pqr"]
    return rounded(first.select("label", *[x.alias(k) for x, k in zip(G.three_points(*p), "abcd", strict=True)]))


@query("f07_plane_basis", f"select plane_id, round(case when abs(nx) < 0.9 then 0 else -nz / sqrt(nz*nz + nx*nx) end, 6) + 0.0 as ex, round(case when abs(nx) < 0.9 then nz / sqrt(nz*nz + ny*ny) else 0 end, 6) + 0.0 as ey from {PL} p")
def f07(spark, sf):
    e, _ = G.basis([F.col(f"n{c}") for c in "xyz"])
    return rounded(view(spark, sf, "planes_fx").select("plane_id", e[0].alias("ex"), e[1].alias("ey")))


@query("f08_project_to_plane", f"select idx, round(x - (z - 0.1) * 0.0, 6) + 0.0 as x, 0.1::double as z, round(case when abs(z) > 1e-8 and abs(0.1 / z - 1) * sqrt(x*x + y*y + z*z) <= 0.3 then x * (0.1 / z) else x end, 6) + 0.0 as rx from {PTS} p")
def f08(spark, sf):
    p, n, d = [F.col(c) for c in "xyz"], [F.lit(0.0), F.lit(0.0), F.lit(1.0)], F.lit(-0.1)
    near, ray = G.onto_plane(p, n, d), G.onto_plane_by_ray(p, n, d)
    return rounded(view(spark, sf, "points").select("idx", near[0].alias("x"), near[2].alias("z"), ray[0].alias("rx")))


@query("f15_inverse_planes", f"select plane_id, round(nx / d / sqrt(nx/d*nx/d + ny/d*ny/d + nz/d*nz/d), 6) + 0.0 as a, round(1.0 / sqrt(nx/d*nx/d + ny/d*ny/d + nz/d*nz/d), 6) as d from {PL} p")
def f15(spark, sf):
    p = view(spark, sf, "planes_fx").select("plane_id", *[(F.col(f"n{c}") / F.col("d")).alias(f"q{c}") for c in "xyz"])
    a, _, _, d = G.from_inverse("qx", "qy", "qz")
    return rounded(p.select("plane_id", a.alias("a"), d.alias("d")))


@query("p27_outlier_clip", f"with c as (select label, quantile_cont(x, 0.5) as mx, quantile_cont(y, 0.5) as my, quantile_cont(z, 0.5) as mz from {PTS} p group by 1), d as (select p.idx, p.label, sqrt((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) as r from {PTS} p join c using (label)), q as (select label, quantile_cont(r, 0.98) as cap from d group by 1) select idx, d.label from d join q using (label) where r < cap - 1e-12")
def p27(spark, sf):
    pts = view(spark, sf, "points")
    mid = pts.groupBy("label").agg(*[F.percentile(c, F.lit(0.5)).alias(f"m{c}") for c in "xyz"])
    far = pts.join(mid, "label").withColumn("r", G.norm(*[F.col(c) - F.col(f"m{c}") for c in "xyz"]))
    caps = far.groupBy("label").agg(F.percentile("r", F.lit(0.98)).alias("cap"))
    return far.join(caps, "label").where("r < cap - 1e-12").select("idx", "label")


@query("x03_robust_fits")
def x03(spark, sf):
    return kernels.robust_fits(_cloud(spark, sf), KEYS, 0.01, 200, 100)


@query("x04_huber_fits")
def x04(spark, sf):
    return kernels.huber_fits(_cloud(spark, sf), KEYS)


@query("x06_sequential_planes")
def x06(spark, sf):
    cloud = _cloud(spark, sf).drop("label")
    return kernels.sequential_planes(cloud, ["scene_id", "frame_id"], 0.02, 0.5, 60, 50, 8)
