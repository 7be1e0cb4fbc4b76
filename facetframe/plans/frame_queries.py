"""Queries over pixel rasters: predicates, back-projection, stencils, resizing, regions."""

from __future__ import annotations

from math import cos, radians, sqrt

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, joins, kernels, stencil
from ._common import registrar, rounded
from .fixtures import sql, view

QUERIES, query = registrar()

PX = sql("px_grid")
CAMERA = G.Pinhole(40.0, 40.0, 15.5, 11.5)
POSED = G.Pinhole(40.0, 40.0, 15.5, 11.5, ((0.0, 0.0, 1.0, 0.5), (-1.0, 0.0, 0.0, 1.0), (0.0, -1.0, 0.0, 2.0)))
KEY = "scene_id, frame_id, v, u"
X, Y = "((u - 15.5) * z / 40.0)", "((v - 11.5) * z / 40.0)"


def _r(digits: int = 6, **columns: str) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 as {n}" for n, c in columns.items())


def _frames(spark, sf):
    return view(spark, sf, "px_grid")


@query("p01_planarity_mask", f"select scene_id, frame_id, count(*) as planar from {PX} p where planarity > 0.3 group by all")
def p01(spark, sf):
    return _frames(spark, sf).where(F.col("planarity") > 0.3).groupBy("scene_id", "frame_id").agg(F.count("*").alias("planar"))


@query("p02_valid_depth", f"select {KEY}, isfinite(case when u % 7 = 0 then 'nan'::double when u % 5 = 0 then 'infinity'::double when u % 3 = 0 then 0 else z end) and case when u % 7 = 0 then 'nan'::double when u % 5 = 0 then 'infinity'::double when u % 3 = 0 then 0 else z end > 0 as ok from {PX} p")
def p02(spark, sf):
    z = F.when(F.col("u") % 7 == 0, float("nan")).when(F.col("u") % 5 == 0, float("inf")).when(F.col("u") % 3 == 0, 0.0).otherwise(F.col("z"))
    return _frames(spark, sf).withColumn("d", z).select("scene_id", "frame_id", "v", "u", G.valid_depth("d").alias("ok"))


@query("p03_finite_points", f"select {KEY} from {PX} p where u % 4 <> 0")
def p03(spark, sf):
    px = _frames(spark, sf).withColumn("x", F.when(F.col("u") % 4 == 0, float("nan")).otherwise(F.col("u").cast("double")))
    return px.where(G.finite("x", "z")).select("scene_id", "frame_id", "v", "u")


@query("p21_adaptive_inliers", f"select {KEY}, (abs(z - 2.5) < 0.4 * greatest(1.0, z / 10.0)) and (abs(nz) > 0.9 or sqrt(nx * nx + ny * ny + nz * nz) < 0.5) as ok from {PX} p")
def p21(spark, sf):
    ok = G.adaptive_inlier(F.abs(F.col("z") - 2.5), F.col("nz"), G.norm(*[F.col(c) for c in ("nx", "ny", "nz")]), F.col("z"), 0.4, 0.9)
    return _frames(spark, sf).select("scene_id", "frame_id", "v", "u", ok.alias("ok"))


@query("p22_project_points", "with q as (select idx, trunc((x * 5) / (z + 2) * 40 + 15.5)::int as u, trunc((y * 5) / (z + 2) * 40 + 11.5)::int as v, z + 2 as d from " + sql("points") + " p) select idx, u, v from q where d > 0 and u >= 0 and u < 32 and v >= 0 and v < 24")
def p22(spark, sf):
    pts = view(spark, sf, "points").select("idx", (F.col("x") * 5).alias("x"), (F.col("y") * 5).alias("y"), (F.col("z") + 2).alias("z")).where("z > 0")
    u, v = G.project(CAMERA)
    return pts.select("idx", u.alias("u"), v.alias("v")).where(G.inside("u", "v", 32, 24))


@query("p23_depth_cap", f"select scene_id, count(*) filter (label > 0 and not (z > 0.1 and z < 3.0)) as capped, max(case when label > 0 then z end) as deepest from {PX} p group by scene_id")
def p23(spark, sf):
    out = (F.col("label") > 0) & ~((F.col("z") > 0.1) & (F.col("z") < 3.0))
    return _frames(spark, sf).groupBy("scene_id").agg(F.count_if(out).alias("capped"), F.max(F.when(F.col("label") > 0, F.col("z"))).alias("deepest"))


@query("f01_backproject", f"select {KEY}, {_r(x='z + 0.5', y=f'1.0 - {X}', z=f'2.0 - {Y}')} from {PX} p")
def f01(spark, sf):
    xyz = G.backproject(POSED)
    return rounded(_frames(spark, sf).select("scene_id", "frame_id", "v", "u", *[c.alias(n) for c, n in zip(xyz, "xyz", strict=True)]))


MATRIX = [[0.6, 0.0, 0.01], [0.0, 0.45, -0.02], [0.0, 0.0, -1.0]]
_A, _B = "((u + 0.5) * 2.0 / 32 - 1)", "(1 - (v + 0.5) * 2.0 / 24)"
_RX, _RY = f"({_A} * 0.6 + 0.01)", f"({_B} * 0.45 - 0.02)"
_RN = f"sqrt({_RX} * {_RX} + {_RY} * {_RY} + 1)"


@query("f02_matrix_backproject", f"select {KEY}, {_r(x=f'z * {_RX} / {_RN}', y=f'z * {_RY} / {_RN}', w=f'-z / {_RN}')} from {PX} p")
def f02(spark, sf):
    x, y, w = G.matrix_backproject("z", MATRIX, 32, 24)
    return rounded(_frames(spark, sf).select("scene_id", "frame_id", "v", "u", x.alias("x"), y.alias("y"), w.alias("w")))


# these values end with their seventh digit; to six, half of them would be ties
@query("f03_point_map_variants", f"select {KEY}, {_r(7, x0=X, y0=Y, x1='((u + 1 - 15.5) * z / 40.0)', y1='((v + 1 - 11.5) * z / 40.0)', yup=f'-{Y}')} from {PX} p")
def f03(spark, sf):
    zero, one, up = G.backproject(CAMERA), G.backproject(CAMERA, origin=1), G.backproject(CAMERA, up=True)
    return rounded(_frames(spark, sf).select("scene_id", "frame_id", "v", "u", zero[0].alias("x0"), zero[1].alias("y0"), one[0].alias("x1"), one[1].alias("y1"), up[1].alias("yup")), digits=7)


@query("f04_euclidean_to_z", f"select {KEY}, {_r(z1='z / sqrt(((u - 15.5) / 40.0) * ((u - 15.5) / 40.0) + ((v - 11.5) / 40.0) * ((v - 11.5) / 40.0) + 1)', z2=f'z / {_RN}')} from {PX} p")
def f04(spark, sf):
    return rounded(_frames(spark, sf).select("scene_id", "frame_id", "v", "u", G.euclidean_to_z("z", CAMERA).alias("z1"), G.matrix_euclidean_to_z("z", MATRIX, 32, 24).alias("z2")))


@query("f09_intrinsics", "select c_custkey, round(c_acctbal * 31 / 2, 6) + 0.0 as fx, round(c_acctbal * 0.5, 6) + 0.0 as half from customer")
def f09(spark, sf):
    unit = G.from_projection(1.0, 1.0, 32, 24)
    c = view(spark, sf, "customer")
    return rounded(c.select("c_custkey", (F.col("c_acctbal") * unit.fx).alias("fx"), (F.col("c_acctbal") * G.Pinhole(1, 1, 0, 0).resized(0.5, 1).fx).alias("half")))


@query("f10_depth_decode", "select l_orderkey, l_linenumber, round(5000.0 * (l_partkey % 256 + 256.0 * (l_suppkey % 256) + 65536.0 * l_linenumber) / 16777215.0, 6) as metres, cast(least(greatest(round_even(l_quantity * 1000.0, 0), 0), 65535) as int) as mm from lineitem")
def f10(spark, sf):
    rows = view(spark, sf, "lineitem").withColumns({"r": F.col("l_partkey") % 256, "g": F.col("l_suppkey") % 256, "b": F.col("l_linenumber")})
    return rounded(rows.select("l_orderkey", "l_linenumber", G.rgb_depth("r", "g", "b").alias("metres"), G.millimetres("l_quantity").alias("mm")))


@query("f11_tone_map", f"with e as (select frame_id as f, quantile_cont(z, 0.9) as q from {PX} p group by 1) select {KEY}, {_r(tone='pow(least(greatest(z * (0.8 / q), 0), 1), 1 / 2.2)')} from {PX} p join e on p.frame_id = e.f")
def f11(spark, sf):
    px = _frames(spark, sf)
    exposure = px.groupBy("frame_id").agg(F.percentile("z", F.lit(0.9)).alias("q"))
    return rounded(px.join(exposure, "frame_id").select("scene_id", "frame_id", "v", "u", G.tone("z", F.lit(0.8) / F.col("q")).alias("tone")))


@query("f16_nearest_resize", f"select a.scene_id, a.frame_id, o.v, o.u, a.label from (select v.i as v, u.i as u from (select unnest(range(12))::int as i) v, (select unnest(range(20))::int as i) u) o join {PX} a on a.v = floor(o.v * 24 / 12.0) and a.u = floor(o.u * 32 / 20.0)")
def f16(spark, sf):
    return stencil.nearest_resize(_frames(spark, sf), 24, 32, 12, 20, "label")


def _tap(new: int, old: int) -> str:
    spot = f"greatest(0.0, least({old - 1}.0, (i + 0.5) * {old} / {new}.0 - 0.5))"
    spots = f"(select i, {spot} as spot from (select unnest(range({new}))::int as i) r) t"
    return f"(select i, floor(spot)::int as src, 1 - (spot - floor(spot)) as w from {spots} union all select i, least(floor(spot)::int + 1, {old - 1}), spot - floor(spot) from {spots})"


@query("f16_bilinear_resize", f"select a.scene_id, a.frame_id, v.i as v, u.i as u, round(sum(a.z * v.w * u.w), 6) as z from {PX} a join {_tap(12, 24)} v on a.v = v.src join {_tap(20, 32)} u on a.u = u.src group by all")
def f16b(spark, sf):
    return rounded(stencil.bilinear_resize(_frames(spark, sf), 24, 32, 12, 20, "z"))


_ROW, _COLUMN = "(partition by scene_id, frame_id, v order by u)", "(partition by scene_id, frame_id, u order by v)"


def _step(c: str, over: str) -> str:
    return f"lead({c}, 1, 0) over {over} - lag({c}, 1, 0) over {over}"


def _mean(c: str, over: str) -> str:
    return f"lead({c}, 1, 0) over {over} + 2 * {c} + lag({c}, 1, 0) over {over}"


# the two gradients as a difference along one axis and a mean along the other; frames are whole rasters, outside is 0
_W1 = f"""r1 as (select *, {_step('nx', _ROW)} as dx, {_step('nz', _ROW)} as dz, {_mean('nx', _ROW)} as mx, {_mean('nz', _ROW)} as mz from px),
    g1 as (select *, {_mean('dx', _COLUMN)} as ax, {_mean('dz', _COLUMN)} as az, {_step('mx', _COLUMN)} as bx, {_step('mz', _COLUMN)} as bz from r1),
    w1 as (select scene_id, frame_id, v, u, sqrt(ax*ax + az*az + bx*bx + bz*bz) as gradient from g1)"""


@query("w01_normal_gradient", f"with px as (select * from {PX} p), {_W1} select {KEY}, round(gradient, 6) as gradient from w1")
def w01(spark, sf):
    return rounded(stencil.normal_gradient(_frames(spark, sf)).select("scene_id", "frame_id", "v", "u", "gradient"))


def _moved(c: str, by: int, over: str) -> str:
    return c if by == 0 else f"{'lead' if by > 0 else 'lag'}({c}, {abs(by)}) over {over}"


_NEIGHBOURS = " + ".join(f"coalesce((abs(z - {_moved(f'e{du + 2}', dv, _COLUMN)}) < 0.025 * z)::int, 0)" for dv in range(-2, 3) for du in range(-2, 3) if dv or du)
_W2 = f"""with px as (select * from {PX} p), {_W1}, f as (select px.*, gradient <= {sqrt(2 - 2 * cos(radians(5.0)))!r} as smooth from px join w1 using (scene_id, frame_id, v, u)),
    s as (select *, case when planarity > 0.3 and smooth then z end as e from f), r as (select *, {', '.join(f"{_moved('e', du, _ROW)} as e{du + 2}" for du in range(-2, 3))} from s),
    t as (select *, ({_NEIGHBOURS})::bigint as n from r), c as (select scene_id, frame_id, v, u, n from t where planarity > 0.3)"""


@query("w02_connected_pixels", f"{_W2} select f.scene_id, f.frame_id, f.v, f.u, coalesce(c.n, 0) as neighbours, coalesce(c.n, 0) >= 8 as connected from f left join c on f.scene_id = c.scene_id and f.frame_id = c.frame_id and f.v = c.v and f.u = c.u")
def w02(spark, sf):
    return stencil.connected(_frames(spark, sf)).select("scene_id", "frame_id", "v", "u", F.col("neighbours").cast("bigint").alias("neighbours"), "connected")


@query("w02_connected_by_join", f"{_W2} select f.scene_id, f.frame_id, f.v, f.u, coalesce(c.n, 0) as neighbours, coalesce(c.n, 0) >= 8 as connected from f left join c on f.scene_id = c.scene_id and f.frame_id = c.frame_id and f.v = c.v and f.u = c.u")
def w02b(spark, sf):
    return stencil.connected_by_join(_frames(spark, sf)).drop("gradient")


_XYZ = f"(select scene_id, frame_id, v, u, {X} as x, {Y} as y, z from {PX} p)"


def _diff(c: str, axis: str) -> str:
    w = f"(partition by scene_id, frame_id, {'u' if axis == 'v' else 'v'} order by {axis})"
    return f"lead({c}) over {w} - lag({c}) over {w} as {c}{axis}"


@query("w03_central_normals", f"with d as (select *, {', '.join(_diff(c, a) for a in 'uv' for c in 'xyz')} from {_XYZ} t), n as (select *, yu*zv - zu*yv as a, zu*xv - xu*zv as b, xu*yv - yu*xv as c from d), s as (select *, sqrt(a*a + b*b + c*c) as l, case when c > 0 then -1.0 else 1.0 end as g from n) select {KEY}, round(case when l > 0 then a * g / l else 0 end, 5) + 0.0 as cnx, round(case when l > 0 then b * g / l else 0 end, 5) + 0.0 as cny, round(case when l > 0 then c * g / l else 0 end, 5) + 0.0 as cnz from s")
def w03(spark, sf):
    xyz = G.backproject(CAMERA)
    px = _frames(spark, sf).select("scene_id", "frame_id", "v", "u", *[c.alias(n) for c, n in zip(xyz, "xyz", strict=True)])
    return rounded(stencil.central_normals(px).drop("x", "y", "z"), digits=5)


@query("w04_gradient_normals", f"""with d as (select *, coalesce(lead(z) over (partition by scene_id, frame_id, v order by u) - z, z - lag(z) over (partition by scene_id, frame_id, v order by u), 0) as zu,
    coalesce(lead(z) over (partition by scene_id, frame_id, u order by v) - z, z - lag(z) over (partition by scene_id, frame_id, u order by v), 0) as zv from {PX} p),
    n as (select *, -40 * zu as a, -40 * zv as b, z + (u - 15.5) * zu + (v - 11.5) * zv as c from d) select {KEY}, {_r(gnx='a / sqrt(a*a+b*b+c*c)', gny='b / sqrt(a*a+b*b+c*c)', gnz='c / sqrt(a*a+b*b+c*c)')} from n""")
def w04(spark, sf):
    return rounded(stencil.gradient_normals(_frames(spark, sf), 40.0, 40.0, 15.5, 11.5).select("scene_id", "frame_id", "v", "u", "gnx", "gny", "gnz"))


def _components(on: str, same: str, eight: bool) -> str:
    """Recursive CTEs ending in ``m``: of each marked pixel the first one, in row order, that steps inside the mark reach."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    return f"""with recursive p as (select *, v * 1000 + u as id from {sql('px_marks')} q where {on}), st as (select * from (values {', '.join(map(str, steps))}) t(dv, du)),
    e as (select a.frame_id, a.id as a, b.id as b from (select p.*, v + dv as w, u + du as x from p, st) a join p b on a.frame_id = b.frame_id and a.w = b.v and a.x = b.u and {same}),
    r as (select frame_id, id as x, id as y from p union select r.frame_id, r.x, e.b from r join e on r.frame_id = e.frame_id and r.y = e.a),
    m as (select p.scene_id, p.frame_id, p.v, p.u, p.label, r.root from p join (select frame_id, x, min(y) as root from r group by all) r on p.frame_id = r.frame_id and p.id = r.x)"""


_MARKS = sql("px_marks")
_NUMBERED = "dense_rank() over (partition by frame_id order by root)"


@query("g02_mask_components", f"{_components('label > 0', 'true', True)}, n as (select *, {_NUMBERED} as region from m) select scene_id, frame_id, region::int as region, count(*) as pixels from n group by all")
def g02(spark, sf):
    px = view(spark, sf, "px_marks").withColumn("on", F.col("label") > 0)
    return graph.pixel_components(px, "on").where("region > 0").groupBy("scene_id", "frame_id", "region").agg(F.count("*").alias("pixels"))


@query("g02_frame_regions", f"{_components('label = 1', 'true', True)}, n as (select *, {_NUMBERED} as region from m) select q.scene_id, q.frame_id, q.v, q.u, coalesce(n.region, 0)::int as region from {_MARKS} q left join n on q.frame_id = n.frame_id and q.v = n.v and q.u = n.u")
def g02b(spark, sf):
    return kernels.label_regions(view(spark, sf, "px_marks").withColumn("on", F.col("label") == 1), "on")


@query("x01_planar_segments", f"{_W2} select scene_id, frame_id, case when u < 15 then 1 else 2 end as region, count(*) as pixels from c where n >= 8 group by all")
def x01(spark, sf):
    """Both halves are one region each, so the twin names them by their side of the crease."""
    found = kernels.label_regions(stencil.connected(_frames(spark, sf)), "connected")
    return found.where("region > 0").groupBy("scene_id", "frame_id", "region").agg(F.count("*").alias("pixels"))


@query("p05_small_components", f"{_components('label > 0', 'a.label = b.label', False)}, n as (select *, count(*) over (partition by frame_id, root) as pixels from m) select scene_id, frame_id, v, u, label from n where pixels >= 4")
def p05(spark, sf):
    """Pixels of each label but those in a 4-connected component below four pixels."""
    return kernels.drop_small(view(spark, sf, "px_marks"), "label", 4)


@query("j18_bridged_pairs", f"""with p as (select * from {_MARKS} q), o as (select a.i as dv, b.i as du from (select unnest(range(-2, 3))::int as i) a, (select unnest(range(-2, 3))::int as i) b where a.i * a.i + b.i * b.i <= 4),
    t as (select frame_id, v, u, case when (v + u) % 4 = 0 then label else 0 end as label from p), w as (select t.frame_id, t.v, t.u, arg_min(x.label, row(dv * dv + du * du, x.v, x.u)) as label from (select t.*, v + dv as w, u + du as h, dv, du from t, o where label = 0) t join t x on x.frame_id = t.frame_id and x.v = t.w and x.u = t.h and x.label > 0 group by all),
    f as (select frame_id, v, u, label from t where label > 0 union all select * from w), n as (select a.frame_id, a.label as a, b.label as b from f a join f b on a.frame_id = b.frame_id and ((a.v = b.v and b.u = a.u + 1) or (a.u = b.u and b.v = a.v + 1)) where a.label <> b.label)
    select distinct p.scene_id, n.frame_id, least(n.a, n.b) as a, greatest(n.a, n.b) as b from n join (select distinct scene_id, frame_id from p) p using (frame_id)""")
def j18b(spark, sf):
    px = view(spark, sf, "px_marks").withColumn("label", F.when((F.col("v") + F.col("u")) % 4 == 0, F.col("label")).otherwise(0))
    return joins.bridged_pairs(px, "label", 2, ["scene_id", "frame_id"])


@query("j19_near_segments", f"with p as (select scene_id, frame_id, v, u, label * 100 + (u // 3) as label from {_MARKS} q where label > 0) select distinct a.scene_id, a.frame_id, a.label as a, b.label as b from p a join p b on a.frame_id = b.frame_id and a.label < b.label and (a.v - b.v) * (a.v - b.v) + (a.u - b.u) * (a.u - b.u) <= 4")
def j19(spark, sf):
    px = view(spark, sf, "px_marks").withColumn("label", F.when(F.col("label") > 0, F.col("label") * 100 + F.floor(F.col("u") / 3).cast("int")).otherwise(0))
    return joins.near_pairs(px, "label", 2, ["scene_id", "frame_id"])


@query("g15_merge_segments")
def g15(spark, sf):
    return kernels.merge_segments(_frames(spark, sf), degrees=45.0, offset=2.0)
