"""Queries over triangle meshes."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, kernels, mesh, raycast
from ._common import registrar, rounded
from .fixtures import sql, view

QUERIES, query = registrar()

FACES, VERTS = sql("mesh_faces"), sql("mesh_vertices")
# faces with corners, normals, centroids and areas as CTEs ending in ``sh``
_SH = f"""co as (select f.*, a.x as x0, a.y as y0, a.z as z0, b.x as x1, b.y as y1, b.z as z1, c.x as x2, c.y as y2, c.z as z2 from {FACES} f join {VERTS} a on a.scene_id = f.scene_id and a.vid = f.v0 join {VERTS} b on b.scene_id = f.scene_id and b.vid = f.v1 join {VERTS} c on c.scene_id = f.scene_id and c.vid = f.v2),
    cr as (select *, (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) as p, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) as q, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) as r from co),
    sh as (select *, sqrt(p*p+q*q+r*r) / 2 as area, p / sqrt(p*p+q*q+r*r) as nx, q / sqrt(p*p+q*q+r*r) as ny, r / sqrt(p*p+q*q+r*r) as nz, (x0+x1+x2)/3 as cx, (y0+y1+y2)/3 as cy, (z0+z1+z2)/3 as cz from cr)"""
_ADJ = f"""ed as (select scene_id, fid, least(a, b) as a, greatest(a, b) as b from (select scene_id, fid, v0 as a, v1 as b from {FACES} f union all select scene_id, fid, v1, v2 from {FACES} f union all select scene_id, fid, v2, v0 from {FACES} f) t),
    adj as (select distinct x.scene_id, x.fid as f1, y.fid as f2 from ed x join ed y on x.scene_id = y.scene_id and x.a = y.a and x.b = y.b and x.fid <> y.fid)"""


def _faces(spark, sf):
    return view(spark, sf, "mesh_faces")


def _verts(spark, sf):
    return view(spark, sf, "mesh_vertices")


def _shapes(spark, sf):
    return mesh.shapes(_faces(spark, sf), _verts(spark, sf))


@query("j10_face_shapes", f"with {_SH} select scene_id, fid, round(area, 6) as area, round(nx, 6) + 0.0 as nx, round(ny, 6) + 0.0 as ny, round(nz, 6) + 0.0 as nz, round(cx, 6) as cx, round(cy, 6) as cy, round(cz, 6) as cz from sh")
def j10(spark, sf):
    return rounded(_shapes(spark, sf).select("scene_id", "fid", "area", "nx", "ny", "nz", "cx", "cy", "cz"))


@query("j13_face_adjacency", f"with {_ADJ} select scene_id, f1, f2 from adj")
def j13(spark, sf):
    return mesh.adjacency(_faces(spark, sf))


@query("j14_segment_neighbours", f"with {_ADJ} select distinct adj.scene_id, a.plane_id as s1, b.plane_id as s2 from adj join {FACES} a on a.scene_id = adj.scene_id and a.fid = f1 join {FACES} b on b.scene_id = adj.scene_id and b.fid = f2 where a.plane_id <> b.plane_id and a.plane_id <> -1 and b.plane_id <> -1")
def j14(spark, sf):
    return mesh.neighbour_labels(_faces(spark, sf), "plane_id")


@query("p09_plane_sweep", f"with {_SH} select scene_id, fid, 1::bigint as by_plane from sh where nz > 0 and nz >= {cos(radians(25.0))!r} and (abs(z0 - 0.1) <= 0.15)::int + (abs(z1 - 0.1) <= 0.15)::int + (abs(z2 - 0.1) <= 0.15)::int >= 2")
def p09(spark, sf):
    shapes = _shapes(spark, sf)
    pl = shapes.select("scene_id", "label_int").distinct().withColumns({"plane_id": F.lit(1).cast("bigint"), "a": F.lit(0.0), "b": F.lit(0.0), "c": F.lit(1.0), "d": F.lit(-0.1)})
    return mesh.swept(shapes, pl, 25.0, 0.15, 0.6).select("scene_id", "fid", F.col("by").alias("by_plane"))


@query("p10_plane_quality", f"with {_SH}, k as (select * from sh where plane_id > 0), pt as (select distinct scene_id, plane_id, x, y, z from (select scene_id, plane_id, x0 as x, y0 as y, z0 as z from k union all select scene_id, plane_id, x1, y1, z1 from k union all select scene_id, plane_id, x2, y2, z2 from k) t), s as (select scene_id, plane_id, quantile_cont(abs(z - 0.1), 0.95) as p95, avg((abs(z - 0.1) <= 0.012)::int) as inlier_frac, max(z) - min(z) as thickness, max(x) - min(x) as wx, max(y) - min(y) as wy from pt group by all), a as (select scene_id, plane_id, quantile_cont(degrees(acos(least(1.0, abs(nz)))), 0.95) as normal_p95_deg, sum(area) as area from k group by all) select scene_id, plane_id, round(p95, 6) as p95, round(inlier_frac, 6) as inlier_frac, round(thickness, 6) as thickness, round(normal_p95_deg, 4) as normal_p95_deg, round(least(wx, wy), 6) as min_width, round(area / greatest(wx * wy, 1e-9), 6) as fill from s join a using (scene_id, plane_id)")
def p10(spark, sf):
    shapes = _shapes(spark, sf).where("plane_id > 0")
    pl = shapes.select("scene_id", "plane_id").distinct().withColumns({"a": F.lit(0.0), "b": F.lit(0.0), "c": F.lit(1.0), "d": F.lit(-0.1)})
    return rounded(mesh.quality(shapes, pl, ["scene_id", "plane_id"])).withColumn("normal_p95_deg", F.round("normal_p95_deg", 4))


@query("p11_area_tiers", "select l_orderkey, l_linenumber, case when l_quantity < 1 then 'small' when l_quantity < 10 then 'normal' when l_quantity < 40 then 'big' else 'huge' end as tier from lineitem")
def p11(spark, sf):
    return view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", mesh.tiers("l_quantity", 1, 10, 40).alias("tier"))


@query("p12_fan_triangulation", "with p as (select scene_id, fid as pid, list(plane_id order by seq, plane_id) as vids from " + sql("outlines") + " o group by all having count(*) >= 3) select scene_id, pid, k::int as k, vids[1] as v0, vids[k + 1] as v1, vids[k + 2] as v2 from p, (select unnest(range(1, 8)) as k) t where k <= len(vids) - 2 and vids[1] <> vids[k + 1] and vids[k + 1] <> vids[k + 2] and vids[1] <> vids[k + 2]")
def p12(spark, sf):
    o = view(spark, sf, "outlines").groupBy("scene_id", F.col("fid").alias("pid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "plane_id"))), lambda x: x["plane_id"]).alias("vids"))
    return mesh.clean(mesh.fans(o))


_OWNER = "case when {0}x < 2 then 1 when {0}x < 4 then -1 else 2 end"
_OWNERS = ", ".join(f"{_OWNER.format(k + '.')} as {k}" for k in "abc")


@query("p26_plane_mesh_faces", f"with o as (select f.scene_id, f.fid, {_OWNERS} from {FACES} f join {VERTS} a on a.scene_id = f.scene_id and a.vid = f.v0 join {VERTS} b on b.scene_id = f.scene_id and b.vid = f.v1 join {VERTS} c on c.scene_id = f.scene_id and c.vid = f.v2) select scene_id, fid from o where a = b and b = c and a <> -1")
def p26(spark, sf):
    v = _verts(spark, sf).withColumn("owner", F.expr(_OWNER.format("")))
    return mesh.plane_mesh_faces(_faces(spark, sf), v, "owner").select("scene_id", "fid")


@query("a14_semantic_legend", "with c as (select p_brand as name, count(*) as face_count from part group by 1) select name, face_count, (row_number() over (order by name) - 1)::int as semantic_id from c")
def a14(spark, sf):
    return mesh.legend(view(spark, sf, "part").withColumnRenamed("p_brand", "name"), "name")


@query("a15_label_stats", f"with {_SH} select s.scene_id, s.label_int, count(*) as faces, round(sum(area), 6) as area, (select count(distinct v) from (select unnest([v0, v1, v2]) as v from {FACES} g where g.scene_id = s.scene_id and g.label_int = s.label_int) t) as vertices from sh s group by all")
def a15(spark, sf):
    return rounded(mesh.label_stats(_shapes(spark, sf)))


@query("a16_face_votes", f"with v as (select scene_id, fid, unnest([v0, v1, v2]) as vid from {FACES} f), c as (select v.scene_id, fid, label_int, count(*) as n from v join {VERTS} x on x.scene_id = v.scene_id and x.vid = v.vid group by all), w as (select *, row_number() over (partition by scene_id, fid order by n desc, label_int) as rn from c) select scene_id, fid, label_int as label from w where rn = 1")
def a16(spark, sf):
    return mesh.face_votes(_faces(spark, sf), _verts(spark, sf))


@query("a16_vertex_votes", f"with v as (select scene_id, fid, plane_id, unnest([v0, v1, v2]) as vid from {FACES} f), c as (select scene_id, vid, plane_id, count(*) as n, min(fid) as first from v group by all), w as (select *, row_number() over (partition by scene_id, vid order by n desc, first) as rn from c) select scene_id, vid, plane_id as label from w where rn = 1")
def a16b(spark, sf):
    return mesh.vertex_votes(_faces(spark, sf), "plane_id")


@query("a17_rebuilt_planes", f"with {_SH}, c as (select scene_id, plane_id, label_int, count(*) as n, sum(area) as area from sh where plane_id >= 0 group by all), w as (select *, row_number() over (partition by scene_id, plane_id order by n desc, label_int) as rn, sum(n) over (partition by scene_id, plane_id) as faces, sum(area) over (partition by scene_id, plane_id) as total from c) select scene_id, plane_id, label_int, faces::bigint as faces, round(total, 6) as area, (row_number() over (partition by scene_id order by total desc, plane_id) - 1)::int as new_id from w where rn = 1")
def a17(spark, sf):
    return rounded(mesh.rebuilt(_shapes(spark, sf)))


@query("a18_patches", f"with {_SH} select scene_id, plane_id, list_sort(list(fid))::varchar as faces, round(sum(area), 6) as area from sh where plane_id >= 0 group by all")
def a18(spark, sf):
    patches = _shapes(spark, sf).where("plane_id >= 0").groupBy("scene_id", "plane_id").agg(F.sort_array(F.collect_list("fid")).alias("f"), F.sum("area").alias("area"))
    return rounded(patches.select("scene_id", "plane_id", F.concat(F.lit("["), F.array_join(F.col("f").cast("array<string>"), ", "), F.lit("]")).alias("faces"), "area"))


@query("w07_first_wins", f"with w as (select *, row_number() over (partition by scene_id, fid order by area desc, plane_id) as rn from {sql('outlines')} o) select scene_id, fid, plane_id as by_plane, area from w where rn = 1")
def w07(spark, sf):
    claims = view(spark, sf, "outlines").select("scene_id", "fid", F.col("plane_id").alias("by"), F.col("area").alias("size"))
    return mesh.first_wins(claims).select("scene_id", "fid", F.col("by").alias("by_plane"), F.col("size").alias("area"))


@query("w08_last_wins", f"with w as (select *, row_number() over (partition by scene_id, fid order by area, plane_id desc) as rn from {sql('outlines')} o) select scene_id, fid, plane_id as by_plane, area from w where rn = 1")
def w08(spark, sf):
    claims = view(spark, sf, "outlines").select("scene_id", "fid", F.col("plane_id").alias("by"), F.col("area").alias("size"))
    return mesh.first_wins(claims, largest=False).select("scene_id", "fid", F.col("by").alias("by_plane"), F.col("size").alias("area"))


@query("w10_local_consensus", f"with {_ADJ} select adj.scene_id, a.plane_id, f1 as fid, count(*) as neighbours from adj join {FACES} a on a.scene_id = adj.scene_id and a.fid = f1 join {FACES} b on b.scene_id = adj.scene_id and b.fid = f2 where a.plane_id = b.plane_id group by all having count(*) >= 2")
def w10(spark, sf):
    f = _faces(spark, sf)
    return mesh.consensus(f, mesh.adjacency(f), 2, ["plane_id"])


@query("w11_smoothed_normals", f"with {_SH}, {_ADJ}, m as (select adj.scene_id, f1 as fid, sum(b.nx*b.area)/sum(b.area) as mx, sum(b.ny*b.area)/sum(b.area) as my, sum(b.nz*b.area)/sum(b.area) as mz from adj join sh b on b.scene_id = adj.scene_id and b.fid = f2 group by all), x as (select sh.scene_id, sh.fid, 0.5*nx + 0.5*mx as a, 0.5*ny + 0.5*my as b, 0.5*nz + 0.5*mz as c from sh join m using (scene_id, fid)) select scene_id, fid, round(a/sqrt(a*a+b*b+c*c), 6) + 0.0 as sx, round(b/sqrt(a*a+b*b+c*c), 6) + 0.0 as sy, round(c/sqrt(a*a+b*b+c*c), 6) + 0.0 as sz from x")
def w11(spark, sf):
    return rounded(mesh.smoothed(_shapes(spark, sf), mesh.adjacency(_faces(spark, sf))))


@query("u07_distinct_vertices", f"select distinct scene_id, plane_id, unnest([v0, v1, v2]) as vid from {FACES} f")
def u07(spark, sf):
    return _faces(spark, sf).select("scene_id", "plane_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()


@query("g03_subset_components", f"with recursive {_ADJ}, e as (select adj.scene_id, f1, f2 from adj join {FACES} a on a.scene_id = adj.scene_id and a.fid = f1 and a.plane_id = 1 join {FACES} b on b.scene_id = adj.scene_id and b.fid = f2 and b.plane_id = 1), r as (select scene_id, fid as x, fid as y from {FACES} f where plane_id = 1 union select r.scene_id, r.x, e.f2 from r join e on e.scene_id = r.scene_id and e.f1 = r.y) select scene_id, x as fid, min(y) as component from r group by all")
def g03(spark, sf):
    f = _faces(spark, sf).where("plane_id = 1")
    near = mesh.adjacency(_faces(spark, sf))
    inside = near.join(f.select("scene_id", F.col("fid").alias("f1")), ["scene_id", "f1"], "left_semi").join(f.select("scene_id", F.col("fid").alias("f2")), ["scene_id", "f2"], "left_semi")
    return graph.components(f, inside, ["scene_id"], "fid", "f1", "f2")


@query("j23_small_face_claim", f"with {_SH}, s as (select * from sh where plane_id = -1), p as (select * from (values (1, 0.0, 0.0, 1.0, -0.3), (2, 0.0, 0.0, 1.0, -0.6)) t(by_plane, a, b, c, d)), m as (select scene_id, fid, by_plane, abs(cz * c + d) as far from s, p where abs(nz) >= {cos(radians(50.0))!r} and abs(cz * c + d) <= 0.8), w as (select *, row_number() over (partition by scene_id, fid order by far, by_plane) as rn from m) select scene_id, fid, by_plane as claimed_by, round(far, 6) as distance from w where rn = 1")
def j23(spark, sf):
    shapes = _shapes(spark, sf)
    made = spark.createDataFrame([(1, 0.0, 0.0, 1.0, -0.3), (2, 0.0, 0.0, 1.0, -0.6)], "plane_id int, a double, b double, c double, d double")
    pl = shapes.select("scene_id", "label_int").distinct().crossJoin(F.broadcast(made))
    return rounded(mesh.nearest_plane(shapes.where("plane_id = -1"), pl, 50.0, 0.8))


def _camera_faces(shapes):
    """The mesh seen from below its first corner: moved in front of the camera."""
    moved = {f"{a}{k}": F.col(f"{a}{k}") + off for a, off in (("x", -2.5), ("y", -2.5), ("z", 6.0)) for k in range(3)}
    return shapes.withColumns(moved)


_RAYS = "(select cast(n_nationkey as bigint) as scene_id, a.i as v, b.i as u from nation, (select unnest(range(24))::int as i) a, (select unnest(range(32))::int as i) b)"


@query("j21_ray_cast", f"""with {_SH}, t as (select scene_id, fid, label_int, x0-2.5 as x0, y0-2.5 as y0, z0+6 as z0, x1-2.5 as x1, y1-2.5 as y1, z1+6 as z1, x2-2.5 as x2, y2-2.5 as y2, z2+6 as z2 from sh),
    m as (select r.scene_id, r.v, r.u, t.fid, t.label_int, (r.u - 15.5) / 40.0 as dx, (r.v - 11.5) / 40.0 as dy, x0, y0, z0, x1-x0 as ex, y1-y0 as ey, z1-z0 as ez, x2-x0 as gx, y2-y0 as gy, z2-z0 as gz from {_RAYS} r join t using (scene_id)),
    h as (select *, dy*gz - gy as hx, gx - dx*gz as hy, dx*gy - dy*gx as hz from m), d as (select *, ex*hx + ey*hy + ez*hz as det, -y0*ez + z0*ey as qx, -z0*ex + x0*ez as qy, -x0*ey + y0*ex as qz from h),
    b as (select *, (-x0*hx - y0*hy - z0*hz) / det as bu, (dx*qx + dy*qy + qz) / det as bv, (gx*qx + gy*qy + gz*qz) / det as tt from d where abs(det) > 1e-12),
    k as (select *, row_number() over (partition by scene_id, v, u order by round(tt, 9), fid) as rn, min(tt) over (partition by scene_id, v, u) as z from b where bu >= -1e-9 and bv >= -1e-9 and bu + bv <= 1 + 1e-9 and tt > 1e-6) select scene_id, v, u, fid, label_int, round(z, 6) as z from k where rn = 1""")
def j21(spark, sf):
    rays = spark.range(24 * 32).select(F.floor(F.col("id") / 32).cast("int").alias("v"), (F.col("id") % 32).cast("int").alias("u"))
    scenes = view(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("scene_id"))
    grid = scenes.crossJoin(F.broadcast(rays))
    return rounded(raycast.nearest_hits(grid, _camera_faces(_shapes(spark, sf)), G.Pinhole(40.0, 40.0, 15.5, 11.5)))


@query("g04_region_growing")
def g04(spark, sf):
    f = _faces(spark, sf)
    return kernels.grow_regions(_shapes(spark, sf), mesh.adjacency(f), 8.0, 0.05)
