"""Triangle meshes as tables of vertices and faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def corners(faces: DataFrame, vertices: DataFrame, columns: list[str]) -> DataFrame:
    """Faces with ``columns`` of their three vertices as <column>0..2: exploded, joined once and gathered by face."""
    three = faces.select("scene_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid"))
    found = three.join(vertices.select("scene_id", "vid", *columns), ["scene_id", "vid"])
    wide = found.groupBy("scene_id", "fid").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for c in columns for k in range(3)])
    return faces.join(wide, ["scene_id", "fid"])


def shapes(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with corners, unit normal, centroid and area."""
    c = corners(faces, vertices, ["x", "y", "z"])
    p = [[F.col(f"{a}{k}") for a in "xyz"] for k in range(3)]
    n = G.cross([b - a for a, b in zip(p[0], p[1], strict=True)], [b - a for a, b in zip(p[0], p[2], strict=True)])
    c = c.withColumns({f"_{k}": x for k, x in zip("abc", n, strict=True)}).withColumn("area", G.norm(F.col("_a"), F.col("_b"), F.col("_c")) / 2)
    made = {f"n{a}": F.when(F.col("area") > 0, F.col(f"_{k}") / (2 * F.col("area"))).otherwise(0.0) for a, k in zip("xyz", "abc", strict=True)}
    made |= {f"c{a}": (F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2")) / 3 for a in "xyz"}
    return c.withColumns(made).drop("_a", "_b", "_c")


def edges(faces: DataFrame) -> DataFrame:
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return faces.select("scene_id", "fid", F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("e")).select("scene_id", "fid", "e.a", "e.b")


def adjacency(faces: DataFrame) -> DataFrame:
    """Pairs of faces that share an edge of exactly two faces, both directions. One grouping by edge, no self-join."""
    shared = edges(faces).groupBy("scene_id", "a", "b").agg(F.count("*").alias("n"), F.min("fid").alias("low"), F.max("fid").alias("high")).where("n = 2 and low <> high")
    pair = lambda a, b: F.struct(F.col(a).alias("f1"), F.col(b).alias("f2"))
    return shared.select("scene_id", F.explode(F.array(pair("low", "high"), pair("high", "low"))).alias("p")).select("scene_id", "p.f1", "p.f2").distinct()


def neighbour_labels(faces: DataFrame, label: str) -> DataFrame:
    """Pairs of unlike labels (both set) that meet at an edge."""
    near = adjacency(faces)
    of = lambda f, l: faces.select("scene_id", F.col("fid").alias(f), F.col(label).alias(l))  # noqa: E731, E741
    return near.join(of("f1", "s1"), ["scene_id", "f1"]).join(of("f2", "s2"), ["scene_id", "f2"]).where("s1 <> s2 and s1 <> -1 and s2 <> -1").select("scene_id", "s1", "s2").distinct()


def clean(faces: DataFrame) -> DataFrame:
    """Faces with three different vertices, none negative."""
    return faces.where("v0 <> v1 and v1 <> v2 and v0 <> v2 and least(v0, v1, v2) >= 0")


def fans(polygons: DataFrame) -> DataFrame:
    """Polygons (scene_id, pid, vids) to triangles around their first vertex."""
    rows = polygons.where(F.size("vids") >= 3).select("scene_id", "pid", "vids", F.explode(F.sequence(F.lit(1), F.size("vids") - 2)).alias("k"))
    at = lambda k: F.get("vids", k)
    return rows.select("scene_id", "pid", "k", at(F.lit(0)).alias("v0"), at(F.col("k")).alias("v1"), at(F.col("k") + 1).alias("v2"))


def face_votes(faces: DataFrame, vertices: DataFrame, label: str = "label_int") -> DataFrame:
    """A face's label by the majority of its vertices; ties go to the smallest."""
    three = faces.select("scene_id", "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid")).join(vertices.select("scene_id", "vid", F.col(label).alias("vote")), ["scene_id", "vid"])
    counts = three.groupBy("scene_id", "fid", "vote").agg(F.count("*").alias("n"))
    return counts.groupBy("scene_id", "fid").agg(F.max_by("vote", F.struct("n", -F.col("vote"))).alias("label"))


def vertex_votes(faces: DataFrame, label: str) -> DataFrame:
    """A vertex's label by the faces around it; ties go to the label whose first face comes first."""
    three = faces.select("scene_id", "fid", label, F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    counts = three.groupBy("scene_id", "vid", label).agg(F.count("*").alias("n"), F.min("fid").alias("first"))
    return counts.groupBy("scene_id", "vid").agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("label"))


def label_stats(shaped: DataFrame, label: str = "label_int") -> DataFrame:
    """Faces, area and distinct vertices of each label."""
    whole = shaped.groupBy("scene_id", label).agg(F.count("*").alias("faces"), F.sum("area").alias("area"))
    used = shaped.select("scene_id", label, F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct().groupBy("scene_id", label).agg(F.count("*").alias("vertices"))
    return whole.join(used, ["scene_id", label])


def legend(names: DataFrame, name: str) -> DataFrame:
    """Semantic names in order with an id from 0 and their number of rows."""
    counts = names.groupBy(name).agg(F.count("*").alias("face_count"))
    return counts.withColumn("semantic_id", F.row_number().over(Window.orderBy(name)) - 1)


def tiers(area: str, small: float = 1.0, normal: float = 10.0, big: float = 60.0) -> Column:
    a = F.col(area)
    return F.when(a < small, "small").when(a < normal, "normal").when(a < big, "big").otherwise("huge")


def consensus(faces: DataFrame, near: DataFrame, least: int, group: list[str]) -> DataFrame:
    """Members (group, fid) with ``least`` neighbours in their own group."""
    here = faces.select("scene_id", *group, F.col("fid").alias("f1"))
    there = faces.select("scene_id", *group, F.col("fid").alias("f2"))
    hits = here.join(near, ["scene_id", "f1"]).join(there, ["scene_id", *group, "f2"]).groupBy("scene_id", *group, "f1").agg(F.count("*").alias("neighbours"))
    return hits.where(F.col("neighbours") >= least).withColumnRenamed("f1", "fid")


def smoothed(shaped: DataFrame, near: DataFrame, weight: float = 0.5) -> DataFrame:
    """Normals mixed once with the area-weighted mean of their neighbours' and made unit again."""
    other = shaped.select("scene_id", F.col("fid").alias("f2"), *[(F.col(f"n{a}") * F.col("area")).alias(f"w{a}") for a in "xyz"], F.col("area").alias("w"))
    mean = near.join(other, ["scene_id", "f2"]).groupBy("scene_id", F.col("f1").alias("fid")).agg(*[(F.sum(f"w{a}") / F.sum("w")).alias(f"m{a}") for a in "xyz"])
    both = shaped.join(mean, ["scene_id", "fid"], "left")
    mixed = [F.coalesce((1 - weight) * F.col(f"n{a}") + weight * F.col(f"m{a}"), F.col(f"n{a}")) for a in "xyz"]
    return both.select("scene_id", "fid", *[c.alias(f"s{a}") for c, a in zip(G.unit(mixed), "xyz", strict=True)])


def swept(shaped: DataFrame, planes: DataFrame, degrees: float, distance: float, share: float = 1.0, gate: str = "kof3") -> DataFrame:
    """Faces (scene_id, label_int) within a plane's angle and distance; ``gate``: none, centroid or kof3.

    The angle is signed, as plane normals are oriented by d >= 0 and not by their faces.
    """
    from math import ceil, cos, radians

    met = shaped.join(planes.select("scene_id", "label_int", F.col("plane_id").alias("by"), *[F.col(c).alias(f"p{c}") for c in ("a", "b", "c", "d")]), ["scene_id", "label_int"])
    n = [F.col(f"p{c}") for c in "abc"]
    far = lambda k: F.abs(G.dot([F.col(f"{a}{k}") for a in "xyz"], n) + F.col("pd"))
    turned = G.dot([F.col(f"n{a}") for a in "xyz"], n)
    keep = (turned > 0) & (F.abs(turned) >= cos(radians(degrees)))
    if gate == "centroid":
        keep = keep & (F.abs(G.dot([F.col(f"c{a}") for a in "xyz"], n) + F.col("pd")) <= distance)
    elif gate == "kof3":
        keep = keep & (sum((F.when(far(k) <= distance, 1).otherwise(0) for k in range(3)), F.lit(0)) >= ceil(3 * share))
    return met.where(keep).select("scene_id", "fid", "label_int", "by")


def first_wins(claims: DataFrame, largest: bool = True) -> DataFrame:
    """One plane for each face from overlapping claims (scene_id, fid, by, size): the larger plane, or at a freeze the smaller."""
    order = [F.desc("size"), F.col("by")] if largest else [F.col("size"), F.desc("by")]
    return claims.withColumn("_rn", F.row_number().over(Window.partitionBy("scene_id", "fid").orderBy(*order))).where("_rn = 1").drop("_rn")


def rebuilt(shaped: DataFrame, plane: str = "plane_id") -> DataFrame:
    """Plane table of faces: numbered from 0 by area, with majority label, faces and area."""
    kept = shaped.where(F.col(plane) >= 0)
    votes = kept.groupBy("scene_id", plane, "label_int").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    whole = votes.groupBy("scene_id", plane).agg(F.max_by("label_int", F.struct("n", -F.col("label_int"))).alias("label_int"), F.sum("n").alias("faces"), F.sum("area").alias("area"))
    return whole.withColumn("new_id", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("area"), plane)) - 1)


def plane_mesh_faces(faces: DataFrame, vertices: DataFrame, plane: str) -> DataFrame:
    """Faces whose three vertices are of one plane."""
    return corners(faces, vertices, [plane]).where(f"{plane}0 = {plane}1 and {plane}1 = {plane}2 and {plane}0 <> -1")


def quality(shaped: DataFrame, planes: DataFrame, keys: list[str], inlier: float = 0.012) -> DataFrame:
    """Six measures of each plane over its faces: p95 residual and inlier share of distinct vertices, thickness, p95 angle of
    the faces, least width across and filled share."""
    n = [F.col(f"p{c}") for c in "abc"]
    named = planes.select(*keys, *[F.col(c).alias(f"p{c}") for c in ("a", "b", "c", "d")])
    e1, e2 = G.basis(n)
    corner = F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("vid"), *[F.col(f"{a}{k}").alias(a) for a in "xyz"]) for k in range(3)]))
    points = shaped.select(*keys, corner.alias("p")).select(*keys, "p.*").distinct().join(named, keys)
    xyz = [F.col(a) for a in "xyz"]
    points = points.withColumns({"signed": G.dot(xyz, n) + F.col("pd"), "t1": G.dot(xyz, e1), "t2": G.dot(xyz, e2)})
    spans = points.groupBy(*keys).agg(
        F.percentile(F.abs("signed"), F.lit(0.95)).alias("p95"), F.avg((F.abs("signed") <= inlier).cast("int")).alias("inlier_frac"), (F.max("signed") - F.min("signed")).alias("thickness"),
        (F.max("t1") - F.min("t1")).alias("w1"), (F.max("t2") - F.min("t2")).alias("w2"),
    )
    turned = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(G.dot([F.col(f"n{a}") for a in "xyz"], n)))))
    angles = shaped.join(named, keys).groupBy(*keys).agg(F.percentile(turned, F.lit(0.95)).alias("normal_p95_deg"), F.sum("area").alias("area"))
    return spans.join(angles, keys).select(*keys, "p95", "inlier_frac", "thickness", "normal_p95_deg", F.least("w1", "w2").alias("min_width"), (F.col("area") / F.greatest(F.col("w1") * F.col("w2"), F.lit(1e-9))).alias("fill"))


def accepted(p95: float = 0.03, inlier_frac: float = 0.8, thickness: float = 0.0192, degrees: float = 8.0, width: float = 0.06, fill: float = 0.18) -> Column:
    return (F.col("p95") <= p95) & (F.col("inlier_frac") >= inlier_frac) & (F.col("thickness") <= thickness) & (F.col("normal_p95_deg") <= degrees) & (F.col("min_width") >= width) & (F.col("fill") >= fill)


def nearest_plane(small: DataFrame, planes: DataFrame, degrees: float, distance: float) -> DataFrame:
    """Each small face (scene_id, fid, label_int, n, c) to the nearest compatible plane of its label; ties to the smaller id."""
    from math import cos, radians

    met = small.join(planes.select("scene_id", "label_int", F.col("plane_id").alias("by"), *[F.col(c).alias(f"p{c}") for c in ("a", "b", "c", "d")]), ["scene_id", "label_int"])
    n = [F.col(f"p{c}") for c in "abc"]
    far = F.abs(G.dot([F.col(f"c{a}") for a in "xyz"], n) + F.col("pd"))
    met = met.withColumn("far", far).where((F.abs(G.dot([F.col(f"n{a}") for a in "xyz"], n)) >= cos(radians(degrees))) & (F.col("far") <= distance))
    return met.groupBy("scene_id", "fid").agg(F.min_by("by", F.struct("far", "by")).alias("claimed_by"), F.min("far").alias("distance"))
