"""Nearest hits of pixel rays on triangles.

A scene's rays go to tiles of the image, and a triangle to the tiles that its projection touches, so rays meet only the triangles
that can cover them: an equi-join on (scene, tile) in place of a cross product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def nearest_hits(rays: DataFrame, triangles: DataFrame, camera: G.Pinhole, tile: int = 8, near: float = 1e-6) -> DataFrame:
    """scene_id, v, u with the nearest face, its label and z-depth (t of the unnormalised ray); pixels without a hit are left out.

    ``rays``: scene_id, v, u; ``triangles``: scene_id, fid, label_int and x0..z2 in camera space, wholly in front. Ties go
    to the smaller face. Möller-Trumbore in column expressions.
    """
    pu = [F.col(f"x{k}") / F.col(f"z{k}") * camera.fx + camera.cx for k in range(3)]
    pv = [F.col(f"y{k}") / F.col(f"z{k}") * camera.fy + camera.cy for k in range(3)]
    span = lambda c: F.sequence(F.floor(F.least(*c) / tile).cast("int"), F.floor((F.greatest(*c)) / tile).cast("int"))
    front = triangles.where(f"least(z0, z1, z2) > {near}")
    tiled = front.withColumn("tv", F.explode(span(pv))).withColumn("tu", F.explode(span(pu)))
    met = rays.withColumns({"tv": F.floor(F.col("v") / tile).cast("int"), "tu": F.floor(F.col("u") / tile).cast("int")}).join(tiled, ["scene_id", "tv", "tu"])
    d = [(F.col("u") - camera.cx) / camera.fx, (F.col("v") - camera.cy) / camera.fy, F.lit(1.0)]
    p = [[F.col(f"{a}{k}") for a in "xyz"] for k in range(3)]
    e1, e2 = ([b - a for a, b in zip(p[0], p[k], strict=True)] for k in (1, 2))
    h = G.cross(d, e2)
    det = G.dot(e1, h)
    s = [-a for a in p[0]]
    q = G.cross(s, e1)
    met = met.withColumns({"det": det, "bu": G.dot(s, h) / det, "bv": G.dot(d, q) / det, "t": G.dot(e2, q) / det})
    hit = met.where((F.abs("det") > 1e-12) & (F.col("bu") >= -1e-9) & (F.col("bv") >= -1e-9) & (F.col("bu") + F.col("bv") <= 1 + 1e-9) & (F.col("t") > near))
    return hit.groupBy("scene_id", "v", "u").agg(F.min_by("fid", F.struct(F.round("t", 9), "fid")).alias("fid"), F.min_by("label_int", F.struct(F.round("t", 9), "fid")).alias("label_int"), F.min("t").alias("z"))
