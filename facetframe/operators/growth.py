"""Plane extraction on meshes and segment merging, as rounds of joins and aggregations.

Each step is a DataFrame operation over all scenes and labels at once; only the order-dependent growth of regions is a
kernel (``kernels.grow_regions``). Rounds end at a fixpoint or at a given number and are cut by written tables.
"""

from __future__ import annotations

from math import cos, radians

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..params import Extraction
from ..session import ship
from . import graph, kernels, mesh, planes
from .joins import bridged_pairs

PATCH = ["scene_id", "label_int", "patch"]


def corner_points(faces: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each corner of each face."""
    corner = F.array(*[F.struct(*[F.col(f"{a}{k}").alias(a) for a in "xyz"]) for k in range(3)])
    return faces.select(*keys, F.explode(corner).alias("p")).select(*keys, "p.x", "p.y", "p.z")


def patch_planes(patches: DataFrame) -> DataFrame:
    """Least-squares plane, faces and area of each patch of faces with corners."""
    fits = planes.fit(corner_points(patches, PATCH), PATCH).select(*PATCH, "a", "b", "c", "d", "rms")
    return fits.join(patches.groupBy(*PATCH).agg(F.count("*").alias("faces"), F.sum("area").alias("area")), PATCH)


def merge_pairs(patches: DataFrame, fits: DataFrame, degrees: float, distance: float, share: float = 0.85) -> DataFrame:
    """Pairs of a label's patches whose normals agree and whose corners are near each other's planes both ways."""
    side = lambda k: fits.select("scene_id", "label_int", F.col("patch").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "abcd"])
    met = side("p").join(side("q"), ["scene_id", "label_int"]).where("p < q")
    dots = G.dot([F.col(f"p{c}") for c in "abc"], [F.col(f"q{c}") for c in "abc"])
    met = met.where(F.abs(dots) >= cos(radians(degrees)))
    both = met.select("scene_id", "label_int", "p", "q", F.explode(F.array(*[F.struct(F.col(i).alias("patch"), *[F.col(f"{j}{c}").alias(c) for c in "abcd"]) for i, j in (("p", "q"), ("q", "p"))])).alias("s")).select("scene_id", "label_int", "p", "q", "s.*")
    far = both.join(corner_points(patches, PATCH), PATCH).groupBy("scene_id", "label_int", "p", "q", "patch").agg(F.percentile(planes.residual(), F.lit(share)).alias("far"))
    return far.groupBy("scene_id", "label_int", "p", "q").agg(F.max("far").alias("far")).where(F.col("far") <= distance)


def merged(patches: DataFrame, degrees: float, distance: float, rounds: int = 10) -> DataFrame:
    """Patches of a label joined while pairs agree; refitted after each round, until no pair does. Every patch takes its smallest number."""
    for _ in range(rounds):
        patches = graph.written(patches)
        pairs = graph.written(merge_pairs(patches, patch_planes(patches), degrees, distance))
        if pairs.isEmpty():
            break
        keys = ["scene_id", "label_int"]
        found = graph.components(patches, pairs, keys, "patch", "p", "q")
        patches = patches.join(found, PATCH).withColumn("patch", F.col("component")).drop("component")
    return patches


def swept_patches(faces: DataFrame, fits: DataFrame, near: DataFrame, degrees: float, distance: float, share: float, consensus: int) -> DataFrame:
    """Faces that each plane sweeps, with enough neighbours swept by the same plane; the larger plane keeps a contested face."""
    named = fits.withColumnRenamed("patch", "plane_id")
    got = mesh.swept(faces, named, degrees, distance, share)
    held = mesh.consensus(got.select("scene_id", "fid", F.col("by").alias("plane")), near, consensus, ["plane"]).select("scene_id", "fid", F.col("plane").alias("by"))
    claims = held.join(fits.select("scene_id", F.col("patch").alias("by"), F.col("area").alias("size")), ["scene_id", "by"])
    return mesh.first_wins(claims).select("scene_id", "fid", F.col("by").alias("patch"))


def extract(faces: DataFrame, near: DataFrame, p: Extraction) -> DataFrame:
    """scene_id, fid, label_int and patch of the faces that planes were found for: growth, acceptance, merge, then saturation rounds."""
    grown = kernels.grow_regions(faces, near, p.grow_degrees, p.grow_distance, p.dihedral, p.refit_every).where("region >= 0")
    start = faces.join(grown.select("scene_id", "fid", F.col("region").alias("patch")), ["scene_id", "fid"])
    sizes = start.groupBy(*PATCH).agg(F.count("*").alias("n"), F.sum("area").alias("s")).where((F.col("n") >= p.least_faces) & (F.col("s") >= p.least_area))
    numbered = sizes.select(*PATCH, F.row_number().over(Window.partitionBy("scene_id").orderBy("label_int", "patch")).alias("number"))
    start = start.join(numbered, PATCH).withColumn("patch", F.col("number")).drop("number")
    patches = merged(start, p.merge_degrees, p.merge_distance)
    for _ in range(p.rounds):
        fits = patch_planes(patches)
        wide = swept_patches(faces, fits, near, p.sweep_degrees, p.sweep_distance, p.sweep_share, 1)
        kept = faces.join(wide, ["scene_id", "fid"])
        patches = merged(kept, p.merge_degrees, p.merge_distance)
    return patches.select("scene_id", "fid", "label_int", "patch")


def attach(faces: DataFrame, near: DataFrame, owned: DataFrame, fits: DataFrame, degrees: float, distance: float, share: float) -> DataFrame:
    """One relaxed round: free faces that touch a plane of their label and lie in its gates join the nearest one, if their area is at
    most ``share`` of the plane's."""
    free = faces.join(owned.select("scene_id", "fid"), ["scene_id", "fid"], "left_anti")
    beside = near.join(owned.select("scene_id", F.col("fid").alias("f2"), F.col("patch").alias("by")), ["scene_id", "f2"]).select("scene_id", F.col("f1").alias("fid"), "by").distinct()
    met = free.join(beside, ["scene_id", "fid"]).join(fits.select("scene_id", "label_int", F.col("patch").alias("by"), *[F.col(c).alias(f"p{c}") for c in "abcd"], F.col("area").alias("size")), ["scene_id", "label_int", "by"])
    n = [F.col(f"p{c}") for c in "abc"]
    far = F.abs(G.dot([F.col(f"c{a}") for a in "xyz"], n) + F.col("pd"))
    met = met.withColumn("far", far).where((F.abs(G.dot([F.col(f"n{a}") for a in "xyz"], n)) >= cos(radians(degrees))) & (F.col("far") <= distance) & (F.col("area") <= share * F.col("size")))
    return met.groupBy("scene_id", "fid").agg(F.min_by("by", F.struct("far", "by")).alias("patch"))


def split_by_median(faces: DataFrame, keys: list[str], part: str = "part", most: int = 50_000) -> DataFrame:
    """Parts of more than ``most`` faces cut at the median of the axis on which their centroids spread most."""
    stats = faces.groupBy(*keys, part).agg(F.count("*").alias("_n"), *[F.var_pop(f"c{a}").alias(f"_v{a}") for a in "xyz"], *[F.percentile(f"c{a}", F.lit(0.5)).alias(f"_m{a}") for a in "xyz"]).where(F.col("_n") > most)
    axis = F.when((F.col("_vx") >= F.col("_vy")) & (F.col("_vx") >= F.col("_vz")), "x").when(F.col("_vy") >= F.col("_vz"), "y").otherwise("z")
    at = lambda p: F.when(F.col("_axis") == "x", F.col(f"{p}x")).when(F.col("_axis") == "y", F.col(f"{p}y")).otherwise(F.col(f"{p}z"))
    cut = stats.withColumn("_axis", axis).select(*keys, part, "_axis", at("_m").alias("_cut"))
    side = F.when(F.col("_cut").isNull(), F.col(part)).otherwise(2 * F.col(part) + F.when(at("c") > F.col("_cut"), 1).otherwise(0))
    return faces.join(cut, [*keys, part], "left").withColumn("_side", side).drop(part, "_axis", "_cut").withColumnRenamed("_side", part)


def cross_distance(points: DataFrame, fits: DataFrame, pairs: DataFrame, keys: list[str], share: float) -> DataFrame:
    """``pairs`` (keys, a, b) with ``far``: the larger of the two quantiles of one segment's points to the other's plane."""
    way = F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("b").alias("other")), F.struct(F.col("b").alias("label"), F.col("a").alias("other"))))
    plane = fits.select(*keys, F.col("label").alias("other"), *[F.col(c).alias(f"p{c}") for c in "abcd"])
    both = pairs.select(*keys, F.col("a").alias("a_id"), F.col("b").alias("b_id"), way.alias("w")).select(*keys, "a_id", "b_id", "w.label", "w.other").join(plane, [*keys, "other"])
    far = F.abs(F.col("pa") * F.col("x") + F.col("pb") * F.col("y") + F.col("pc") * F.col("z") + F.col("pd"))
    each = both.join(points.select(*keys, "label", "x", "y", "z"), [*keys, "label"]).groupBy(*keys, "a_id", "b_id", "label").agg(F.percentile(far, F.lit(share)).alias("far"))
    return each.groupBy(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b")).agg(F.max("far").alias("far"))


def segment_pairs(fits: DataFrame, keys: list[str], degrees: float, offset: float, signed: bool = True, among: DataFrame | None = None) -> DataFrame:
    """Pairs (a < b) of a frame's segments whose planes agree in angle and offset; ``signed`` lets opposite normals agree.

    Only pairs in ``among`` (keys, a, b) are looked at, if it is given; else planes meet in cells of the offset.
    """
    plane = lambda k: fits.select(*keys, F.col("label").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "abcd"])
    if among is not None:
        met = among.select(*keys, F.col("a").alias("p"), F.col("b").alias("q")).join(plane("p"), [*keys, "p"]).join(plane("q"), [*keys, "q"])
    else:  # offsets, of either sign, are at most one cell apart
        left = plane("p").withColumn("_cell", F.floor(F.abs("pd") / offset))
        right = plane("q").withColumn("_cell", F.explode(F.array(*[F.floor(F.abs("qd") / offset) + k for k in (-1, 0, 1)])))
        met = left.join(right, [*keys, "_cell"]).where("p < q")
    met = met.withColumn("dots", G.dot([F.col(f"p{c}") for c in "abc"], [F.col(f"q{c}") for c in "abc"]))
    gap: Column = planes.signed_offset(F.col("dots"), F.col("pd"), F.col("qd")) if signed else F.abs(F.col("pd") - F.col("qd"))
    return met.where((F.abs("dots") >= cos(radians(degrees))) & (gap <= offset)).select(*keys, F.col("p").alias("a"), F.col("q").alias("b"), gap.alias("gap"))


def top_labels(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` largest segments of a frame, before pairs are made."""
    sizes = points.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return sizes.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "label"))).where(F.col("_rn") <= k).drop("_rn")


def merge_segments(points: DataFrame, keys: list[str], degrees: float = 5.0, offset: float = 0.05, share: float = 0.2, k: int = 20, rounds: int = 20, raster: DataFrame | None = None, gap: int = 20, near: float = 0.2, least: int = 1, sample: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """Iterated merge of a frame's ``k`` largest segments: planes, adjacent pairs that are coplanar by angle, offset and cross distance, components, refit.

    Segments are adjacent if they touch once background within ``gap`` pixels is taken up (``raster``: keys, v, u, label) or have points
    within ``near`` of each other, as ``adjacent`` says. A component takes the label of its largest member. Segments of fewer than ``least``
    points have no plane. Returns label to merged label and the log of the pairs of each round. Ends when a round merges nothing.
    """
    chosen = top_labels(points, keys, k).where(F.col("n") >= max(least, 3)).select(*keys, "label")
    every = points.select(*keys, "label").distinct()
    points = graph.written(points.join(chosen, [*keys, "label"], "left_semi"))
    labels = graph.written(every.withColumn("merged", F.col("label")))
    log = None
    for r in range(rounds):
        now = points.join(labels, [*keys, "label"]).select(*keys, F.col("merged").alias("label"), "x", "y", "z")
        sizes = now.groupBy(*keys, F.col("label").alias("at")).agg(F.count("*").alias("n"))
        seen = None
        if raster is not None:
            seen = raster.select(*keys, "v", "u", "label").join(labels, [*keys, "label"], "left").select(*keys, "v", "u", F.coalesce("merged", "label").alias("label"))
        touching = adjacent(now, keys, near, seen, gap, sample)
        fits = graph.written(planes.fit(now, [*keys, "label"]))
        pairs = segment_pairs(fits, keys, degrees, offset, among=touching)
        near_by = graph.written(cross_distance(now, fits, pairs, keys, share).withColumns({"round": F.lit(r), "accepted": F.col("far") <= 2 * offset}))
        log = near_by if log is None else log.union(near_by)
        good = near_by.where("accepted")
        if good.isEmpty():
            break
        found = graph.components(labels.select(*keys, F.col("merged").alias("at")).distinct(), good, keys, "at", "a", "b").join(sizes, [*keys, "at"])
        largest = found.groupBy(*keys, "component").agg(F.max_by("at", F.struct("n", -F.col("at"))).alias("largest"))
        found = found.join(largest, [*keys, "component"]).select(*keys, F.col("at").alias("merged"), "largest")
        labels = graph.written(labels.join(found, [*keys, "merged"], "left").select(*keys, "label", F.coalesce("largest", "merged").alias("merged")))
    return labels, log


def sampled(points: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``most`` points of each segment, in the order of a hash of their coordinates: the same ones however the rows are dealt."""
    w = Window.partitionBy(*keys, "label").orderBy(F.xxhash64("x", "y", "z"), "x", "y", "z")
    return points.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def adjacent(points: DataFrame, keys: list[str], near: float, raster: DataFrame | None = None, gap: int = 20, sample: int | None = 500) -> DataFrame:
    """Pairs (a < b) of segments that touch in the raster, background within ``gap`` pixels taken up, or are ``near`` in space.

    Distances are between ``sample`` points a segment, so a cell holds as many of each at most; all points with None. Labels of the
    raster without points have no pairs. Without a raster distances alone decide.
    """
    close = near_in_space(points if sample is None else sampled(points, keys, sample), keys, near)
    if raster is None:
        return close
    known = points.select(*keys, "label").distinct()
    touch = bridged_pairs(raster.select(*keys, "v", "u", "label"), "label", gap, keys)
    for end in "ab":
        touch = touch.join(known.withColumnRenamed("label", end), [*keys, end], "left_semi")
    return close.union(touch.select(*close.columns)).distinct()


def _near_labels(keys: list[str], distance: float):
    """A frame's pairs of labels (a < b) with points within ``distance``: cells of a quarter of it and their lists of labels tell most
    pairs apart or together, the points of what cells are left tell the rest."""
    width, reach = distance / 4, 5
    steps = [(i, j, k) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) for k in range(-reach, reach + 1) if (i, j, k) >= (0, 0, 0)]
    gap = lambda s, by: width * np.sqrt(sum(max(abs(x) + by, 0) ** 2 for x in s))
    steps = sorted((gap(s, 1) > distance * (1 - 1e-9), *s) for s in steps if gap(s, -1) <= distance * (1 + 1e-9))

    def frame(rows: pa.Table) -> pa.Table:
        p = np.stack([rows.column(c).to_numpy() for c in "xyz"], axis=1).astype(float)
        names, label = np.unique(rows.column("label").to_numpy(), return_inverse=True)
        good = np.isfinite(p).all(axis=1)
        p, label = p[good], label[good]
        met = np.eye(len(names), dtype=bool)
        if len(p) and len(names) > 1:
            at = np.floor(p / width).astype(np.int64)
            at -= at.min(axis=0) - reach
            size = at.max(axis=0) + reach + 1
            key = (at[:, 0] * size[1] + at[:, 1]) * size[2] + at[:, 2]
            order = np.lexsort((label, key))
            p, label, key = p[order], label[order], key[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (label[1:] != label[:-1])])
            last = np.r_[first[1:], len(key)]
            cell, own = key[first], label[first]
            for unsure, i, j, k in steps:
                if met.all():
                    break
                there = cell + (i * size[1] + j) * size[2] + k
                lo, hi = np.searchsorted(cell, there), np.searchsorted(cell, there, side="right")
                for turn in range(int((hi - lo).max(initial=0))):
                    x = np.flatnonzero(lo + turn < hi)
                    y = lo[x] + turn
                    new = ~met[own[x], own[y]]
                    x, y = x[new], y[new]
                    if not unsure:
                        met[own[x], own[y]] = met[own[y], own[x]] = True
                        continue
                    for s, t in zip(x, y, strict=True):
                        if met[own[s], own[t]]:
                            continue
                        q = p[first[t] : last[t]]
                        for c in range(first[s], last[s], 256):
                            d = p[c : min(c + 256, last[s]), None] - q[None]
                            if (np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]) <= distance).any():
                                met[own[s], own[t]] = met[own[t], own[s]] = True
                                break
        a, b = np.nonzero(np.triu(met, 1))
        ends = [pa.array(names[x], rows.schema.field("label").type) for x in (a, b)]
        return pa.table([pa.concat_arrays([rows.column(c).combine_chunks().slice(0, 1)] * len(a)) if len(a) else rows.column(c).combine_chunks().slice(0, 0) for c in keys] + ends, names=[*keys, "a", "b"])

    return frame


def near_in_space(points: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """Pairs of segments with points within ``distance``; a frame's points go to one task once."""
    ship(points.sparkSession)
    rows = points.select(*keys, "label", "x", "y", "z").where(F.col("label").isNotNull())
    kinds = dict(rows.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return rows.groupBy(*keys).applyInArrow(_near_labels(keys, distance), f"{head}, a {kinds['label']}, b {kinds['label']}")


def unit_offset_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares solution of a·x + b·y + c·z = 1 for each group, from the sums of its normal equations."""
    m = points.groupBy(*keys).agg(*[F.sum(F.col(i) * F.col(j)).alias(i + j) for i, j in ("xx", "yy", "zz", "xy", "xz", "yz")], *[F.sum(c).alias(f"s{c}") for c in "xyz"])
    col = lambda n: F.col(n)
    rows = [[col("xx"), col("xy"), col("xz")], [col("xy"), col("yy"), col("yz")], [col("xz"), col("yz"), col("zz")]]
    right = [col("sx"), col("sy"), col("sz")]

    def det(m3: list[list[Column]]) -> Column:
        return G.dot(m3[0], G.cross(m3[1], m3[2]))

    m = m.withColumn("det", det(rows))
    solved = [det([[right[r] if c == k else rows[r][c] for c in range(3)] for r in range(3)]) / F.col("det") for k in range(3)]
    return m.select(*keys, *[F.when(F.abs("det") > 1e-12, s).alias(n) for s, n in zip(solved, "abc", strict=True)])


def merge_outdoor(points: DataFrame, fits: DataFrame, keys: list[str], cosine: float = 0.985, absolute: float = 0.1, relative: float = 0.02) -> DataFrame:
    """Pairs (a < b) of planes whose medians of distance both ways are below a tolerance that grows with their mean offset."""
    side = lambda k: fits.select(*keys, F.col("label").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "abcd"])
    dots = G.dot([F.col(f"p{c}") for c in "abc"], [F.col(f"q{c}") for c in "abc"])
    met = side("p").join(side("q"), keys).where("p < q").where(F.abs(dots) >= cosine).select(*keys, F.col("p").alias("a"), F.col("q").alias("b"), F.greatest(F.lit(absolute), relative * (F.col("pd") + F.col("qd")) / 2).alias("limit"))
    far = cross_distance(points, fits, met, keys, 0.5)
    return far.join(met, [*keys, "a", "b"]).where("far < limit").select(*keys, "a", "b", "far")


def outdoor_planes(pixels: DataFrame, keys: list[str], distance: float, cosine: float, iterations: int, least: int, most: int) -> DataFrame:
    """Planes of each class of a frame, found one after the other, then merged across: keys, idx and plane of each pixel taken.

    ``pixels``: keys, class_id, idx, x, y, z, nx, ny, nz.
    """
    found = graph.written(kernels.sequential_planes(pixels, [*keys, "class_id"], distance, cosine, iterations, least, most))
    named = found.withColumn("label", F.col("class_id") * 1000 + F.col("plane"))
    # a pixel's row is a few bits of its file: by that size all of them would be broadcast
    points = named.select(*keys, "idx", "label").hint("merge").join(pixels.select(*keys, "idx", "x", "y", "z"), [*keys, "idx"])
    fits = planes.fit(points, [*keys, "label"])
    pairs = graph.written(merge_outdoor(points, fits, keys))
    groups = graph.components(points.select(*keys, "label"), pairs, keys, "label", "a", "b")
    return points.join(groups.hint("merge"), [*keys, "label"]).select(*keys, "idx", F.col("component").alias("plane"))
