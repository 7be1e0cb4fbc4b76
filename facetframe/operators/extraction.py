"""The label pass on meshes: growth, sweeps to a fixpoint, conditional merges and saturation, for all labels of all scenes at once.

Patches are rows (scene_id, label_int, patch, fid), their planes (scene_id, label_int, patch, a, b, c, d). What depends on the order
of a label's regions is written as a fixpoint over who owns a face: each region looks at the faces that earlier ones own, all regions
in parallel, until no owner changes. By induction over the order that is the result of taking them one after the other.
"""

from __future__ import annotations

from math import ceil, cos, radians, sin

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..params import LabelPass, Quality, Tiers
from ..session import ship
from . import graph, kernels, mesh
from .graph import written

LABEL = ["scene_id", "label_int"]
PATCH = [*LABEL, "patch"]
_ABC = ["a", "b", "c"]


def _normal(prefix: str = "n") -> list[Column]:
    return [F.col(f"{prefix}{a}") for a in "xyz"]


def _cells(n: list[Column], degrees: float, around: bool) -> list[Column]:
    """Cells of a grid over normals, as wide as the chord of ``degrees``; ``around`` gives the neighbours too, as one array each."""
    width = max(2 * sin(radians(degrees) / 2), 1e-3)
    own = [F.floor(c / width) for c in n]
    return [F.array(c - 1, c, c + 1) if around else c for c in own]


def _by_normal(left: DataFrame, right: DataFrame, keys: list[str], degrees: float) -> DataFrame:
    """Rows of both sides with equal keys whose normals (nx, ny, nz; a, b, c) are in neighbouring cells: all within ``degrees`` and some more."""
    own = left.withColumns({f"_c{k}": c for k, c in enumerate(_cells(_normal(), degrees, False))})
    wide = right.withColumns({f"_w{k}": c for k, c in enumerate(_cells([F.col(c) for c in _ABC], degrees, True))})
    for k in range(3):
        wide = wide.withColumn(f"_c{k}", F.explode(f"_w{k}")).drop(f"_w{k}")
    return own.join(wide, [*keys, "_c0", "_c1", "_c2"]).drop("_c0", "_c1", "_c2")


def sweep(faces: DataFrame, planes: DataFrame, keys: list[str], degrees: float, distance: float, share: float, gate: str = "kof3") -> DataFrame:
    """(keys, fid) of a label's faces in each plane's gates: normals within ``degrees``, by sign, and ``share`` of the corners near.

    Faces and planes meet in cells of their normals, so a face is held against planes of about its own direction only.
    """
    met = _by_normal(faces, planes.select(*keys, *_ABC, "d"), LABEL, degrees)
    n = [F.col(c) for c in _ABC]
    far = lambda p: F.abs(G.dot(p, n) + F.col("d"))
    turned = G.dot(_normal(), n)
    keep = (turned > 0) & (turned >= cos(radians(degrees)))
    if gate == "centroid":
        keep = keep & (far([F.col(f"c{a}") for a in "xyz"]) <= distance)
    elif gate == "kof3":
        near = [F.when(far([F.col(f"{a}{k}") for a in "xyz"]) <= distance, 1).otherwise(0) for k in range(3)]
        keep = keep & (near[0] + near[1] + near[2] >= ceil(3 * share))
    return met.where(keep).select(*keys, "fid")


def judged(members: DataFrame, faces: DataFrame, keys: list[str], q: Quality) -> DataFrame:
    """Huber plane over the distinct vertices of each group of faces (keys, fid): keys, plane, faces, area and ``ok``, its six gates."""
    shaped = written(members.join(faces.drop("label_int"), ["scene_id", "fid"]))
    corner = F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("vid"), *[F.col(f"{a}{k}").alias(a) for a in "xyz"]) for k in range(3)]))
    points = shaped.select(*keys, corner.alias("p")).select(*keys, "p.*").distinct()
    fits = written(kernels.huber_fits(points, keys))
    measured = mesh.quality(shaped, fits, keys, q.inlier_distance)
    ok = mesh.accepted(q.p95, q.inlier_frac, q.thickness, q.degrees, q.width, q.fill)
    sizes = shaped.groupBy(*keys).agg(F.count("*").alias("faces"), F.sum("area").alias("area"))
    return fits.select(*keys, *_ABC, "d").join(measured.select(*keys, ok.alias("ok")), keys).join(sizes, keys)


def agreeing(swept: DataFrame, near: DataFrame, least: int, keys: list[str]) -> DataFrame:
    """(keys, fid) of swept faces with ``least`` neighbours that their plane has swept too."""
    return mesh.consensus(swept, near, least, [k for k in keys if k != "scene_id"]).select(*keys, "fid")


def seed_run(members: DataFrame, planes: DataFrame, faces: DataFrame, seeds: DataFrame, gap: float) -> DataFrame:
    """Of each region the run of centroid offsets, parted by gaps of more than ``gap``, that has most seed faces; of ties the lowest.

    A session window in space: offsets are ordered within their region and a run opens where the step is wider.
    """
    at = G.dot([F.col(f"c{a}") for a in "xyz"], [F.col(c) for c in _ABC]) + F.col("d")
    placed = members.join(faces.select("scene_id", "fid", "cx", "cy", "cz"), ["scene_id", "fid"]).join(planes.select(*PATCH, *_ABC, "d"), PATCH).select(*PATCH, "fid", at.alias("_t"))
    own = Window.partitionBy(*PATCH).orderBy("_t", "fid")
    opened = placed.withColumn("_open", F.when(F.col("_t") - F.lag("_t").over(own) > gap, 1).otherwise(0))
    runs = opened.withColumn("_run", F.sum("_open").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    met = runs.join(seeds.select(*PATCH, "fid", F.lit(1).alias("_seed")), [*PATCH, "fid"], "left")
    best = met.groupBy(*PATCH, "_run").agg(F.count("_seed").alias("_n")).groupBy(*PATCH).agg(F.min_by("_run", F.struct(-F.col("_n"), F.col("_run"))).alias("_run"))
    return met.join(best, [*PATCH, "_run"]).select(*PATCH, "fid")


def swept_to_fixpoint(seeds: DataFrame, first: DataFrame, owners: DataFrame | None, faces: DataFrame, near: DataFrame, p: LabelPass) -> tuple[DataFrame, DataFrame]:
    """Regions swept and refitted until they no longer grow by ``em_growth`` or fail a gate: their members and planes.

    Faces that an earlier region owns (``owners``: scene_id, label_int, fid, by) are not swept. A region's first sweep counts as no
    growth, so with a positive ``em_growth`` there is one. A sweep whose plane fails leaves the region as it was.
    """
    g = p.growth
    members, planes = seeds.join(first.select(*PATCH), PATCH, "left_semi"), first.select(*PATCH, *_ABC, "d")
    done_members = done_planes = None
    before = planes.select(*PATCH, F.lit(0).cast("long").alias("size"))
    for r in range(max(1, p.em_rounds)):
        got = sweep(faces, planes, PATCH, g.sweep_degrees, g.sweep_distance, g.sweep_share)
        if owners is not None:
            got = got.join(owners, [*LABEL, "fid"], "left").where(F.col("by").isNull() | (F.col("by") >= F.col("patch"))).select(*PATCH, "fid")
        held = agreeing(written(got), near, p.consensus, PATCH)
        union = members.select(*PATCH, "fid").union(held).distinct()
        if p.clusters:
            union = seed_run(union, planes, faces, seeds, p.gap)
        union = written(union)
        verdict = written(judged(union, faces, PATCH, p.quality))
        grown = verdict.where("ok").join(before, PATCH).withColumn("more", F.when(F.col("size") == 0, 0.0).otherwise((F.col("faces") - F.col("size")) / F.col("size")))
        good = grown.select(*PATCH)
        failed = planes.join(good, PATCH, "left_anti")
        ended = grown.where(F.lit(r + 1 == max(1, p.em_rounds)) | (F.col("more") < p.em_growth))
        parts = [members.join(failed.select(*PATCH), PATCH, "left_semi").select(*PATCH, "fid").union(union.join(ended.select(*PATCH), PATCH, "left_semi").select(*PATCH, "fid")), failed.union(ended.select(*PATCH, *_ABC, "d"))]
        done_members, done_planes = (parts[0], parts[1]) if done_members is None else (done_members.union(parts[0]), done_planes.union(parts[1]))
        going = written(grown.join(ended.select(*PATCH), PATCH, "left_anti"))
        if going.isEmpty():
            break
        members, planes, before = union.join(going.select(*PATCH), PATCH, "left_semi"), going.select(*PATCH, *_ABC, "d"), going.select(*PATCH, F.col("faces").alias("size"))
    return written(done_members), written(done_planes)


def _differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys for which two tables of distinct rows differ."""
    both = a.withColumn("_side", F.lit(1)).union(b.select(*a.columns).withColumn("_side", F.lit(2)))
    return both.groupBy(*a.columns).agg(F.count("*").alias("_n")).where("_n = 1").select(*keys).distinct()


def label_regions(faces: DataFrame, near: DataFrame, p: LabelPass) -> tuple[DataFrame, DataFrame]:
    """Growth, acceptance, sweeps: members and planes of each label's regions, numbered from 1 by the area they were grown to.

    Labels of fewer than half ``least_faces`` faces, 20 at least, have none. A region that earlier ones own whole is none, and so is one that
    has too few faces or too little area in the end. A face may be in several; merging and saturation settle that.
    """
    g = p.growth
    enough = faces.groupBy(*LABEL).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(20, g.least_faces // 2)).select(*LABEL)
    faces = faces.join(enough, LABEL, "left_semi")
    grown = written(kernels.grow_regions(faces, near, g.grow_degrees, g.grow_distance, g.dihedral, g.refit_every, g.least_faces).where("region >= 0"))
    sizes = grown.join(faces.select("scene_id", "fid", "area"), ["scene_id", "fid"]).groupBy(*LABEL, "region").agg(F.sum("area").alias("area"))
    order = Window.partitionBy(*LABEL).orderBy(F.desc("area"), "region")
    seeds = written(grown.join(sizes.select(*LABEL, "region", F.row_number().over(order).alias("patch")), [*LABEL, "region"]).select(*PATCH, "fid"))
    first = written(judged(seeds, faces, PATCH, p.quality).where("ok"))
    owners, members, planes = None, [], []
    while True:
        active = first
        if owners is not None:
            free = seeds.join(owners, [*LABEL, "fid"], "left").where(F.col("by").isNull() | (F.col("by") >= F.col("patch"))).select(*PATCH).distinct()
            active = written(first.join(free, PATCH, "left_semi"))
        got, fits = swept_to_fixpoint(seeds, active, owners, faces, near, p)
        sized = got.join(faces.select("scene_id", "fid", "area"), ["scene_id", "fid"]).groupBy(*PATCH).agg(F.count("*").alias("n"), F.sum("area").alias("area"))
        whole = written(sized.where((F.col("n") >= g.least_faces) & (F.col("area") >= g.least_area)).select(*PATCH))
        got, fits = written(got.join(whole, PATCH, "left_semi")), written(fits.join(whole, PATCH, "left_semi"))
        now = written(got.groupBy(*LABEL, "fid").agg(F.min("patch").alias("by")))
        changed = first.select(*LABEL).distinct() if owners is None else written(_differ(now, owners, LABEL))
        if owners is None:  # a label of one region has nobody to heed
            changed = written(first.groupBy(*LABEL).agg(F.count("*").alias("_n")).where("_n > 1").select(*LABEL))
        members.append(got.join(changed, LABEL, "left_anti"))
        planes.append(fits.join(changed, LABEL, "left_anti"))
        if changed.isEmpty():
            break
        first, owners = written(first.join(changed, LABEL, "left_semi")), written(now.join(changed, LABEL, "left_semi"))
    every = lambda parts: written(_union(parts))
    return every([m.select(*PATCH, "fid") for m in members]), every([f.select(*PATCH, *_ABC, "d") for f in planes])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _vertices(members: DataFrame, faces: DataFrame) -> DataFrame:
    corner = F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("vid"), *[F.col(f"{a}{k}").alias(a) for a in "xyz"]) for k in range(3)]))
    shaped = members.join(faces.drop("label_int"), ["scene_id", "fid"])
    return shaped.select(*PATCH, corner.alias("p")).select(*PATCH, "p.*").distinct()


def near_planes(members: DataFrame, planes: DataFrame, faces: DataFrame, degrees: float, distance: float, share: float = 0.85) -> DataFrame:
    """Pairs (scene_id, label_int, one < two) of a label's patches whose normals, of either sign, are within ``degrees`` and whose distinct
    vertices, ``share`` of them, are within ``distance`` of each other's planes. Planes with ``fresh`` false do not meet each other.

    Normals meet in cells, so patches of other directions are never held together.
    """
    left = planes.select(*LABEL, F.col("patch").alias("one"), *[F.col(c).alias(f"n{x}") for c, x in zip(_ABC, "xyz", strict=True)], F.col("d").alias("pd"), F.col("fresh").alias("pf"))
    turned = F.explode(F.array(F.lit(1.0), F.lit(-1.0)))
    right = planes.select(*LABEL, F.col("patch").alias("two"), *_ABC, "d", F.col("fresh").alias("qf"), turned.alias("_s")).withColumns({c: F.col(c) * F.col("_s") for c in (*_ABC, "d")})
    met = _by_normal(left, right, LABEL, degrees).where("one < two and (pf or qf)")
    dots = G.dot(_normal(), [F.col(c) for c in _ABC])
    met = met.where(dots >= cos(radians(degrees))).select(*LABEL, "one", "two", *_normal(), "pd", *_ABC, "d").dropDuplicates([*LABEL, "one", "two"])
    ways = F.array(F.struct(F.col("one").alias("patch"), *_ABC, "d"), F.struct(F.col("two").alias("patch"), *[F.col(f"n{x}").alias(c) for c, x in zip(_ABC, "xyz", strict=True)], F.col("pd").alias("d")))
    both = met.select(*LABEL, "one", "two", F.explode(ways).alias("w")).select(*LABEL, "one", "two", "w.*")
    gap = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))
    far = both.join(_vertices(members, faces), PATCH).groupBy(*LABEL, "one", "two", "patch").agg(F.percentile(gap, F.lit(share)).alias("far"))
    return far.groupBy(*LABEL, "one", "two").agg(F.max("far").alias("far")).where(F.col("far") <= distance).select(*LABEL, "one", "two")


def merged(members: DataFrame, planes: DataFrame, faces: DataFrame, near: DataFrame, degrees: float, distance: float, sweep_degrees: float, sweep_distance: float, sweep_share: float, q: Quality) -> tuple[DataFrame, DataFrame]:
    """Conditional merges of a label's patches, until none is taken: members and planes.

    A pair that ``near_planes`` finds is tried: the union is fitted and must pass the gates ``q``; the union's plane sweeps the label,
    with two neighbours at least, and what it has then must pass once more. If it fails, both stay as they were. A round takes
    the pairs that come first for both of their ends, in order of their numbers; the merged patch keeps the smaller
    one. Pairs of which neither end has changed are not tried again.
    """
    q = Quality(**{**q.__dict__, "inlier_distance": sweep_distance})
    pair = [*LABEL, "one", "two"]
    members, planes = members.select(*PATCH, "fid"), planes.select(*PATCH, *_ABC, "d", F.lit(True).alias("fresh"))
    while True:
        pairs = written(near_planes(members, planes, faces, degrees, distance))
        if pairs.isEmpty():
            break
        ends = pairs.select(*pair, F.explode(F.array("one", "two")).alias("patch"))
        union = written(ends.join(members, PATCH).select(*pair, "fid").distinct())
        tried = judged(union, faces, pair, q).where("ok").select(*pair, *_ABC, "d")
        tried = written(tried)
        got = written(sweep(faces, tried, pair, sweep_degrees, sweep_distance, sweep_share))
        union = written(union.join(tried.select(*pair), pair, "left_semi").select(*pair, "fid").union(agreeing(got, near, 2, pair)).distinct())
        passed = written(judged(union, faces, pair, q).where("ok").select(*pair, *_ABC, "d"))
        first = passed.select(*pair, F.explode(F.array("one", "two")).alias("patch")).groupBy(*PATCH).agg(F.min(F.struct("one", "two")).alias("m"))
        taken = first.groupBy(*LABEL, "m").agg(F.count("*").alias("n")).where("n = 2").select(*LABEL, "m.one", "m.two")
        taken = written(taken)
        if taken.isEmpty():
            break
        gone = taken.select(*LABEL, F.explode(F.array("one", "two")).alias("patch"))
        members = written(members.join(gone, PATCH, "left_anti").union(union.join(taken, pair, "left_semi").select(*LABEL, F.col("one").alias("patch"), "fid")))
        kept = planes.join(gone, PATCH, "left_anti").select(*PATCH, *_ABC, "d", F.lit(False).alias("fresh"))
        planes = written(kept.union(passed.join(taken, pair, "left_semi").select(*LABEL, F.col("one").alias("patch"), *_ABC, "d", F.lit(True))))
    return members, planes.select(*PATCH, *_ABC, "d")


def settled(members: DataFrame, faces: DataFrame) -> DataFrame:
    """Members without overlap: a contested face goes to its label's patch of largest area; of ties to the smaller number."""
    area = faces.select("scene_id", "fid", "area")
    sizes = members.join(area, ["scene_id", "fid"]).groupBy(*PATCH).agg(F.round(F.sum("area"), 9).alias("size"))
    best = members.join(sizes, PATCH).groupBy(*LABEL, "fid").agg(F.min_by("patch", F.struct(-F.col("size"), F.col("patch"))).alias("patch"))
    return best.select(*PATCH, "fid")


def saturated(members: DataFrame, planes: DataFrame, faces: DataFrame, near: DataFrame, p: LabelPass, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Saturation: each plane sweeps its whole label, with one neighbour at least, and keeps what still passes its gates; contested faces go to the
    larger patch; then a light merge. Ends after ``rounds``, or when a round changes no face. Members do not overlap.
    """
    for _ in range(p.saturation_rounds if rounds is None else rounds):
        got = written(sweep(faces, planes, PATCH, p.saturation_degrees, p.saturation_distance, p.saturation_share))
        union = written(members.select(*PATCH, "fid").union(agreeing(got, near, 1, PATCH)).distinct())
        good = written(judged(union, faces, PATCH, p.saturation).where("ok").select(*PATCH, *_ABC, "d"))
        wide = union.join(good, PATCH, "left_semi").union(members.select(*PATCH, "fid").join(good, PATCH, "left_anti"))
        fits = written(good.union(planes.select(*PATCH, *_ABC, "d").join(good, PATCH, "left_anti")))
        apart = written(settled(written(wide), faces))
        fits = fits.join(apart.select(*PATCH).distinct(), PATCH, "left_semi")
        light = max(0.02, 0.6 * p.saturation_distance)
        after, planes = merged(apart, written(fits), faces, near, 10.0, light, p.saturation_degrees, p.saturation_distance, p.saturation_share, p.saturation)
        after = written(settled(after, faces))
        same = _differ(after.select(*PATCH, "fid"), members.select(*PATCH, "fid"), ["scene_id"]).isEmpty()
        members = after
        if same:
            break
    return members, planes


def extract(faces: DataFrame, near: DataFrame, p: LabelPass = LabelPass()) -> DataFrame:
    """The whole label pass: scene_id, fid, label_int and patch of every face that a plane has; no face has two."""
    g = p.growth
    members, planes = label_regions(faces, near, p)
    members, planes = merged(members, planes, faces, near, g.merge_degrees, g.merge_distance, g.sweep_degrees, g.sweep_distance, g.sweep_share, p.quality)
    members, _ = saturated(members, planes, faces, near, p)
    return settled(members, faces).select("scene_id", "fid", "label_int", "patch")


def within(near: DataFrame, faces: DataFrame, keys: list[str]) -> DataFrame:
    """Adjacent faces (keys, f1, f2) both of which are in ``faces`` (keys, fid) with the same keys."""
    own = lambda c: faces.select(*keys, F.col("fid").alias(c))
    return near.join(own("f1"), ["scene_id", "f1"]).join(own("f2"), [*keys, "f2"]).select(*keys, "f1", "f2")


def connected(faces: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fid, component) of faces over the adjacency inside each key; a component is named by its least face."""
    return graph.components(faces.select(*keys, "fid"), within(near, faces, keys), keys, "fid", "f1", "f2")


def ransac_rounds(faces: DataFrame, keys: list[str], distance: float, degrees: float, iterations: int, least_faces: int, least_area: float, least_share: float, most: int, seed: int, q: Quality | None = None) -> DataFrame:
    """Planes of each group of faces one after the other: keys, plane (from 1), fid, a, b, c, d.

    A round draws the best plane over what every group still has left, all groups at once. Its faces are taken if there are
    ``least_faces`` of them, ``least_share`` of what was left and ``least_area``, and if they pass the gates ``q``, where given; a group
    that fails is done, as is one with ``most`` planes or fewer than ``least_faces`` faces, three corners at least.
    """
    left, found = written(faces), []
    for r in range(1, most + 1):
        sizes = left.groupBy(*keys).agg(F.count("*").alias("_left"))
        left = left.join(sizes.where(F.col("_left") >= max(1, least_faces)).select(*keys), keys, "left_semi")
        got = written(kernels.face_planes(left, keys, distance, degrees, iterations, seed + r))
        took = got.join(left.select(*keys, "fid", "area"), [*keys, "fid"]).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("area").alias("area"))
        good = took.join(sizes, keys).where((F.col("n") >= least_faces) & (F.col("n") >= F.ceil(F.col("_left") * least_share)) & (F.col("area") >= least_area)).select(*keys)
        if q is not None:
            shaped = left.join(got.select(*keys, "fid"), [*keys, "fid"], "left_semi")
            measured = mesh.quality(shaped, got.select(*keys, *_ABC, "d").distinct(), keys, q.inlier_distance)
            good = good.join(measured.where(mesh.accepted(q.p95, q.inlier_frac, q.thickness, q.degrees, q.width, q.fill)).select(*keys), keys, "left_semi")
        good = written(good)
        if good.isEmpty():
            break
        kept = got.join(good, keys, "left_semi")
        found.append(kept.select(*keys, F.lit(r).alias("plane"), "fid", *_ABC, "d"))
        left = written(left.join(good, keys, "left_semi").join(kept.select(*keys, "fid"), [*keys, "fid"], "left_anti"))
    if not found:
        return got.where("false").select(*keys, F.lit(1).alias("plane"), "fid", *_ABC, "d")
    return written(_union(found))


def leftover_planes(faces: DataFrame, near: DataFrame, owned: DataFrame, distance: float, degrees: float, iterations: int, least_faces: int, least_area: float, least_share: float, most: int, seed: int) -> DataFrame:
    """Planes over the connected rests of each label that ``owned`` (scene_id, fid) leaves: LABEL, component, plane, fid and plane."""
    free = written(faces.join(owned.select("scene_id", "fid"), ["scene_id", "fid"], "left_anti"))
    parts = connected(free, near, LABEL)
    return ransac_rounds(free.join(parts, [*LABEL, "fid"]), [*LABEL, "component"], distance, degrees, iterations, max(3, least_faces), least_area, least_share, most, seed)


def face_plane() -> list[Column]:
    """The plane of a face through its corners, with d >= 0."""
    n = _normal()
    d = -G.dot(n, [F.col(f"{a}0") for a in "xyz"])
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    return [*[(x * sign).alias(c) for x, c in zip(n, _ABC, strict=True)], (d * sign).alias("d")]


def tiered(faces: DataFrame, near: DataFrame, p: LabelPass = LabelPass(), t: Tiers = Tiers()) -> DataFrame:
    """The label pass by tiers of face area: scene_id, fid, label_int, patch and the stage that found its plane.

    Each huge face is a plane of its own; planes over the connected big faces are drawn one after the other; normal faces go through
    the whole label pass among themselves. All planes are then merged by wider bounds and saturated, over all but the small faces.
    """
    tier = mesh.tiers("area", t.small, t.normal, t.big)
    faces = written(faces.withColumn("tier", tier))
    bare = faces.drop("tier")
    huge = bare.where(tier == "huge").select(*LABEL, "fid", *face_plane())
    big = written(bare.where(tier == "big"))
    drawn = ransac_rounds(big.join(connected(big, near, LABEL), [*LABEL, "fid"]), [*LABEL, "component"], t.distance, t.degrees, t.iterations, t.least_faces, t.least_area, t.least_share, t.most, t.seed, t.quality)
    normal = written(bare.where(tier == "normal"))
    grown, fits = label_regions(normal, near, p)
    g = p.growth
    grown, fits = merged(grown, fits, normal, near, g.merge_degrees, g.merge_distance, g.sweep_degrees, g.sweep_distance, g.sweep_share, p.quality)
    grown, fits = saturated(grown, fits, normal, near, p)
    own = [
        huge.select(*LABEL, F.lit(1).alias("stage"), F.col("fid").alias("x"), F.lit(0).alias("y"), "fid", *_ABC, "d"),
        drawn.select(*LABEL, F.lit(2).alias("stage"), F.col("component").alias("x"), F.col("plane").alias("y"), "fid", *_ABC, "d"),
        grown.join(fits, PATCH).select(*LABEL, F.lit(3).alias("stage"), F.col("patch").cast("long").alias("x"), F.lit(0).alias("y"), "fid", *_ABC, "d"),
    ]
    every = written(_union(own))
    ids = every.select(*LABEL, "stage", "x", "y", *_ABC, "d").distinct().withColumn("patch", F.row_number().over(Window.partitionBy(*LABEL).orderBy("stage", "x", "y")))
    ids = written(ids)
    members = written(every.select(*LABEL, "stage", "x", "y", "fid").join(ids.select(*PATCH, "stage", "x", "y"), [*LABEL, "stage", "x", "y"]).select(*PATCH, "fid"))
    large = written(bare.where(tier != "small"))
    members, planes = merged(members, ids.select(*PATCH, *_ABC, "d"), large, near, t.merge_degrees, t.merge_distance, g.sweep_degrees, g.sweep_distance, g.sweep_share, p.quality)
    members, _ = saturated(members, planes, large, near, p, max(1, p.saturation_rounds // 2))
    return settled(members, large).join(ids.select(*PATCH, "stage"), PATCH).select("scene_id", "fid", "label_int", "patch", "stage")


def relaxed(faces: DataFrame, near: DataFrame, owned: DataFrame, distance: float, degrees: float, free_share: float, steal_factor: float) -> DataFrame:
    """The last growth, with stealing: scene_id, fid, label_int and patch of every face that a plane has afterwards.

    Planes (``owned``: scene_id, fid, label_int, patch; a patch has one label) take their turn by area, largest first, ties by number. A plane refits its
    faces and looks at their neighbours of its label in its gates. Free ones join by connected component, if that is not more than
    ``free_share`` of the plane's area at the start. Those of another plane of the label join if the plane's area at the start is
    ``steal_factor`` times what the other has at that moment.

    The turns are a fixpoint over the table of takes (rank, fid): each plane sees the takes of earlier ranks only, all planes at once, until
    no take changes. By induction over the ranks that is the result of the turns one after the other.
    """
    scene = ["scene_id"]
    area = faces.select("scene_id", "fid", "area")
    base = owned.join(area, ["scene_id", "fid"]).groupBy("scene_id", "label_int", "patch").agg(F.sum("area").alias("base"))
    order = Window.partitionBy("scene_id").orderBy(F.desc(F.round("base", 9)), "patch")
    planes = written(base.withColumn("rank", F.row_number().over(order)))
    start = written(owned.select("scene_id", "fid", "patch").join(planes.select("scene_id", "patch", "rank"), ["scene_id", "patch"]).select("scene_id", "fid", F.col("rank").alias("own")))
    slim = faces.select("scene_id", "fid", "area", F.col("label_int").alias("its"), *_normal(), "cx", "cy", "cz")
    takes = None  # scene_id, rank, fid
    while True:
        # a plane's faces at its turn: its own ones that no earlier rank has taken
        held = start if takes is None else start.join(takes.groupBy("scene_id", "fid").agg(F.min("rank").alias("lost")), ["scene_id", "fid"], "left").where("lost is null or lost >= own").drop("lost")
        held = written(held.select("scene_id", F.col("own").alias("rank"), "fid"))
        corner = F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("vid"), *[F.col(f"{a}{k}").alias(a) for a in "xyz"]) for k in range(3)]))
        points = held.join(faces, ["scene_id", "fid"]).select("scene_id", "rank", corner.alias("p")).select("scene_id", "rank", "p.*").distinct()
        fits = kernels.huber_fits(points, ["scene_id", "rank"]).select("scene_id", "rank", *_ABC, "d").join(planes.select("scene_id", "rank", "label_int", "base"), ["scene_id", "rank"])
        beside = held.join(near.withColumnRenamed("f1", "fid"), ["scene_id", "fid"]).select("scene_id", "rank", F.col("f2").alias("fid")).distinct().join(held, ["scene_id", "rank", "fid"], "left_anti")
        n = [F.col(c) for c in _ABC]
        met = beside.join(fits, ["scene_id", "rank"]).join(slim, ["scene_id", "fid"]).where(F.col("its") == F.col("label_int"))
        met = met.where((F.abs(G.dot(_normal(), n)) >= cos(radians(degrees))) & (F.abs(G.dot([F.col(f"c{a}") for a in "xyz"], n) + F.col("d")) <= distance)).select("scene_id", "rank", "fid", "area", "base", "label_int")
        seen = met.join(start, ["scene_id", "fid"], "left")
        if takes is not None:
            earlier = met.select("scene_id", "rank", "fid").join(takes.withColumnRenamed("rank", "by"), ["scene_id", "fid"]).where("by < rank").groupBy("scene_id", "rank", "fid").agg(F.max("by").alias("last"))
            seen = seen.join(earlier, ["scene_id", "rank", "fid"], "left").withColumn("own", F.coalesce("last", "own"))
        seen = written(seen.select("scene_id", "rank", "fid", "area", "base", "label_int", "own"))
        free = seen.where("own is null").select("scene_id", "rank", "fid", "area", "base")
        parts = connected(free, near, ["scene_id", "rank"])
        rests = free.join(parts, ["scene_id", "rank", "fid"])
        small = rests.groupBy("scene_id", "rank", "component", "base").agg(F.sum("area").alias("s")).where(F.col("s") <= F.col("base") * free_share).select("scene_id", "rank", "component")
        joined = rests.join(small, ["scene_id", "rank", "component"], "left_semi").select("scene_id", "rank", "fid")
        # what another plane has at that moment: its start, and what earlier ranks have taken to and from it
        victims = seen.where("own is not null and own <> rank").join(planes.select("scene_id", F.col("rank").alias("own"), F.col("label_int").alias("other"), F.col("base").alias("had")), ["scene_id", "own"]).where("other = label_int")
        pairs = victims.select("scene_id", "rank", "own", "base", "had").distinct()
        now = pairs.withColumn("change", F.lit(0.0))
        if takes is not None:
            held_by = takes.join(start, ["scene_id", "fid"], "left")
            before = held_by.alias("t").join(takes.withColumnRenamed("rank", "prior"), ["scene_id", "fid"], "left").where("prior is null or prior <= rank")
            whose = before.groupBy("scene_id", "fid", "rank", "own").agg(F.max(F.when(F.col("prior") < F.col("rank"), F.col("prior"))).alias("prior")).select("scene_id", "fid", "rank", F.coalesce("prior", "own").alias("lost_by"))
            moves = whose.join(area, ["scene_id", "fid"])
            events = moves.select("scene_id", F.col("rank").alias("at"), F.col("rank").alias("own"), F.col("area").alias("x")).union(moves.where("lost_by is not null").select("scene_id", "rank", "lost_by", -F.col("area")))
            sums = events.groupBy("scene_id", "at", "own").agg(F.sum("x").alias("x"))
            now = pairs.join(sums, ["scene_id", "own"], "left").groupBy("scene_id", "rank", "own", "base", "had").agg(F.sum(F.when(F.col("at") < F.col("rank"), F.col("x")).otherwise(0.0)).alias("change"))
        robbed = now.where((F.col("had") + F.col("change") > 1e-12) & (F.col("base") >= steal_factor * (F.col("had") + F.col("change")))).select("scene_id", "rank", "own")
        stolen = victims.join(robbed, ["scene_id", "rank", "own"], "left_semi").select("scene_id", "rank", "fid")
        fresh = written(joined.union(stolen))
        if fresh.isEmpty() if takes is None else _differ(fresh, takes, scene).isEmpty():
            break
        takes = fresh
    last = fresh.groupBy("scene_id", "fid").agg(F.max("rank").alias("rank"))
    whose = start.join(last, ["scene_id", "fid"], "full").select("scene_id", "fid", F.coalesce("rank", "own").alias("rank"))
    return whose.join(planes.select("scene_id", "rank", "label_int", "patch"), ["scene_id", "rank"]).select("scene_id", "fid", "label_int", "patch")


def _principal(cov: pd.Series) -> pd.Series:
    """First principal axis of covariances (xx, yy, zz, xy, xz, yz), its largest component positive."""
    c = np.stack(cov.to_numpy()) if len(cov) else np.zeros((0, 6))
    m = c[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]].reshape(-1, 3, 3)
    v = np.linalg.eigh(m)[1][:, :, -1]
    sign = np.sign(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], 1))
    return pd.Series(list(v * sign))


def _axis(mode: str) -> tuple[list[Column], Column]:
    """Sums that a part's axis needs, and the axis as an array: the coordinate of largest variance, or the first principal one."""
    x, y, z = (F.col(f"c{a}") for a in "xyz")
    cov = {"xx": (x, x), "yy": (y, y), "zz": (z, z), "xy": (x, y), "xz": (x, z), "yz": (y, z)}
    sums = [F.covar_pop(*ends).alias(f"_{k}") for k, ends in cov.items()]
    if mode == "pca":
        return sums, F.pandas_udf(_principal, "array<double>")(F.array(*[f"_{k}" for k in cov]))
    xx, yy, zz = (F.round(f"_{k}", 9) for k in ("xx", "yy", "zz"))  # near ties go to the first
    one = lambda k: F.array(*[F.lit(1.0 if j == k else 0.0) for j in range(3)])
    return sums, F.when((xx >= yy) & (xx >= zz), one(0)).when(yy >= zz, one(1)).otherwise(one(2))


def split_labels(faces: DataFrame, vertices: int, least: int, parts: int, mode: str = "axis") -> DataFrame:
    """(scene_id, label_int, fid, part, depth) of faces whose labels are cut in two again and again at the median of an axis.

    Level by level: a part is cut if it has ``vertices`` distinct vertices, twice ``least`` faces, halves of ``least`` faces each, and
    while its label has fewer than ``parts`` parts; parts of one level take their turn in order. Faces up to the median go to the first half, so
    equal ones stay together; where all are equal, the half of smaller face numbers does. ``mode``: axis, the coordinate of
    largest variance, or pca. The part numbers are those of the tree: 1, then 2k and 2k + 1.
    """
    ship(faces.sparkSession)
    key = [*LABEL, "part"]
    sums, axis = _axis(mode)
    open_ = faces.select(*LABEL, "fid", "v0", "v1", "v2", "cx", "cy", "cz", F.lit(1).cast("long").alias("part"), F.lit(0).alias("depth"))
    counts = written(open_.select(*LABEL).distinct().withColumn("have", F.lit(1).cast("long")))
    done, depth = [], 0
    open_ = written(open_)
    while True:
        distinct = open_.select(*key, F.explode(F.array("v0", "v1", "v2")).alias("v")).groupBy(*key).agg(F.count_distinct("v").alias("_verts"))
        ready = open_.groupBy(*key).agg(F.count("*").alias("_n"), *sums).where(F.col("_n") >= 2 * least).join(distinct.where(F.col("_verts") >= vertices), key).select(*key, "_n", axis.alias("_axis"))
        along = F.col("cx") * F.col("_axis")[0] + F.col("cy") * F.col("_axis")[1] + F.col("cz") * F.col("_axis")[2]
        placed = written(open_.join(ready, key).withColumn("_at", along))
        cut = placed.groupBy(*key, "_n").agg(F.percentile("_at", F.lit(0.5)).alias("_cut"))
        sided = placed.join(cut.select(*key, "_cut"), key).withColumn("_second", (F.col("_at") > F.col("_cut")).cast("long"))
        halves = sided.groupBy(*key, "_n", "_cut").agg(F.sum("_second").alias("_m"))
        halves = halves.withColumn("_even", F.col("_m") == 0).withColumn("_m", F.when(F.col("_even"), F.col("_n") - F.floor(F.col("_n") / 2)).otherwise(F.col("_m")))
        fit = halves.where((F.col("_m") >= least) & (F.col("_n") - F.col("_m") >= least))
        turn = F.row_number().over(Window.partitionBy(*LABEL).orderBy("part"))
        chosen = written(fit.withColumn("_turn", turn).join(counts, LABEL).where(F.col("_turn") + F.col("have") <= parts).select(*key, "_n", "_cut", "_even"))
        if chosen.isEmpty():
            break
        done.append(open_.join(chosen.select(*key), key, "left_anti").select(*LABEL, "fid", "part", "depth"))
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("fid"))
        equal = placed.join(chosen.where("_even").select(*key), key, "left_semi").withColumn("_nth", nth).select(*key, "fid", "_nth")
        rows = placed.join(chosen.select(*key, "_cut", "_even"), key).join(equal, [*key, "fid"], "left")
        second = F.when(F.col("_even"), F.col("_nth") > F.floor(F.col("_n") / 2)).otherwise(F.col("_at") > F.col("_cut"))
        depth += 1
        open_ = written(rows.withColumn("part", 2 * F.col("part") + second.cast("long")).select(*LABEL, "fid", "v0", "v1", "v2", "cx", "cy", "cz", "part", F.lit(depth).alias("depth")))
        counts = written(counts.join(chosen.groupBy(*LABEL).agg(F.count("*").alias("_k")), LABEL, "left").select(*LABEL, (F.col("have") + F.coalesce("_k", F.lit(0))).alias("have")))
    return written(_union([*done, open_.select(*LABEL, "fid", "part", "depth")]))


def by_parts(faces: DataFrame, near: DataFrame, p: LabelPass, vertices: int, least: int, parts: int, mode: str = "axis") -> DataFrame:
    """The label pass over the parts of split labels, then conditional merges across the parts: scene_id, fid, label_int, patch.

    A part is a label of its own to the pass, so a label of any size takes many tasks; labels that were not split are merged already.
    """
    told = split_labels(faces, vertices, least, parts, mode)
    own = written(told.select(*LABEL, "part").distinct().withColumn("number", F.row_number().over(Window.partitionBy("scene_id").orderBy("label_int", "part")).cast("int")))
    numbered = told.join(own, [*LABEL, "part"]).select("scene_id", "fid", "number")
    apart = written(faces.join(numbered, ["scene_id", "fid"]).withColumn("label_int", F.col("number")).drop("number"))
    found = extract(apart, near, p)
    back = found.withColumnRenamed("label_int", "number").join(own, ["scene_id", "number"])
    ids = back.select(*LABEL, "part", "patch").distinct().withColumn("_id", F.row_number().over(Window.partitionBy(*LABEL).orderBy("part", "patch")))
    members = written(back.join(ids, [*LABEL, "part", "patch"]).select(*LABEL, F.col("_id").alias("patch"), "fid"))
    was_split = own.groupBy(*LABEL).agg(F.count("*").alias("_n")).where("_n > 1").select(*LABEL)
    cut = written(members.join(was_split, LABEL, "left_semi"))
    g = p.growth
    fits = judged(cut, faces, PATCH, p.quality).select(*PATCH, *_ABC, "d")
    whole, _ = merged(cut, written(fits), faces, near, g.merge_degrees, g.merge_distance, g.sweep_degrees, g.sweep_distance, g.sweep_share, p.quality)
    return settled(written(members.join(was_split, LABEL, "left_anti").union(whole.select(*PATCH, "fid"))), faces).select("scene_id", "fid", "label_int", "patch")
