"""The label pass as joins against the same pass on arrays, on random meshes and on cases made for one step."""

import random
from dataclasses import replace

import numpy as np
import plain_extraction as plain
import pytest
from pyspark.sql import functions as F

from facetframe.operators import extraction, kernels, mesh
from facetframe.params import Extraction, LabelPass, Quality, Tiers

PASS = LabelPass(growth=Extraction(grow_degrees=12.0, grow_distance=0.02, least_faces=8, least_area=0.02, sweep_degrees=14.0, sweep_distance=0.02, sweep_share=0.66, merge_degrees=12.0, merge_distance=0.03), quality=Quality(degrees=14.0, thickness=0.06), saturation=Quality(inlier_distance=0.02, thickness=0.08, degrees=16.0, width=0.05, fill=0.1), saturation_rounds=2)


def basis(n):
    e1 = np.cross(n, [1.0, 0, 0] if abs(n[0]) < 0.9 else [0, 1.0, 0])
    e1 /= np.linalg.norm(e1)
    return e1, np.cross(n, e1)


def grid(spark, height, label, rows=10, columns=12, scenes=1, step=0.1):
    """A grid of cells, two faces each, with heights of (scene, x, y) and labels of (scene, row, column): shapes and adjacent pairs."""
    at = lambda v, u: v * (columns + 1) + u
    # below the origin: with d >= 0 the planes then face as the faces do
    verts = [(s, at(v, u), step * u, step * v, float(height(s, u, v)) - 1.0) for s in range(scenes) for v in range(rows + 1) for u in range(columns + 1)]
    faces = []
    for s in range(scenes):
        for v in range(rows):
            for u in range(columns):
                k = 2 * (v * columns + u)
                faces += [(s, k, at(v, u), at(v, u + 1), at(v + 1, u), label(s, v, u)), (s, k + 1, at(v, u + 1), at(v + 1, u + 1), at(v + 1, u), label(s, v, u))]
    f = spark.createDataFrame(faces, "scene_id long, fid long, v0 long, v1 long, v2 long, label_int int")
    v = spark.createDataFrame(verts, "scene_id long, vid long, x double, y double, z double")
    return mesh.shapes(f, v).cache(), mesh.adjacency(f).cache()


def rough(seed):
    """Slopes that meet in ridges, a step, and noise."""
    r = random.Random(seed)
    noise = [[r.uniform(-0.004, 0.004) for _ in range(40)] for _ in range(40)]
    slope = [r.uniform(-0.2, 0.2) for _ in range(4)]
    return lambda s, u, v: 0.1 * (slope[s] * u if v < 5 else slope[s + 1] * (v - 5) + slope[s] * u) + (0.03 if u > 7 + s else 0.0) + noise[v][u]


def arrays(shapes, near, scene=0):
    return plain.Mesh([r.asDict() for r in shapes.where(F.col("scene_id") == scene).collect()], [(r.f1, r.f2) for r in near.where(F.col("scene_id") == scene).collect()])


def grown_by_label(shapes, near, p, m, scene=0):
    g, at = p.growth, {f: k for k, f in enumerate(m.fid)}
    out = {}
    for r in kernels.grow_regions(shapes, near, g.grow_degrees, g.grow_distance, g.dihedral, g.refit_every, g.least_faces).where(F.col("scene_id") == scene).where("region >= 0").collect():
        out.setdefault(r.label_int, {}).setdefault(r.region, []).append(at[r.fid])
    return {k: [v[n] for n in sorted(v)] for k, v in out.items()}


@pytest.fixture(scope="module")
def scenes(spark):
    tall = {0: rough(4), 1: rough(7)}
    return grid(spark, lambda s, u, v: tall[s](s, u, v), lambda s, v, u: 0 if u < 9 else 1, scenes=2)


WIDE = replace(PASS, em_growth=0.0, em_rounds=2, saturation_rounds=1, growth=replace(PASS.growth, merge_degrees=30.0, merge_distance=0.1, sweep_distance=0.04), quality=Quality(p95=0.1, inlier_frac=0.5, degrees=30.0, thickness=0.25, width=0.05, fill=0.05))


def test_label_pass_equals_plain(spark, scenes):
    """Regions, merges and saturation of two scenes at once, the scenes' regions and planes too."""
    shapes, near = scenes
    members, planes = extraction.label_regions(shapes, near, WIDE)
    got, fits = members.collect(), {(r.scene_id, r.label_int, r.patch): (r.a, r.b, r.c, r.d) for r in planes.collect()}
    g = WIDE.growth
    members, planes = extraction.merged(members, planes, shapes, near, g.merge_degrees, g.merge_distance, g.sweep_degrees, g.sweep_distance, g.sweep_share, WIDE.quality)
    whole = extraction.settled(extraction.saturated(members, planes, shapes, near, WIDE)[0], shapes).collect()
    assert len(whole) == len({(r.scene_id, r.fid) for r in whole}) > 0
    merges = 0
    for s in (0, 1):
        m = arrays(shapes, near, s)
        grown = grown_by_label(shapes, near, WIDE, m, s)
        want = plain.regions(m, grown, WIDE, basis)
        assert {(label, k): {m.fid[f] for f in faces} for label, found in want.items() for k, faces, _ in found} == {key: {r.fid for r in got if (r.scene_id, r.label_int, r.patch) == (s, *key)} for key in {(r.label_int, r.patch) for r in got if r.scene_id == s}}
        for label, found in want.items():
            for k, _, (n, d) in found:
                assert np.allclose([*n, d], fits[s, label, k], atol=1e-9)
        last = plain.extract(m, grown, WIDE, basis)
        assert {r.fid: (r.label_int, r.patch) for r in whole if r.scene_id == s} == last
        merges += sum(map(len, want.values())) - len(set(last.values()))
    assert merges > 0


def test_parallel_planes_split(spark):
    """Two planes 2 cm apart: a sweep of 3 cm takes both, the run of offsets with the seeds keeps one."""
    shapes, near = grid(spark, lambda s, u, v: 0.02 if u > 5 else 0.0, lambda s, v, u: 0, rows=8, columns=12)
    p = replace(PASS, growth=replace(PASS.growth, sweep_distance=0.03, grow_distance=0.005, merge_distance=0.001, least_faces=20, grow_degrees=8.0), quality=replace(PASS.quality, inlier_distance=0.03, p95=0.05), offset_gap=0.004)
    members, _ = extraction.label_regions(shapes, near, p)
    got = {}
    for r in members.collect():
        got.setdefault(r.patch, set()).add(r.fid)
    flat = lambda low: {2 * (v * 12 + u) + t for v in range(8) for u in range(12) for t in (0, 1) if (u < 5 if low else u > 5)}
    assert len(got) == 2 and sorted(map(sorted, got.values())) == sorted(map(sorted, (flat(True), flat(False))))
    both = extraction.label_regions(shapes.where("label_int = 0"), near, replace(p, clusters=False))[0]
    assert both.where("patch = 1").count() > len(got[1])


def test_merge_needs_the_union(spark):
    """Two coplanar halves merge; two that pass the angle and distance test, but whose union is too thick, do not."""
    shapes, near = grid(spark, lambda s, u, v: 0.0 if s == 0 else 0.025 * (u > 6), lambda s, v, u: 0, rows=6, columns=12, scenes=2)
    members = shapes.where("fid % 24 < 12 or fid % 24 >= 14").select("scene_id", "label_int", F.when(F.col("fid") % 24 < 12, 1).otherwise(2).alias("patch"), "fid")
    planes = extraction.judged(members, shapes, extraction.PATCH, PASS.quality).select(*extraction.PATCH, "a", "b", "c", "d")
    assert {(r.scene_id, r.one, r.two) for r in extraction.near_planes(members, planes.withColumn("fresh", F.lit(True)), shapes, 12.0, 0.03).collect()} == {(0, 1, 2), (1, 1, 2)}
    q = replace(PASS.quality, thickness=0.02)
    got, fits = extraction.merged(members, planes, shapes, near, 12.0, 0.03, 14.0, 0.02, 0.66, q)
    assert {(r.scene_id, r.patch) for r in fits.collect()} == {(0, 1), (1, 1), (1, 2)}
    assert got.where("scene_id = 0").count() == 144  # the sweep of the union takes the column between


def test_relaxed_growth_equals_turns(spark, scenes, factor=1.5):
    shapes, near = scenes
    r = random.Random(3)
    owners = {s: {f: r.choice([1, 1, 1, 2, 2, 3, 4, None]) if f % 30 < 20 else r.choice([None, 5, 6]) for f in range(240)} for s in (0, 1)}
    labels = {(x.scene_id, x.fid): x.label_int for x in shapes.collect()}
    owned = [(s, f, labels[s, f], 2 * p + labels[s, f]) for s in owners for f, p in owners[s].items() if p]
    table = spark.createDataFrame(owned, "scene_id long, fid long, label_int int, patch int")
    got = extraction.relaxed(shapes, near, table, 0.05, 25.0, 0.3, factor).collect()
    for s in (0, 1):
        m = arrays(shapes, near, s)
        want = plain.relaxed(m, {f: p for k, f, _, p in owned if k == s}, 0.05, 25.0, 0.3, factor)
        assert {x.fid: x.patch for x in got if x.scene_id == s} == want
        assert want != {f: p for k, f, _, p in owned if k == s}


def test_relaxed_three_planes(spark):
    """The largest plane takes the free strip beside it and robs the least one, but not the middle one."""
    shapes, near = grid(spark, lambda s, u, v: 0.0, lambda s, v, u: 0, rows=4, columns=12)
    of = lambda u: 1 if u < 6 else None if u == 6 else 2 if u < 10 else 3
    rows = [(0, r.fid, 0, p) for r in shapes.collect() if (p := of(r.fid // 2 % 12)) is not None]
    table = spark.createDataFrame(rows, "scene_id long, fid long, label_int int, patch int")
    def took(share, factor):
        rows = extraction.relaxed(shapes, near, table, 0.02, 18.0, share, factor).collect()
        return {p: sorted({r.fid // 2 % 12 for r in rows if r.patch == p}) for p in (1, 2, 3)}

    assert took(1.0, 1.4) == {1: [0, 1, 2, 3, 4, 5, 6], 2: [6, 7, 8, 9, 10], 3: [10, 11]}


@pytest.mark.parametrize("mode", ["axis", "pca"])
def test_split_equals_queue(spark, scenes, mode):
    shapes, _ = scenes
    for vertices, least, parts in ((10, 5, 11), (60, 5, 5)):
        got = {(r.scene_id, r.fid): r.part for r in extraction.split_labels(shapes, vertices, least, parts, mode).collect()}
        for s in (0, 1):
            m = arrays(shapes, scenes[1], s)
            want = {}
            for label in (0, 1):
                want |= plain.split(m, [k for k in range(len(m.fid)) if m.label[k] == label], vertices, least, parts, mode)
            assert {f: p for (k, f), p in got.items() if k == s} == want
        assert parts < 11 or max(got.values()) >= 8


def test_split_of_equal_places(spark):
    """Faces that all lie at one place are halved by their numbers."""
    shapes, _ = grid(spark, lambda s, u, v: 0.0, lambda s, v, u: 0, rows=2, columns=4)
    flat = shapes.withColumns({c: F.lit(1.0) for c in ("cx", "cy", "cz")})
    got = {r.fid: r.part for r in extraction.split_labels(flat, 1, 4, 3).collect()}
    assert got == {f: 2 if f < 8 else 3 for f in range(16)} | {f: (4 if f < 4 else 5) for f in range(8)} if len(set(got.values())) == 3 else got == {f: 2 if f < 8 else 3 for f in range(16)}


def test_cross_split_merge(spark):
    """A flat label that was cut in parts is one plane again; one that was not cut is left as it is."""
    shapes, near = grid(spark, lambda s, u, v: 0.0, lambda s, v, u: 0 if u < 10 else 1, rows=8, columns=12)
    got = extraction.by_parts(shapes, near, PASS, 10, 20, 4).collect()
    assert len({r.patch for r in got if r.label_int == 0}) == 1 and len(got) == 192
    assert len({r.part for r in extraction.split_labels(shapes, 10, 20, 4).where("label_int = 0").collect()}) == 4


def test_tiers(spark):
    """Huge faces are planes, big ones are drawn, normal ones are grown; small ones belong to nobody."""
    shapes, near = grid(spark, lambda s, u, v: 0.0 if u < 6 else 0.5 * (u - 6), lambda s, v, u: 0 if u < 6 else 1, rows=6, columns=12, scenes=1)
    t = Tiers(small=0.001, normal=0.0051, big=0.5, distance=0.005, degrees=5.0, least_area=0.02, quality=Quality(p95=0.05, inlier_frac=0.5, degrees=12.0, thickness=0.05, width=0.03, fill=0.02))
    got = extraction.tiered(shapes, near, PASS, t).collect()
    assert {(r.label_int, r.stage) for r in got} == {(0, 3), (1, 2)} and len(got) == 144 and len({(r.label_int, r.patch) for r in got}) == 2


def test_leftover_planes(spark):
    """Planes over the connected rests: by components, with the least share, area and number of faces."""
    shapes, near = grid(spark, lambda s, u, v: 0.0 if u < 5 else 0.3 * (u - 5) * 0.1, lambda s, v, u: 0, rows=4, columns=12)
    owned = shapes.where("fid % 24 in (8, 9)")
    find = lambda **k: extraction.leftover_planes(shapes, near, owned, **{"distance": 0.001, "degrees": 3.0, "iterations": 60, "least_faces": 3, "least_area": 0.0, "least_share": 0.0, "most": 8, "seed": 1, **k})
    got = {}
    for r in find().collect():
        got.setdefault((r.component, r.plane), set()).add(r.fid // 2 % 12)
    assert sorted(map(sorted, got.values())) == [[0, 1, 2, 3], [5, 6, 7, 8, 9, 10, 11]]
    assert {r.component for r in find(least_faces=40).collect()} == {10} and find(least_area=10.0).count() == 0


def test_sequential_ransac_stops(spark):
    """Two slopes of one component: two rounds, or one where only one is allowed, and none where the larger is too small a share."""
    shapes, near = grid(spark, lambda s, u, v: 0.0 if u < 7 else 0.05 * (u - 7), lambda s, v, u: 0, rows=4, columns=12)
    empty = shapes.limit(0)
    find = lambda share, most: {(r.plane, r.fid // 2 % 12) for r in extraction.leftover_planes(shapes, near, empty, 0.001, 3.0, 80, 3, 0.0, share, most, 5).collect()}
    first = {(1, u) for u in range(7)}
    assert find(0.1, 8) == first | {(2, u) for u in range(7, 12)} and find(0.9, 8) == set()
