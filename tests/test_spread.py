"""Rasters and joins that grow with their frames: dealt to many tasks, met by cells."""

import math
import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from facetframe.operators import growth, joins, kernels, planes, stencil
from facetframe.plans import _common, fixtures, registry
from facetframe.sources import arrays, datasets, frames, predictions


def test_rasters_are_dealt_out(spark, monkeypatch):
    """``supplier`` is one small file, yet a task makes the rasters of a few of its rows only."""
    monkeypatch.setattr(fixtures, "FRAMES", 3)
    px = fixtures.view(spark, SMALL, "px_grid")
    held = [n for n in px.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    frames = spark.read.parquet(f"{SMALL}/supplier.parquet").count()
    assert sum(held) == frames * 24 * 32
    assert max(held) <= 4 * 24 * 32


@pytest.mark.parametrize("name", ["w02_connected_by_join", "w01_normal_gradient", "f16_bilinear_resize", "f16_area_resize", "x04_huber_fits", "x03_robust_fits", "g15_merge_segments", "s08_archive_paths"])
def test_frames_stay_in_their_task(spark, monkeypatch, name):
    """A task holds as many frames as it was dealt, whatever their number: what goes on within a frame shuffles no pixel."""
    monkeypatch.setattr(fixtures, "FRAMES", 3)
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "hashpartitioning" not in plan


def test_relational_stencil_with_gaps(spark):
    """Missing pixels, rows and a frame of one pixel: the relational form equals the kernel."""
    rng = random.Random(11)
    rows = [(1, f, v, u, 2 + 0.01 * rng.random(), 0.02 * rng.random(), 0.02 * rng.random(), 1.0, rng.random()) for f in (1, 2, 4) for v in range(9) for u in range(12) if rng.random() < 0.7 and v != 4 + f]
    rows.append((1, 7, 3, 3, 2.0, 0.0, 0.0, 1.0, 0.9))
    px = spark.createDataFrame(rows, "scene_id long, frame_id long, v int, u int, z double, nx double, ny double, nz double, planarity double")
    key = lambda df: sorted((x.frame_id, x.v, x.u, round(x.gradient, 9), x.neighbours, x.connected) for x in df.collect())
    for degrees in (1.0, 90.0):
        got = key(stencil.connected_by_join(px, degrees, least=3))
        assert got == key(stencil.connected(px, degrees, least=3)) and len(got) == len(rows)
    assert any(x[5] for x in got)


def test_near_labels_lie_over_each_other(spark):
    """Labels of a raster with gaps, far corners and pixels of two labels, at each radius; no pixel is copied or joined."""
    rng = random.Random(3)
    rows = [(f, rng.randrange(-3, 40), rng.randrange(-5, 30), rng.choice([0, 1, 2, 5, 900])) for f in range(4) for _ in range(25)]
    rows += [(5, 1, 1, 3), (5, 1, 1, 4), (6, 0, 0, 0), (7, 2, 2, 1), (8, 0, 4, 1), (8, 3, 0, 2)]
    px = spark.createDataFrame(rows, "f int, v int, u int, label int")
    for radius in (0, 1, 4, 5):
        got = joins.near_pairs(px, "label", radius, ["f"])
        want = {(a[0], a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and 0 < a[3] < b[3] and math.dist(a[1:3], b[1:3]) <= radius}
        assert sorted(map(tuple, got.collect())) == sorted(want) and (5, 3, 4) in want and ((8, 1, 2) in want) == (radius == 5)
    plan = got._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_merge_takes_sums_without_nulls(spark):
    """A null counts for no sum, and a segment whose depths are all null agrees with none."""
    z = {1: [2.0, None], 2: [2.0, 2.0], 3: [None, None]}
    rows = [(1, 1, v, 2 * label + u, label, 0.0, 0.0, 1.0, z[label][u]) for label in z for u in (0, 1) for v in range(3)]
    px = spark.createDataFrame(rows, "scene_id long, frame_id long, v int, u int, label int, nx double, ny double, nz double, z double")
    got = {r.label: r.merged for r in kernels.merge_segments(px, offset=1.5, least=1).collect()}
    assert got == {1: 1, 2: 1, 3: 3} or got == {1: 2, 2: 2, 3: 3}


def test_archives_are_decoded_together(spark):
    """Archives with and without intrinsics in one batch, more than a batch holds; an empty one is left out."""
    rows = [(f"/s/{k}.npz", bytearray(arrays.encode(np.full((2, 3), k), np.zeros((2, 3)), np.eye(3), np.eye(3) * k if k % 2 else None))) for k in range(1100)]
    got = arrays.decoded(spark.createDataFrame([*rows, ("/s/none.npz", bytearray())], "path string, content binary").coalesce(1)).collect()
    assert {r.path: (r.depth, r.fx) for r in got} == {f"/s/{k}.npz": ([float(k)] * 6, float(k) if k % 2 else None) for k in range(1100)}


def _planes(spark, n=160):
    """Few normals, many copies, opposite normals, offsets on the edge of the tolerance, a repeated id and numbers that are none."""
    rng = random.Random(5)
    rows = []
    for k in range(n):
        a, b = rng.choice([(0.0, 0.0), (0.1, 0.0), (0.0, 0.3), (rng.random(), rng.random())])
        size, sign = math.sqrt(a * a + b * b + 1), rng.choice([-1.0, 1.0])
        rows.append((k // 2 if k < 6 else k, rng.choice("uv"), sign * a / size, sign * b / size, sign / size, sign * rng.choice([0.0, 0.05, 0.1, 0.15, rng.uniform(-2, 2)])))
    rows += [(n, "u", 0.0, 0.0, 1.0, None), (n + 1, "u", 0.0, 0.0, 1.0, float("nan")), (n + 2, None, 0.0, 0.0, 1.0, 0.0)]
    return rows, spark.createDataFrame(rows, "plane_id long, label string, nx double, ny double, nz double, d double").repartition(3)


def _plain(rows, degrees, distance, signed=False, labels=True):
    out = []
    for i, x in enumerate(rows):
        for y in rows[:i]:
            if x[0] == y[0] or (labels and (x[1] is None or x[1] != y[1])) or x[5] is None or y[5] is None:
                continue
            a, b = sorted((x, y))
            dots = a[2] * b[2] + a[3] * b[3] + a[4] * b[4]
            gap = abs(a[5] + b[5]) if signed and dots < 0 else abs(a[5] - b[5])
            if (abs(dots) if signed else dots) >= math.cos(math.radians(degrees)) and gap <= distance:
                out.append((a[0], b[0], gap))
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 3])
def test_planes_of_one_normal_meet_as_groups(spark, monkeypatch, block):
    monkeypatch.setattr(planes, "BLOCK", block)
    rows, table = _planes(spark)
    for got, want in ((planes.coplanar_pairs(table, 12.0, 0.05, ["label"]).select("a_id", "b_id", "offset"), _plain(rows, 12.0, 0.05)), (planes.facing_pairs(table, 20.0, 0.1, ["label"]).select("a_id", "b_id", "gap"), _plain(rows, 20.0, 0.1, True))):
        assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_pairs_are_made_from_arrays(spark, monkeypatch):
    """A join's row is two blocks of planes, whatever their number; the pairs come after all joins."""
    monkeypatch.setattr(planes, "BLOCK", 10)
    table = spark.range(95).selectExpr("id as plane_id", "'u' as label", "0.0D as nx", "0.0D as ny", "1.0D as nz", "0.01D as d")
    got = planes.coplanar_pairs(table, 12.0, 0.05, ["label"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(qof" in plan and plan.index("Generate explode(pof") < plan.index("Join ")
    assert sorted((x.a_id, x.b_id) for x in got.collect()) == [(a, b) for a in range(95) for b in range(a + 1, 95)]


def test_quick_rounding_is_rounding(spark):
    """To the bit, with ties, what is next to them, very large numbers and such as are none."""
    rng = random.Random(2)
    near = [k / 2e6 + e for k in range(-50, 50) for e in (0.0, 1e-12, -1e-12, 1e-10)]
    values = [*near, *(rng.uniform(-10.0**k, 10.0**k) for k in range(-8, 15) for _ in range(200)), *(abs(rng.randrange(200000) / 1e5 - rng.randrange(200000) / 1e5) for _ in range(5000))]
    values += [0.0, -0.0, 1e300, 5e-324, float("inf"), -float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select((_common.quick_round(F.col("v"), 6) + F.lit(0.0)).alias("quick"), (F.round("v", 6) + F.lit(0.0)).alias("usual"))
    assert [x for x in rows.collect() if repr(x.quick) != repr(x.usual)] == []


def test_totals_and_components_need_no_pairs(spark):
    rows, table = _planes(spark)
    want = _plain(rows, 12.0, 0.05, labels=False)
    n, total = planes.coplanar_totals(table, 12.0, 0.05).first()
    assert n == len(want) and math.isclose(total, sum(w[2] for w in want), abs_tol=1e-9)
    root = {(r[1], r[0]): (r[1], r[0]) for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    names = {}
    for r in rows:
        names.setdefault(r[0], set()).add(r[1])
    for label in "uv":
        for a, b, _ in _plain([r for r in rows if r[1] == label], 12.0, 0.05):
            x, y = sorted((find((label, a)), find((label, b))))
            root[y] = x
    got = {((r.label, r.plane_id), r.component) for r in planes.coplanar_components(table, 12.0, 0.05, ["label"]).collect()}
    assert got == {(k, find(k)[1]) for k in root}


def test_copies_of_planes_make_no_pairs(spark):
    """A million pairs of copies: neither the totals nor the components may make a row of each."""
    table = spark.range(1500).selectExpr("id as plane_id", "'u' as label", "0.0D as nx", "0.0D as ny", "1.0D as nz", "0.01D * (id % 2) as d")
    n, total = planes.coplanar_totals(table, 12.0, 0.05).first()
    assert n == 1500 * 1499 // 2 and math.isclose(total, 0.01 * 750 * 750)
    assert {r.component for r in planes.coplanar_components(table, 12.0, 0.05, ["label"]).collect()} == {0}


def test_near_segments_meet_once_a_frame(spark):
    """Labels with points at, within and beyond the distance, alone in cells and many in one; points are not copied to cells around them."""
    rng = random.Random(8)
    rows = [(f % 2, f, label, *[rng.uniform(0, 3) + shift for _ in range(3)]) for f in range(5) for label, shift, n in ((1, 0.0, 40), (2, 1.0, 30), (5, 4.0, 3), (7, 5.5, 1), (9, -3.0, 25)) for _ in range(n)]
    rows += [(0, 8, 1, 0.0, 0.0, 0.0), (0, 8, 2, 0.75, 0.0, 0.0), (0, 8, 3, 0.0, -0.7500001, 0.0), (0, 8, 4, float("nan"), 0.0, 0.0), (0, 9, 1, 0.0, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "scene_id long, frame_id long, label int, x double, y double, z double")
    got = growth.near_in_space(table, ["scene_id", "frame_id"], 0.75)
    want = {(a[0], a[1], a[2], b[2]) for a in rows for b in rows if a[:2] == b[:2] and a[2] < b[2] and math.dist(a[3:], b[3:]) <= 0.75}
    assert {tuple(r) for r in got.collect()} == want and (0, 8, 1, 2) in want
    assert got.count() == len(want)
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_rasters_are_not_broadcast(spark, tmp_path):
    """By their files' size alone both sides of these joins would be."""
    px = spark.createDataFrame([(1, 2, v, u, 1, 2.0) for v in range(2) for u in range(2)], "scene_id long, frame_id long, v int, u int, label int, z double")
    rows = frames.packed(px, ["label", "z"]).withColumn("cam", F.lit("cam_0"))
    rows.withColumnRenamed("z", "distance").write.partitionBy("scene_id", "cam").parquet(f"{tmp_path}/renders")
    rows.withColumnRenamed("z", "zdepth").drop("label").write.partitionBy("scene_id", "cam").parquet(f"{tmp_path}/ray_cast")
    seen = datasets.cameras(spark, str(tmp_path), [[0.6, 0.0, 0.0], [0.0, 0.45, 0.0], [0.0, 0.0, -1.0]], 2, 2)
    truth = frames.packed(px, ["label", "z"])
    for df, n in ((seen, 4), (predictions.met(truth, [predictions.Method("own", truth)]), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and df.count() == n
    assert "Broadcast" not in seen._jdf.queryExecution().executedPlan().toString()


def test_z_buffer_spreads_pixels_not_points(spark):
    points = spark.range(900).selectExpr("cast(id % 3 as int) as v", "cast(id % 2 as int) as u", "(id * 7919 % 101) / 7.0D as z", "id as color")
    rows = [tuple(r) for r in points.collect()]
    seen = joins.z_buffer(points, [], "color", "z", 1)
    got = {(r.v, r.u): (r.z, r.color) for r in seen.collect()}
    assert got == {(v, u): min((z, c) for y, x, z, c in rows if abs(y - v) <= 1 and abs(x - u) <= 1) for v in range(-1, 4) for u in range(-1, 3)}
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")


def test_frames_are_segmented_once(spark):
    """The metrics read the pixels many times; the plan that makes them segments no frame again."""
    plan = registry.QUERIES["d06_benchmark"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_saves_are_dealt_by_pixels(spark, tmp_path, monkeypatch, coalesced):
    """Frames alike, next to nothing in bytes: a large scene is made by many tasks, a small one is one file; a repeated save adds what is missing."""
    monkeypatch.setattr(frames, "FILE_PIXELS", 64)
    scene = F.when(F.col("id") < 100, 0).when(F.col("id") < 200, F.floor(F.col("id") / 4))
    rows = spark.range(230).select(scene.alias("scene_id"), F.col("id").alias("frame_id"), F.lit(2).alias("h"), F.lit(2).alias("w"), F.array(*[F.lit(1)] * 4).alias("label"))
    key, at = "spark.sql.adaptive.coalescePartitions.enabled", str(tmp_path / "t")
    usual = spark.conf.get(key)
    spark.conf.set(key, coalesced)
    try:
        frames.save(rows.where("frame_id <> 7"), at, "label")
        made = {}
        for r in spark.read.parquet(at).select("scene_id", "frame_id", F.input_file_name().alias("file")).collect():
            made.setdefault(r.scene_id, {}).setdefault(r.file, []).append(r.frame_id)
        assert 4 <= len(made[0]) <= 7 and 1 <= len(made[None]) <= 2
        assert [len(made[s]) for s in range(25, 50)] == [1] * 25
        assert len({f.split("part-")[1][:5] for files in made.values() for f in files}) > 7
        frames.save(rows, at, "label")
        frames.save(rows.where("scene_id is not null"), at, "label")
        got = spark.read.parquet(at).where("scene_id is not null").select("scene_id", "frame_id").collect()
    finally:
        spark.conf.set(key, usual)
    assert sorted(map(tuple, got)) == sorted((0 if k < 100 else k // 4, k) for k in range(200))
    frames.save(rows.drop("h", "w"), str(tmp_path / "bare"))
    assert spark.read.parquet(str(tmp_path / "bare")).count() == 230
