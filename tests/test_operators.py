"""Golden cases, invariants and NumPy twins of the planar-geometry operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetframe.functions import geometry as G
from facetframe.functions import names
from facetframe.operators import graph, joins, kernels, labels, mesh, metrics, planes, raycast, rollup, sampling, stencil
from facetframe.sources import frames, meshes, texts

SEG = "scene_id long, frame_id long, gt int, pred int"


def seg(spark, gt, pred, frame=1):
    return spark.createDataFrame([(1, frame, g, p) for g, p in zip(gt, pred, strict=True)], SEG)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_golden_metrics(spark):
    px = seg(spark, [1, 1, 2, 2], [1, 1, 1, 2])
    assert one(metrics.segmentation_covering(px)).sc == pytest.approx(0.583333, abs=1e-6)
    c = one(metrics.clustering(px))
    assert c.rand_index == pytest.approx(0.5) and c.voi == pytest.approx(1.188722, abs=1e-6)
    b = one(metrics.binary_planarity(seg(spark, [0, 1, 1, 0, 2], [0, 1, 0, 3, 2])))
    assert (b.bp_accuracy, b.bp_iou) == (pytest.approx(0.6), pytest.approx(0.5))
    assert b.bp_precision == b.bp_recall == pytest.approx(2 / 3) and b.bp_f1 == pytest.approx(2 / 3)


def test_metrics_of_truth_and_relabelling(spark):
    r = np.random.default_rng(5)
    gt, pred = r.integers(0, 6, 400).tolist(), r.integers(0, 5, 400).tolist()
    same = one(metrics.frame_metrics(seg(spark, gt, gt)))
    assert same.sc == same.rand_index == 1 and same.voi == pytest.approx(0, abs=1e-12)
    a, b = one(metrics.frame_metrics(seg(spark, gt, pred))), one(metrics.frame_metrics(seg(spark, gt, [(3 * p + 1) % 5 for p in pred])))
    assert a.sc == pytest.approx(b.sc) and a.voi == pytest.approx(b.voi) and a.rand_index == pytest.approx(b.rand_index)
    assert one(metrics.contingency(seg(spark, gt, pred)).agg(F.sum("n").alias("n"))).n == 400


def test_single_pixel_and_empty(spark):
    assert one(metrics.clustering(seg(spark, [1], [1]))).rand_index == 1
    assert metrics.frame_metrics(seg(spark, [1], [1]).limit(0)).count() == 0


def test_gated_precision_recall(spark):
    pts = [(1, 0.0, 0.0, 0.0 if k < 9 else 1.0) for k in range(10)] + [(2, 0.0, 0.0, 0.0 if k < 8 else 1.0) for k in range(10)] + [(0, 0.0, 0.0, 5.0)] * 5
    p = spark.createDataFrame(pts, "label int, x double, y double, z double")
    fits = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0, 0.0)], "label int, a double, b double, c double, d double")
    got = one(metrics.gated(p, fits, [0.01], [0.9], []))
    assert (got.precision, got.recall) == (pytest.approx(0.45), pytest.approx(0.36))
    many = {r.threshold: r.precision for r in metrics.gated(p, fits, [0.01, 0.5, 2.0], [0.5], []).collect()}
    assert many[0.01] <= many[0.5] <= many[2.0] == 1.0


def test_rollup_skips_nan_and_single_scene(spark):
    f = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, None)], "scene_id long, m double")
    s = one(rollup.by_scene(f, ["m"]))
    assert s.m == 1.0 and s.num_frames == 3
    d = one(rollup.dataset(rollup.by_scene(f, ["m"]), ["m"]))
    assert d.m_std is None and d.num_frames_total == 3
    assert one(f.limit(1).withColumn("s", F.lit(3725.5)).select(rollup.clock("s").alias("t"))).t == "01:02:05.500"


def test_label_conventions(spark):
    t = spark.createDataFrame([(-1,), (0,), (1,), (20,), (3,)], "l int")
    got = t.select("l", labels.shift("l").alias("s"), labels.legacy_shift("l").alias("o"), labels.nonplanar_to_zero("l", 20, True).alias("i"), labels.nonplanar_to_zero("l", 20, False).alias("u")).collect()
    assert [r.s for r in got[:3]] == [0, 1, 2] and [r.o for r in got[:3]] == [0, 0, 1]
    assert [r.i for r in got[3:]] == [0, 4] and [r.u for r in got[3:]] == [0, 3] and got[1].i == 1


def test_gaps_shards_names_depths(spark):
    t = spark.createDataFrame([(1, x) for x in (0.0, 0.01, 0.02, 0.05, 0.055)], "k int, t double")
    assert sorted(r["count"] for r in planes.gap_clusters(t, ["k"], "t", 0.012).groupBy("cluster").count().collect()) == [2, 3]
    s = sampling.shards(spark.range(7), "id", 3).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in s] == [3, 2, 2]
    n = spark.createDataFrame([("floor_tile_obj_123",), ("window2_obj_11",), ("towel_03",)], "n string")
    assert [r[0] for r in n.select(names.collapsed("n")).collect()] == ["floor_tile", "window2", "towel"]
    d = spark.createDataFrame([(255, 255, 255)], "r int, g int, b int")
    assert one(d.select(G.rgb_depth("r", "g", "b").alias("m"))).m == pytest.approx(5000)
    assert math.sqrt(2 - 2 * math.cos(math.radians(5))) == pytest.approx(0.0872388, abs=1e-7)
    a = spark.createDataFrame([(0.5,), (1.0,), (10.0,), (60.0,)], "a double")
    assert [r[0] for r in a.select(mesh.tiers("a")).collect()] == ["small", "normal", "big", "huge"]
    assert one(a.limit(1).select(G.adaptive_inlier(F.lit(0.019), F.lit(1.0), F.lit(1.0), F.lit(20.0), 0.01, 0.9).alias("i"))).i


def test_projection_round_trip(spark):
    cam = G.Pinhole(40.0, 41.0, 15.5, 11.5)
    px = spark.createDataFrame([(v, u, 1.0 + v + u) for v in range(5) for u in range(5)], "v int, u int, z double")
    xyz = G.backproject(cam)
    back = px.select("v", "u", *[c.alias(n) for c, n in zip(xyz, "xyz", strict=True)])
    u, v = G.project(cam)
    for r in back.select("v", "u", (u + 0).alias("pu"), (v + 0).alias("pv")).collect():
        assert abs(r.pu - r.u) <= 1 and abs(r.pv - r.v) <= 1


def test_least_squares_equals_svd(spark):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(8):
        p = r.normal(size=(60, 3)) * [3, 2, 0.05] @ np.linalg.qr(r.normal(size=(3, 3)))[0] + r.normal(size=3) * 5
        want[k] = kernels.pca_plane(p)
        rows += [(k, *map(float, x)) for x in p]
    rows += [(99, float(t), 2.0 * t, 0.0) for t in range(5)] + [(98, 0.0, 0.0, 0.0)]
    got = {f.k: f for f in planes.fit(spark.createDataFrame(rows, "k int, x double, y double, z double"), ["k"]).collect()}
    assert set(got) == set(range(8))
    for k, (n, d) in want.items():
        assert abs(np.dot(n, [got[k].a, got[k].b, got[k].c])) == pytest.approx(1, abs=1e-9) and got[k].d == pytest.approx(abs(d), abs=1e-6)


def test_coplanar_pairs_equal_brute_force(spark):
    r = np.random.default_rng(3)
    n = r.normal(size=(120, 3)) * [0.2, 0.2, 1]
    n /= np.linalg.norm(n, axis=1)[:, None]
    d = r.uniform(0, 2, 120)
    t = spark.createDataFrame([(k, *map(float, n[k]), float(d[k])) for k in range(120)], "plane_id long, nx double, ny double, nz double, d double")
    got = {(x.a_id, x.b_id) for x in planes.coplanar_pairs(t, 15.0, 0.1).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if abs(d[i] - d[j]) <= 0.1 and n[i] @ n[j] >= math.cos(math.radians(15))}


def raster(spark, plane, frame=1, **more):
    h, w = plane.shape
    rows = [(1, frame, v, u, float(plane[v, u]), *(float(m[v, u]) for m in more.values())) for v in range(h) for u in range(w)]
    return spark.createDataFrame(rows, "scene_id long, frame_id long, v int, u int, z double" + "".join(f", {c} double" for c in more))


def test_stencil_forms_agree(spark):
    r = np.random.default_rng(4)
    shape = (9, 11)
    n = r.normal(size=(*shape, 3)) * 0.02 + [0, 0, 1]
    px = raster(spark, 2 + 0.01 * r.random(shape), nx=n[..., 0], ny=n[..., 1], nz=n[..., 2], planarity=r.random(shape))
    key = lambda df: sorted((x.v, x.u, round(x.gradient, 9), x.neighbours, x.connected) for x in df.collect())
    assert key(stencil.connected(px)) == key(stencil.connected_by_join(px))


@pytest.mark.parametrize("eight", [True, False])
def test_region_forms_agree(spark, eight):
    r = np.random.default_rng(6)
    px = raster(spark, np.zeros((12, 14)), m=(r.random((12, 14)) < 0.55).astype(float)).withColumn("on", F.col("m") > 0)
    pairs = lambda df: {(x.v, x.u): x.region for x in df.collect()}
    a, b = pairs(graph.pixel_components(px, "on", eight)), pairs(kernels.label_regions(px, "on", eight))
    assert a.keys() == b.keys() and len({(a[k], b[k]) for k in a}) == len(set(a.values())) == len(set(b.values()))
    assert all((a[k] == 0) == (b[k] == 0) for k in a)


def test_mesh_counts(spark):
    v = spark.createDataFrame([(1, i * 6 + j, float(j), float(i), 0.0) for i in range(6) for j in range(6)], "scene_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(1, 2 * (i * 5 + j) + t, *((i * 6 + j, i * 6 + j + 1, (i + 1) * 6 + j) if t == 0 else (i * 6 + j + 1, (i + 1) * 6 + j + 1, (i + 1) * 6 + j))) for i in range(5) for j in range(5) for t in range(2)], "scene_id long, fid long, v0 long, v1 long, v2 long")
    near = mesh.adjacency(f)
    assert f.count() == 50 and near.count() == 130
    shaped = mesh.shapes(f, v)
    assert one(shaped.agg(F.sum("area").alias("a"), F.min(F.abs("nz")).alias("n"))).a == pytest.approx(25)
    grown = kernels.grow_regions(shaped.withColumn("label_int", F.lit(0)), near)
    assert grown.select("region").distinct().count() == 1


def test_robust_fit_finds_the_plane(spark):
    r = np.random.default_rng(7)
    good = np.c_[r.uniform(-1, 1, (300, 2)), 0.5 + r.normal(size=300) * 0.002]
    rows = [(1, *map(float, p)) for p in np.r_[good, r.uniform(-1, 1, (120, 3))]] + [(2, float(k), 0.0, 0.0) for k in range(10)]
    t = spark.createDataFrame(rows, "k int, x double, y double, z double")
    a, b = (kernels.robust_fits(t.repartition(n), ["k"], 0.01, 300, 50) for n in (1, 7))
    got = one(a)
    assert abs(got.c) > 0.999 and got.d == pytest.approx(0.5, abs=0.01) and got.ransac_inliers >= 290
    assert [tuple(x) for x in a.collect()] == [tuple(x) for x in b.collect()]
    h = {x.k: x for x in kernels.huber_fits(t.where("k = 1"), ["k"]).collect()}
    assert abs(h[1].c) > 0.9


def test_ray_cast_hits_the_nearest(spark):
    tri = [(1, f, 0, -9.0, -9.0, z, 9.0, -9.0, z, 0.0, 9.0, z) for f, z in ((1, 5.0), (2, 3.0))]
    t = spark.createDataFrame(tri, "scene_id long, fid long, label_int int, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz"))
    rays = spark.createDataFrame([(1, 4, 4), (1, 400, 4)], "scene_id long, v int, u int")
    got = raycast.nearest_hits(rays, t, G.Pinhole(8.0, 8.0, 4.0, 4.0)).collect()
    assert [(r.fid, r.v, r.z) for r in got] == [(2, 4, pytest.approx(3.0))]


def test_joins_and_components(spark):
    p = spark.createDataFrame([(1, "00001"), (2, "frame_00002"), (3, "3"), (4, "zz")], "frame_ord long, pred_key string")
    g = spark.createDataFrame([(1, "00001"), (2, "00002"), (3, "00003"), (4, "00004"), (9, "00009")], "frame_ord long, gt_key string")
    assert {r.gt_key: r.rule for r in joins.prioritised(g, p).collect()} == {"00001": 0, "00002": 2, "00003": 1, "00004": 4, "00009": None}
    nodes = spark.createDataFrame([(s, k) for s in (1, 2) for k in range(6)], "s int, n int")
    pairs = spark.createDataFrame([(1, 5, 4), (1, 4, 3), (2, 0, 5), (2, 2, 2)], "s int, a int, b int")
    got = {(r.s, r.n): r.component for r in graph.components(nodes, pairs, ["s"], "n", "a", "b").collect()}
    assert got == {**{(1, k): min(k, 3) for k in range(6)}, **{(2, k): 0 if k == 5 else k for k in range(6)}}


def test_label_overflow_is_an_error(spark, tmp_path):
    f = spark.createDataFrame([(1, 1, 1, 2, [1, 70000])], "scene_id long, frame_id long, h int, w int, label array<int>")
    with pytest.raises(Exception, match="label overflow"):
        frames.save(f, str(tmp_path / "t"), "label")


@pytest.mark.parametrize("order", ["<", ">"])
def test_ply_forms(order):
    v, f = np.zeros(3, [(a, f"{order}f4") for a in "xyz"]), np.zeros(1, [("n", "u1"), *((c, f"{order}i4") for c in ("a", "b", "c", "plane_id", "label_int"))])
    v["x"], f[0] = [0, 1, 2], (3, 0, 1, 2, 7, 8)
    form = "binary_little_endian" if order == "<" else "binary_big_endian"
    head = f"ply\nformat {form} 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nproperty int plane_id\nproperty int label_int\nend_header\n"
    vv, ff = meshes.parse(head.encode() + v.tobytes() + f.tobytes())
    assert vv["x"].tolist() == [0, 1, 2] and (ff["v2"][0], ff["plane_id"][0]) == (2, 7)
    text = head.replace(form, "ascii") + "0 0 0\n1 0 0\n2 0 0\n3 0 1 2 7 8\n"
    assert meshes.parse(text.encode())[1]["label_int"][0] == 8
    with pytest.raises(ValueError):
        meshes.parse(text.replace("3 0 1 2 7 8", "4 0 1 2 7 8").encode())


def test_half_precision(spark):
    values = [0.1, 1.0 / 3, 2.5, 1000.3, 0.0]
    t = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r[0] for r in t.select(frames.half("x")).collect()] == [float(np.float16(x)) for x in values]


def test_scene_list(spark):
    t = spark.createDataFrame([("a, b",), ("# no",), ("",), ("c",)], "value string")
    assert sorted(r.scene for r in texts.scene_list(t).collect()) == ["a", "b", "c"]


def test_parameters():
    from facetframe import params

    p = params.scaled(params.Extraction(), "metric", 0.01)
    assert p.grow_distance == pytest.approx(1.5) and p.least_area == pytest.approx(1000) and p.grow_degrees == 8.0
    assert params.scaled(params.Extraction(), "original", None) == params.Extraction()
    assert params.cast(params.Evaluation, {"gate": "0.5", "thresholds": "0.1,0.2"}).thresholds == (0.1, 0.2)
    with pytest.raises(KeyError):
        params.cast(params.Evaluation, {"nope": "1"})


def test_segment_merge_joins_one_plane(spark):
    from facetframe.operators import growth

    r = np.random.default_rng(8)
    rows = [(1, 1 + int(x > 0), float(x), float(y), 1.0) for x, y in r.uniform(-1, 1, (200, 2))] + [(1, 3, float(x), float(y), 3.0 + float(x)) for x, y in r.uniform(-1, 1, (100, 2))]
    t = spark.createDataFrame(rows, "f int, label int, x double, y double, z double")
    labels, log = growth.merge_segments(t, ["f"], 10.0, 0.05)
    largest = 1 if sum(x[1] == 1 for x in rows) >= sum(x[1] == 2 for x in rows) else 2
    assert {x.label: x.merged for x in labels.collect()} == {1: largest, 2: largest, 3: 3}
    far, _ = growth.merge_segments(t.withColumn("x", F.when(F.col("label") == 2, F.col("x") + 5).otherwise(F.col("x"))), ["f"], 10.0, 0.05)
    assert {x.label: x.merged for x in far.collect()} == {1: 1, 2: 2, 3: 3}  # of one plane and not adjacent
    assert [(x.a, x.b, x.accepted) for x in log.where("round = 0").collect()] == [(1, 2, True)]


def test_frame_merge_takes_all_pairs_of_a_round(spark):
    """A wall in 60 fragments needs 59 merges; one behind it with another depth stays apart."""
    rows = [(1, 1, v, u, 1 + u // 2, 0.0, 0.0, 1.0, 2.0) for v in range(30) for u in range(120)]
    rows += [(1, 1, 31 + v, u, 61, 0.0, 0.0, 1.0, 9.0) for v in range(10) for u in range(120)]
    rows += [(1, 1, 43, u, 62, 0.0, 0.0, 1.0, 9.0) for u in range(10)]
    px = spark.createDataFrame(rows, "scene_id long, frame_id long, v int, u int, label int, nx double, ny double, nz double, z double")
    got = {r.label: r.merged for r in kernels.merge_segments(px).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 61: 61, 62: 62}


def test_near_in_space_equals_brute_force(spark):
    from facetframe.operators import growth

    r = np.random.default_rng(9)
    p = r.uniform(0, 4, (80, 3))
    label = r.integers(0, 12, 80)
    t = spark.createDataFrame([(1, int(k), *map(float, x)) for k, x in zip(label, p, strict=True)], "f int, label int, x double, y double, z double")
    want = {(int(min(label[i], label[j])), int(max(label[i], label[j]))) for i in range(80) for j in range(i) if label[i] != label[j] and np.linalg.norm(p[i] - p[j]) <= 0.4}
    assert {(x.a, x.b) for x in growth.near_in_space(t, ["f"], 0.4).collect()} == want


def test_extraction_finds_the_flat_halves(spark):
    from facetframe.operators import growth
    from facetframe.params import Extraction

    n = 9
    v = spark.createDataFrame([(1, i * n + j, float(j), float(i), max(0.0, j - 4.0)) for i in range(n) for j in range(n)], "scene_id long, vid long, x double, y double, z double")
    cells = [(i, j, t) for i in range(n - 1) for j in range(n - 1) for t in range(2)]
    f = spark.createDataFrame([(1, k, *((i * n + j, i * n + j + 1, (i + 1) * n + j) if t == 0 else (i * n + j + 1, (i + 1) * n + j + 1, (i + 1) * n + j)), 0) for k, (i, j, t) in enumerate(cells)], "scene_id long, fid long, v0 long, v1 long, v2 long, label_int int")
    got = growth.extract(mesh.shapes(f, v), mesh.adjacency(f), Extraction(least_faces=8, least_area=1.0, rounds=1))
    sizes = sorted(x["count"] for x in got.groupBy("patch").count().collect())
    assert len(sizes) == 2 and min(sizes) >= 56


def test_adapters(spark, tmp_path):
    from facetframe.sources import adapters, arrays

    seg = np.full((4, 6), 20)
    seg[:, :3] = 0
    for frame in range(5):
        (tmp_path / f"3_{frame}_d2.npz").write_bytes(arrays.encode(np.full((4, 6), frame + 1.0), seg, np.eye(3)))
    (tmp_path / "3_9_d2.npz").write_bytes(b"")
    got = {r.frame_id: r for r in adapters.read(spark, "archives", str(tmp_path), 2).collect()}
    assert sorted(got) == [0, 2, 4] and got[2].depth == [3.0] * 24 and got[2].label == [1, 1, 1, 0, 0, 0] * 4
    assert [r.scene_id for r in adapters.scenes(spark, "archives", str(tmp_path)).collect()] == [3]


def test_stream_is_exactly_once(spark, tmp_path):
    from facetframe.streaming import ingest

    px = spark.createDataFrame([(1, f, f % 3, 1) for f in range(12)], SEG)
    px.repartition(3).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.run_available(ingest.contingency_stream(spark, str(tmp_path / "in"), SEG, 1), str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    px.where("frame_id < 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    got = {r.frame_id: r.n for r in ingest.newest(spark, str(tmp_path / "out"), ["scene_id", "frame_id", "gt", "pred"], "n").collect()}
    assert got == {f: 2 if f < 4 else 1 for f in range(12)}


def test_sequential_planes_in_turn(spark):
    """Three planted planes of unlike size and stray points: each is found whole, the largest first; strays stay free."""
    from facetframe.operators import kernels

    r = np.random.default_rng(3)
    rows, want, idx = [], {}, 0
    for size, n, d in ((60, (0.0, 0.0, 1.0), -2.0), (45, (0.6, 0.0, 0.8), -4.0), (30, (0.0, 1.0, 0.0), -1.0)):
        e = np.linalg.svd(np.array([n]))[2][1:]
        for _ in range(size):
            p = r.uniform(-1, 1, 2) @ e - d * np.array(n)
            rows.append((1, idx, *map(float, p), *n))
            want.setdefault(size, set()).add(idx)
            idx += 1
    rows += [(1, idx + k, *map(float, r.uniform(5, 9, 3)), 0.577, 0.577, 0.577) for k in range(12)]
    t = spark.createDataFrame(rows, "scene_id int, idx long, x double, y double, z double, nx double, ny double, nz double")
    got = {}
    for x in kernels.sequential_planes(t, ["scene_id"], 0.02, 0.94, 300, 20, 10).collect():
        got.setdefault(x.plane, set()).add(x.idx)
    assert [got[k] for k in sorted(got)] == [want[60], want[45], want[30]]


def test_huber_plane_equals_plain_steps():
    """Reweighting step by step as it is defined, from the unweighted plane on."""
    from facetframe.operators import kernels

    r = np.random.default_rng(5)
    p = np.c_[r.uniform(-1, 1, (80, 2)), r.normal(0, 0.01, 80)]
    p[:8, 2] += 0.7
    p = p @ np.linalg.qr(r.normal(size=(3, 3)))[0] + [0.3, -2.0, 1.0]

    def plane(w):
        m = (p * w[:, None]).sum(axis=0) / w.sum()
        n = np.linalg.eigh(((p - m) * w[:, None]).T @ (p - m))[1][:, 0]
        d = -float(n @ m)
        return (-n, -d) if d < 0 else (n, d)

    n, d = plane(np.ones(len(p)))
    for _ in range(8):
        far = np.abs(p @ n + d)
        c = 1.345 * 1.4826 * (np.median(far) + 1e-12) + 1e-12
        new, new_d = plane(np.where(far <= c, 1.0, c / np.maximum(far, 1e-300)))
        done = np.linalg.norm(new - n) < 1e-6 and abs(new_d - d) < 1e-6
        n, d = new, new_d
        if done:
            break
    got, got_d = kernels.huber_plane(p)
    assert np.allclose(got, n, atol=1e-7) and abs(got_d - d) < 1e-7


def test_metrics_of_frames_without_planes(spark):
    """A frame with points and no fitted segment has zeros, so scene means are not too high."""
    points = spark.createDataFrame([(1, f, 0 if f == 2 else 1, float(x), float(x * x % 3), 0.0) for f in (1, 2) for x in range(6)], "scene_id int, frame_id int, label int, x double, y double, z double")
    fits = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 1.0, 0.0)], "scene_id int, frame_id int, label int, a double, b double, c double, d double")
    got = {r.frame_id: (r.precision, r.recall) for r in metrics.gated(points, fits, [0.1], [0.5], ["scene_id", "frame_id"]).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0)}


def test_positions_over_ranges(spark):
    """Numbers over all rows, dealt to ranges, equal those of a plain sort, ties included."""
    from facetframe.operators import sampling

    rows = [(k, k * 7919 % 101) for k in range(1000)]
    got = {r.k: r.pos for r in sampling.position(spark.createDataFrame(rows, "k long, x long").repartition(5), ["x", "k"]).collect()}
    assert got == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert sampling.position(spark.createDataFrame([], "k long"), ["k"]).count() == 0
