"""Predictions met with their ground truth, and whole metric rows, against plain versions."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetframe.functions import geometry as G
from facetframe.operators import graph
from facetframe.params import Evaluation
from facetframe.plans import benchmark
from facetframe.sources import datasets, predictions

STORED = "scene_id long, frame_id long, h int, w int, label array<int>"
TRUTH = f"{STORED}, z array<double>, fx double, fy double, cx double, cy double, c2w array<double>"
POSE = [0.0, 0.0, 1.0, 2.0, -1.0, 0.0, 0.0, 0.5, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def plain_met(truth, method, stored):
    """{(scene, frame): labels}: the own number first, then the place; nearest pixels; the non-planar label, then the offset."""
    out = {}
    for scene, frame, (h, w) in truth:
        theirs = sorted(f for s, f in stored if s == scene)
        place = sorted(f for s, f, _ in truth if s == scene).index(frame)
        own = frame if frame in theirs else theirs[place] if method.by_place and place < len(theirs) else None
        if own is None:
            continue
        a = stored[scene, own]
        a = a[(np.arange(h) * a.shape[0] // h)[:, None], (np.arange(w) * a.shape[1] // w)[None]]
        out[scene, frame] = (np.where(a == method.nonplanar, 0, a) + method.offset).ravel().tolist()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_predictions_equal_a_plain_version(spark, seed):
    r = np.random.default_rng(seed)
    truth = [(s, int(f), (int(r.integers(1, 7)), int(r.integers(1, 7)))) for s in range(3) for f in r.choice(12, 6, replace=False)]
    rows = [(s, f, h, w, [1] * (h * w), [1.0] * (h * w), 1.0, 1.0, 0.0, 0.0, POSE) for s, f, (h, w) in truth]
    methods, want = [], {}
    for name, offset, nonplanar, by_place in (("plain", 0, None, False), ("moved", 2, -1, True), ("zeroed", 0, 3, True)):
        # numbers that other frames have too: the own number must win over the place
        stored = {(s, int(f)): r.integers(-1, 4, r.integers(1, 9, 2)) for s in range(3) for f in r.choice(9, int(r.integers(0, 7)), replace=False)}
        frame = spark.createDataFrame([(s, f, *a.shape, a.ravel().tolist()) for (s, f), a in stored.items()], STORED)
        method = predictions.Method(name, frame, offset, nonplanar, by_place)
        methods.append(method)
        want |= {(name, *k): v for k, v in plain_met(truth, method, stored).items()}
    got = predictions.met(spark.createDataFrame(rows, TRUTH), [*methods, predictions.Method("truth")]).collect()
    assert {(g.method, g.scene_id, g.frame_id): g.pred for g in got if g.method != "truth"} == want
    assert sum(g.method == "truth" for g in got) == len(truth) and all(g.pred == g.label for g in got if g.method == "truth")
    assert len(got) == len(want) + len(truth)


def test_row_cameras_turn_and_move(spark):
    px = spark.createDataFrame([(3, 1, 2.0, 4.0, 8.0, 1.0, 2.0, POSE), (3, 1, 2.0, 4.0, 8.0, 1.0, 2.0, datasets.IDENTITY)], "u int, v int, z double, fx double, fy double, cx double, cy double, c2w array<double>")
    turned, still = px.select(*[c.alias(n) for c, n in zip(G.row_backproject(), "xyz", strict=True)]).collect()
    assert tuple(still) == (1.0, -0.25, 2.0)
    assert tuple(turned) == (4.0, -0.5, 1.25)


def _truth(spark, frames):
    """Frames of 8 x 8: a plane at depth 2 on the left, a rough surface on the right."""
    u = np.tile(np.arange(8), 8)
    rough = np.where(u < 4, 2.0, 2.0 + 0.3 * np.sin(np.arange(64) * 1.7))
    label = np.where(u < 4, 1, 2).tolist()
    return spark.createDataFrame([(s, f, 8, 8, label, (rough if z else 0 * rough).tolist(), 10.0, 10.0, 3.5, 3.5, POSE) for s, f, z in frames], TRUTH)


def test_methods_are_compared(spark):
    truth = _truth(spark, [(1, 1, True), (1, 2, True), (2, 7, True), (2, 9, False)])
    flat = spark.createDataFrame([(1, 1, 1, 1, [5]), (2, 7, 2, 2, [1, 0, 1, 0])], STORED)
    p = Evaluation(thresholds=(0.01,), gates=(0.5, 0.9), support=10)
    stored = [predictions.Method("flat", flat), predictions.Method("truth"), predictions.Method("none", flat.limit(0))]
    rows, scenes, datasets_ = benchmark.compared(truth, stored, p)
    by = {(r.method, r.scene_id, r.frame_id): r for r in rows.collect()}
    assert set(by) == {("flat", 1, 1), ("flat", 2, 7), *(("truth", s, f) for s, f in ((1, 1), (1, 2), (2, 7), (2, 9)))}
    own = by["truth", 1, 1]
    assert own.sc == own.rand_index == 1.0
    # the rough half has no plane of enough support: precision is over the flat one, recall over all points
    assert own.prec_1cm_gate0_5 == own.prec_1cm_gate0_9 == 1.0 and own.rec_1cm_gate0_9 == pytest.approx(0.5)
    assert by["truth", 2, 9].rec_1cm_gate0_5 == 0.0 and by["truth", 2, 9].sc == 1.0
    # half of all pixels are one plane: the lower gate is met by one segment over all, the higher is not
    one = by["flat", 1, 1]
    assert one.sc == pytest.approx(0.5) and one.prec_1cm_gate0_9 == 0.0 and one.prec_1cm_gate0_5 >= 0.5
    # a right half without a plane is no segment: precision is over the left one, recall over all points
    left = by["flat", 2, 7]
    assert (left.prec_1cm_gate0_9, left.rec_1cm_gate0_9) == (1.0, pytest.approx(0.5))
    assert {(s.method, s.scene_id): s.num_frames for s in scenes.collect()} == {("flat", 1): 1, ("flat", 2): 1, ("truth", 1): 2, ("truth", 2): 2}
    ends = {d.method: d for d in datasets_.collect()}
    assert {k: (d.skipped_frames, d.num_scenes, d.num_frames_total) for k, d in ends.items()} == {"flat": (2, 2, 2), "truth": (0, 2, 4), "none": (4, 0, 0)}
    assert ends["none"].sc_mean is None and ends["truth"].sc_mean == 1.0
    assert ends["truth"].rec_1cm_gate0_9_mean == pytest.approx((0.5 + 0.25) / 2)


def test_an_empty_ground_truth(spark):
    rows, scenes, whole = benchmark.compared(_truth(spark, [(1, 1, True)]).limit(0), [predictions.Method("truth")], Evaluation(thresholds=(0.01,)))
    assert rows.count() == scenes.count() == 0
    assert [(d.method, d.skipped_frames, d.num_scenes) for d in whole.collect()] == [("truth", 0, 0)]


def test_gates_share_their_fits(spark):
    """Each gate's columns are those of a run with that gate alone."""
    truth = _truth(spark, [(1, 1, True), (1, 2, True)])
    px = truth.select("scene_id", "frame_id", F.posexplode(F.arrays_zip("label", "z")).alias("k", "p")).selectExpr("scene_id", "frame_id", "k div 8 as v", "k % 8 as u", "p.label as gt", "p.label as pred", "p.z as z")
    camera = G.Pinhole(10.0, 10.0, 3.5, 3.5)
    p = Evaluation(thresholds=(0.01, 0.2), gates=(0.5, 0.95), support=10)
    both = {tuple(r[:2]): r for r in benchmark.judged(px, camera, p).collect()}
    for gate in p.gates:
        for r in benchmark.judged(px, camera, Evaluation(thresholds=p.thresholds, gate=gate, support=10)).collect():
            for name in benchmark.plane_columns(Evaluation(thresholds=p.thresholds, gate=gate)):
                assert math.isclose(r[name], both[tuple(r[:2])][name])


def test_points_are_not_broadcast(spark):
    """Pixels are a few bits each in their file, so by its size all of them would go through the driver."""
    px = graph.written(_truth(spark, [(1, 1, True), (1, 2, True)]).select("scene_id", "frame_id", F.posexplode(F.arrays_zip("label", "z")).alias("k", "p")).selectExpr("scene_id", "frame_id", "k div 8 as v", "k % 8 as u", "p.label as pred", "p.z as z"))
    p = Evaluation(thresholds=(0.01, 0.2), gates=(0.5, 0.95))
    got = benchmark.plane_metrics(px, G.Pinhole(10.0, 10.0, 3.5, 3.5), p, benchmark.least_squares_fits)
    plan = got._jdf.queryExecution().executedPlan().toString()
    met = re.findall(r"(\w+Join) \[[^]]*label#", plan)
    # planes of least squares meet the points once, for both thresholds
    assert met == ["SortMergeJoin"]
    alone = [benchmark.plane_metrics(px, G.Pinhole(10.0, 10.0, 3.5, 3.5), Evaluation(thresholds=(t,), gates=p.gates), benchmark.least_squares_fits) for t in p.thresholds]
    want = alone[0].join(alone[1], ["scene_id", "frame_id"]).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_edges_alone_bridge_as_all_pixels_do(spark):
    """Blocks of labels with insides, gaps and missing pixels, against the nearest pixel of all."""
    from facetframe.operators import joins

    r = np.random.default_rng(4)
    for seed in range(3):
        a = np.kron(r.integers(0, 4, (4, 4)), np.ones((3, 3), int))
        a[r.uniform(size=a.shape) < 0.2] = 0
        seen = {(v, u): int(a[v, u]) for v in range(12) for u in range(12) if seed != 2 or r.uniform() < 0.9}
        wide = {}
        for (v, u), label in seen.items():
            near = min((((v - y) ** 2 + (u - x) ** 2, y, x, k) for (y, x), k in seen.items() if k > 0), default=None)
            wide[v, u] = label if label > 0 else near[3] if near and near[0] <= 4 else 0
        pairs = {(*sorted((k, wide[at])),) for (v, u), k in wide.items() for at in ((v + 1, u), (v, u + 1)) if k and wide.get(at) and wide[at] != k}
        px = spark.createDataFrame([(1, v, u, k) for (v, u), k in seen.items()], "f int, v int, u int, label int")
        assert {(x.a, x.b) for x in joins.bridged_pairs(px, "label", 2, ["f"]).collect()} == pairs


def test_adjacency_by_samples(spark):
    from facetframe.operators import growth

    r = np.random.default_rng(8)
    rows = [(1, k, *map(float, r.uniform(0, 1, 3) + (3 * k, 0, 0))) for k in range(3) for _ in range(200)]
    t = spark.createDataFrame(rows, "f int, label int, x double, y double, z double")
    some = growth.sampled(t, ["f"], 50)
    assert {x.label: x["count"] for x in some.groupBy("label").count().collect()} == {0: 50, 1: 50, 2: 50}
    again = growth.sampled(t.repartition(7), ["f"], 50)
    assert some.exceptAll(again).isEmpty() and some.join(t, t.columns, "left_anti").isEmpty()
    pairs = lambda *a, **k: {(x.a, x.b) for x in growth.adjacent(t, ["f"], *a, **k).collect()}
    assert pairs(3.0) == {(0, 1), (1, 2)} and pairs(0.1) == set()
    # labels 1 and 2 touch in the raster, 7 has no points
    raster = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 0), (1, 0, 2, 2), (1, 0, 3, 7)], "f int, v int, u int, label int")
    assert pairs(0.1, raster, 1) == {(1, 2)} and pairs(3.0, raster, 1, None) == {(0, 1), (1, 2)}


def test_archives_without_intrinsics_have_none(spark):
    from facetframe.sources import arrays

    seg = np.array([[0, 20], [1, 0]])
    k = np.array([[10.0, 0, 1.0], [0, 20.0, 0.5], [0, 0, 1]])
    rows = [("a", arrays.encode(np.array([[1.0, 2.0], [3.0, 4.0]]), seg, np.eye(3), k)), ("b", arrays.encode(np.ones((2, 2)), seg, np.eye(3))), ("c", b"")]
    got = {r.path: r for r in arrays.at_size(arrays.decoded(spark.createDataFrame(rows, "path string, content binary")), 4, 2).collect()}
    assert set(got) == {"a", "b"} and got["b"].fx is None and got["b"].cy is None
    a = got["a"]
    assert (a.h, a.w, a.fx, a.fy, a.cx, a.cy) == (4, 2, 10.0, 40.0, 1.0, 1.0)
    assert a.label == [1, 0, 1, 0, 2, 1, 2, 1] and a.depth == [1.0, 2.0, 1.0, 2.0, 3.0, 4.0, 3.0, 4.0]
