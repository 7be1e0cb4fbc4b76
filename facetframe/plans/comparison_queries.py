"""Whole metric rows: many gates, distances along rays, and methods compared over an outdoor dataset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import growth
from ..params import Evaluation
from ..session import shared_path
from ..sources import arrays, datasets, frames, predictions
from . import benchmark
from ._common import registrar, rounded
from .dataset_queries import _A, _B, _RAY, _outdoor_root
from .fixtures import sql, view
from .frame_queries import CAMERA, MATRIX, X, Y
from .label_queries import _BP, _CL, _SC, PX
from .plane_queries import _fit

QUERIES, query = registrar()

GRID = sql("px_grid")
GATES = Evaluation(thresholds=(0.005, 0.05), gates=(0.5, 0.7, 0.8, 0.9))
#: Predicted segments that miss the edge between the two planes by a few columns, in each frame by others.
EDGE = "case when u < 12 + frame_id % 5 then 1 when u > 29 then 0 else 2 end"


def _row_sql(pixels: str, x: str, y: str, z: str, p: Evaluation) -> str:
    """CTEs that end in ``rows``, the metric row of each frame of ``pixels`` (scene_id, frame_id, v, u, z, gt, pred)."""
    labels = ", ".join(c.replace(PX, "px2") for c in (_SC, _CL, _BP))
    off = "abs(f.a * p.x + f.b * p.y + f.c * p.z + f.d)"
    near = ", ".join(f"count(*) filter ({off} < {t}) as k{i}" for i, t in enumerate(p.thresholds))
    cells = [(i, j, g) for i in range(len(p.thresholds)) for j, g in enumerate(p.judged)]
    kept = ", ".join(f"sum(case when k{i} >= {g} * k then k{i} else 0 end)::double as g{i}_{j}" for i, j, g in cells)
    names = benchmark.plane_columns(p)
    shares = ", ".join(f"coalesce(g{i}_{j} / fitted, 0) as {names[2 * n]}, coalesce(g{i}_{j} / n9, 0) as {names[2 * n + 1]}" for n, (i, j, _) in enumerate(cells))
    return f"""px2 as ({pixels}), {labels}, pts as (select scene_id, frame_id, pred as label, {x} as x, {y} as y, {z} as z from px2 where z > 0),
    {_fit("(select * from pts where label <> 0)", "scene_id, frame_id, label")},
    per as (select p.scene_id, p.frame_id, p.label, count(*) as k, {near} from pts p join fit f using (scene_id, frame_id, label) group by all),
    kept as (select scene_id, frame_id, sum(k) as fitted, {kept} from per group by all), al as (select scene_id, frame_id, count(*) as n9 from pts group by all),
    rows as (select * from sc join cl using (scene_id, frame_id) join bp using (scene_id, frame_id) left join (select scene_id, frame_id, {shares} from al left join kept using (scene_id, frame_id)) pm using (scene_id, frame_id))"""


def _columns(p: Evaluation) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in benchmark.METRICS) + ", " + ", ".join(f"round(coalesce({c}, 0), 6) as {c}" for c in benchmark.plane_columns(p))


#: Depths of every seventh frame are missing, so its planes have zeros.
_NO_DEPTH = f"select scene_id, frame_id, v, u, case when frame_id % 7 = 0 then 0.0 else z end as z, label as gt, {EDGE} as pred from {GRID} p"


def _pixels(spark, sf):
    px = view(spark, sf, "px_grid").withColumns({"z": F.when(F.col("frame_id") % 7 == 0, 0.0).otherwise(F.col("z")), "region": F.expr(EDGE)})
    return px.select("scene_id", "frame_id", "v", "u", "region"), px.drop("region")


@query("a10_gates_row", f"with {_row_sql(_NO_DEPTH, X, Y, 'z', GATES)} select scene_id, frame_id, {_columns(GATES)} from rows")
def a10_gates(spark, sf):
    """One plane for each segment and threshold, judged at four gates."""
    pred, gt = _pixels(spark, sf)
    return rounded(benchmark.evaluated(pred, gt, CAMERA, GATES, benchmark.least_squares_fits))


_ALONG = [f"(z * ({c}) / {_RAY})" for c in (f"{_A} * 0.6 + 0.01", f"{_B} * 0.45 - 0.02", "-1.0")]


@query("a10_distance_row", f"with {_row_sql(_NO_DEPTH, *_ALONG, GATES)} select scene_id, frame_id, {_columns(GATES)} from rows")
def a10_distance(spark, sf):
    """Depth is the distance along the ray of a matrix camera."""
    pred, gt = _pixels(spark, sf)
    return rounded(benchmark.evaluated(pred, gt, lambda: G.matrix_backproject("z", MATRIX, 32, 24), GATES, benchmark.least_squares_fits))


def _methods(spark, sf):
    """Half-sized rasters without every fourth frame, frames numbered anew with labels from -1 up, a method without frames, and the truth."""
    at, px = shared_path(spark, "methods"), view(spark, sf, "px_grid")
    half = px.where("v % 2 = 0 and u % 2 = 0 and frame_id % 4 <> 1").selectExpr("scene_id", "frame_id", "v div 2 as v", "u div 2 as u", "case label when 0 then 7 else label end as label")
    places = frames.packed(px.withColumn("label", F.expr(f"{EDGE} - 1")), ["label"])
    places = predictions._placed(places, ["scene_id"]).withColumn("frame_id", F.lit(10_000_000) + 5 * F.col("place")).drop("place")
    frames.save(frames.packed(half, ["label"]), f"{at}/half")
    frames.save(places, f"{at}/places")
    stored = lambda name: frames.read(spark, f"{at}/{name}").withColumn("scene_id", F.col("scene_id").cast("long"))
    return [
        predictions.Method("half", stored("half"), nonplanar=7),
        predictions.Method("places", stored("places"), offset=1, by_place=True),
        predictions.Method("none", stored("half").where("frame_id < 0")),
        predictions.Method("truth"),
    ]


_HALF = "case when 2 * (u // 2) < 15 then 1 when 2 * (u // 2) > 16 then 2 else 0 end"
_THREE = f"""select scene_id, frame_id * 10 + m as frame_id, v, u, z, label as gt, case m when 0 then {_HALF} when 1 then {EDGE} else label end as pred
    from {GRID} p, (select unnest([0, 1, 3]) as m) ms where m <> 0 or frame_id % 4 <> 1"""
_NAMED = "(select unnest(['half', 'places', 'none', 'truth']) as method, unnest([0, 1, 2, 3]) as m)"
_MEANS = benchmark.METRICS + benchmark.plane_columns(GATES)


def _compared(spark, sf):
    truth = datasets.outdoor(spark, _outdoor_root(spark, sf))
    return benchmark.compared(truth, _methods(spark, sf), GATES, benchmark.least_squares_fits)


_OUTDOOR = f"with {_row_sql(_THREE, X, Y.replace('11.5', '(scene_id + 0.5)'), 'z', GATES)}"


@query("d06_outdoor_frames", f"{_OUTDOOR} select method, scene_id, frame_id // 10 as frame_id, {_columns(GATES)} from rows join {_NAMED} n on m = frame_id % 10")
def d06_frames(spark, sf):
    return rounded(_compared(spark, sf)[0])


@query("d06_outdoor_benchmark", f"""{_OUTDOOR}, s as (select frame_id % 10 as m, scene_id, count(*) as num_frames, {", ".join(f"avg({c}) as {c}" for c in _MEANS)} from rows group by all),
    d as (select m, count(*) as num_scenes, sum(num_frames)::bigint as num_frames_total, {", ".join(f"avg({c}) as {c}_mean, stddev_samp({c}) as {c}_std" for c in _MEANS)} from s group by all)
    select method, (select count(distinct frame_id) from {GRID} g) - coalesce(num_frames_total, 0) as skipped_frames, coalesce(num_scenes, 0) as num_scenes, coalesce(num_frames_total, 0) as num_frames_total,
    {", ".join(f"round({c}_{k}, 5) as {c}_{k}" for c in _MEANS for k in ("mean", "std"))} from {_NAMED} n left join d using (m)""")  # fmt: skip
def d06_outdoor(spark, sf):
    return rounded(_compared(spark, sf)[2], digits=5)


def _archives(spark, sf):
    """Every frame as an NPZ archive, with intrinsics in three frames of four."""

    def archive(batches):
        for b in batches:
            for r in b.itertuples():
                seg = np.array(r.label).reshape(r.h, r.w)
                k = np.array([[40.0, 0, 15.5], [0, 40.0 + r.scene_id, 11.5], [0, 0, 1]]) if r.frame_id % 4 else None
                yield pd.DataFrame({"path": [f"{r.scene_id}_{r.frame_id}_d2.npz"], "content": [arrays.encode(np.array(r.z).reshape(r.h, r.w), np.where(seg == 0, 20, seg - 1), np.eye(3), k)]})

    packed = frames.packed(view(spark, sf, "px_grid"), ["z", "label"])
    return packed.mapInPandas(archive, "path string, content binary")


@query("s07_npz_at_size", f"""select p.scene_id, p.frame_id, 36::int as h, 16::int as w, case when p.frame_id % 4 > 0 then 20.0::double end as fx, case when p.frame_id % 4 > 0 then 1.5 * (40 + p.scene_id)::double end as fy,
    case when p.frame_id % 4 > 0 then 7.75::double end as cx, case when p.frame_id % 4 > 0 then 17.25::double end as cy, count(*) filter (label > 0) as planar, round(sum(z::float), 3) as depth
    from {GRID} p join (select unnest(range(36)) * 24 // 36 as v) a using (v) where u % 2 = 0 group by all""")  # fmt: skip
def s07_at_size(spark, sf):
    """Frames of 24 x 32 read at 36 x 16: intrinsics follow each axis."""
    rows = arrays.at_size(arrays.decoded(_archives(spark, sf)), 36, 16)
    name = F.split("path", "_")
    total = F.aggregate("depth", F.lit(0.0), lambda s, x: s + x)
    return rows.select(name[0].cast("long").alias("scene_id"), name[1].cast("long").alias("frame_id"), "h", "w", "fx", "fy", "cx", "cy", F.size(F.filter("label", lambda x: x > 0)).cast("long").alias("planar"), F.round(total, 3).alias("depth"))


#: Segments touch in some frames only, are near in others, and both in the rest.
_APART = f"(select scene_id, frame_id, v, u, z + case when u > 16 and frame_id % 3 = 0 then 5.0 else 0.0 end as z, case when label = 2 and u < 17 + frame_id % 4 then 0 else label end as label from {GRID} p)"
_XYZ = f"(select scene_id, frame_id, label, {X} as x, {Y} as y, z from {_APART} p where label > 0)"


@query("j18_adjacent_segments", f"""with g as (select * from {_APART} q), c as (select * from {_XYZ} q),
    close as (select distinct a.scene_id, a.frame_id from c a join c b on a.scene_id = b.scene_id and a.frame_id = b.frame_id and a.label = 1 and b.label = 2 where sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.75),
    ends as (select scene_id, frame_id, max(u) filter (label = 1) as l, min(u) filter (label = 2) as r from g group by all)
    select scene_id, frame_id, 1::int as a, 2::int as b from ends where l + 2 + 1 >= r - 2 union select scene_id, frame_id, 1::int, 2::int from close""")  # fmt: skip
def j18_adjacent(spark, sf):
    """Touching once background within two pixels is taken up, or near in space; a third of the frames are torn apart in depth."""
    moved = view(spark, sf, "px_grid").withColumns({"z": F.expr("z + case when u > 16 and frame_id % 3 = 0 then 5.0D else 0.0D end"), "label": F.expr("case when label = 2 and u < 17 + frame_id % 4 then 0 else label end")})
    xyz = moved.where("label > 0").select("scene_id", "frame_id", "label", *[c.alias(n) for c, n in zip(G.backproject(CAMERA), "xyz", strict=True)])
    return growth.adjacent(xyz, ["scene_id", "frame_id"], 0.75, moved, 2)
