"""The benchmark as one plan: signals to segments, joined with ground truth, metrics of frames, scenes and the dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, kernels, metrics, planes, rollup, stencil
from ..params import Evaluation, Segmentation
from ..sources import frames, predictions

#: A pixel's world coordinates: a camera for all frames, or a function for columns of the pixel's own row.
Camera = G.Pinhole | Callable[[], list[Column]]

METRICS = ["sc", "rand_index", "voi", "bp_accuracy", "bp_precision", "bp_recall", "bp_f1", "bp_iou"]
FRAME = ["scene_id", "frame_id"]


def segmented(signals: DataFrame, p: Segmentation = Segmentation()) -> DataFrame:
    """Pixels (scene_id, frame_id, v, u) with their planar region."""
    on = stencil.connected(signals, p.degrees, p.relative, p.neighbours, p.planarity)
    return kernels.label_regions(on, "connected")


def ransac_fits(points: DataFrame, p: Evaluation, threshold: float) -> DataFrame:
    """Planes of the segments by RANSAC at the threshold that they are judged by."""
    return kernels.robust_fits(points, [*FRAME, "label"], threshold, p.iterations, p.support, p.seed)


def least_squares_fits(points: DataFrame, p: Evaluation, threshold: float) -> DataFrame:
    """Planes of the segments over all their points: one aggregation, whatever the threshold."""
    return planes.fit(points, [*FRAME, "label"])


def plane_metrics(both: DataFrame, camera: Camera, p: Evaluation = Evaluation(), fits: Callable = ransac_fits) -> DataFrame:
    """Gated precision and recall of each frame, a column for each threshold and gate, from pixels with z and their predicted segment.

    Planes are fitted once a threshold, whatever the number of gates; those of least squares are the same for all thresholds, so they
    meet the points once.
    """
    xyz = [c.alias(n) for c, n in zip(G.backproject(camera) if isinstance(camera, G.Pinhole) else camera(), "xyz", strict=True)]
    points = both.where(G.valid_depth("z")).select(*FRAME, F.col("pred").alias("label"), *xyz)
    own = points.where("label <> 0")
    turns = [p.thresholds] if fits is least_squares_fits else [(t,) for t in p.thresholds]
    each = [metrics.gated(points, fits(own, p, t[0]).select(*FRAME, "label", "a", "b", "c", "d"), list(t), p.judged, FRAME) for t in turns]
    long = each[0]
    for more in each[1:]:
        long = long.union(more)
    return metrics.wide(long, FRAME, list(p.thresholds), p.judged)


def plane_columns(p: Evaluation) -> list[str]:
    return [f"{m}_{t * 100:g}cm_gate{g:g}".replace(".", "_") for t in p.thresholds for g in p.judged for m in ("prec", "rec")]


def judged(both: DataFrame, camera: Camera | None = None, p: Evaluation = Evaluation(), fits: Callable = ransac_fits) -> DataFrame:
    """The metric row of every frame from its pixels (gt, pred and, with a ``camera``, z); without a valid depth planes have zeros."""
    rows = metrics.frame_metrics(both)
    return rows if camera is None else rows.join(plane_metrics(both, camera, p, fits), FRAME, "left").fillna(0.0, plane_columns(p))


def evaluated(pred: DataFrame, gt: DataFrame, camera: Camera | None = None, p: Evaluation = Evaluation(), fits: Callable = ransac_fits) -> DataFrame:
    """Metrics of every frame that both have (pred: region; gt: label and, for the metrics of planes, z), from one join by pixel.

    With a ``camera`` the row has the gated precision and recall of the predicted planes too; frames without a valid
    depth have zeros there.
    """
    pixel = [*FRAME, "v", "u"]
    both = pred.select(*pixel, pred["region"].alias("pred")).join(gt.select(*pixel, gt["label"].alias("gt"), *(["z"] if camera else [])), pixel)
    # written once: the metrics read the pixels many times, and each time would segment all frames again
    return judged(graph.written(both), camera, p, fits)


def compared(truth: DataFrame, stored: list[predictions.Method], p: Evaluation = Evaluation(), fits: Callable = ransac_fits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frame, scene and dataset rows of several methods over one ground truth of frames with cameras of their own.

    ``truth``: scene_id, frame_id, h, w, label, z, fx, fy, cx, cy, c2w, as ``datasets.outdoor`` gives. Frames meet as whole rows of
    arrays, so no pixel is shuffled to meet another; a method takes part in the groups' key, so all methods go on together.
    A frame without a prediction is left out of its method's rows and counted in ``skipped_frames``; a method that has none
    at all has a dataset row of zeros and nulls.
    """
    met = graph.written(predictions.met(truth, stored))
    arrays = met.select("scene_id", F.struct("method", "frame_id").alias("frame_id"), "w", "label", "pred", "z", "fx", "fy", "cx", "cy", "c2w")
    camera = ["fx", "fy", "cx", "cy", "c2w"]
    px = frames.exploded(arrays, ["label", "pred", "z"], camera).withColumnRenamed("label", "gt")
    rows = judged(px, G.row_backproject, p, fits).withColumns({"method": F.col("frame_id.method"), "frame_id": F.col("frame_id.frame_id")})
    rows = graph.written(rows)
    names = METRICS + plane_columns(p)
    scenes = rollup.by_scene(rows, names, ("method",))
    had = met.groupBy("method").agg(F.count("*").alias("had"))
    named = F.explode(F.array(*[F.lit(m.name) for m in stored])).alias("method")
    every = truth.agg(F.count("*").alias("of")).select(named, "of").join(had, "method", "left")
    skipped = every.select("method", (F.col("of") - F.coalesce("had", F.lit(0))).alias("skipped_frames"))
    return rows, scenes, skipped.join(rollup.dataset(scenes, names, ("method",)), "method", "left").fillna(0, ["num_scenes", "num_frames_total"])


def results(rows: DataFrame, p: Evaluation | None = None) -> tuple[DataFrame, DataFrame]:
    """Scene and dataset levels of frame metrics, with those of planes if ``p`` is given."""
    names = METRICS + (plane_columns(p) if p else [])
    scenes = rollup.by_scene(rows, names)
    return scenes, rollup.dataset(scenes, names)
