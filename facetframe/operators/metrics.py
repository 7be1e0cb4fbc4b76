"""Segmentation metrics of label rasters: everything follows from the contingency table of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["scene_id", "frame_id"]


def contingency(px: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Pixels of a frame by ground-truth and predicted label; partial counts are combined before the shuffle."""
    return px.groupBy(*FRAME, F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _margins(px: DataFrame) -> DataFrame:
    # the table of a frame is tiny: dealt by frame once, all sums below need no further shuffle
    table = contingency(px).repartition(*FRAME)
    of = lambda *k: F.sum("n").over(Window.partitionBy(*FRAME, *k))
    return table.withColumns({"rows": of("gt"), "cols": of("pred"), "total": of()})


def segmentation_covering(px: DataFrame) -> DataFrame:
    """Mean best overlap (IoU) of the ground-truth segments of a frame, weighted by area; the background is a segment too."""
    best = _margins(px).groupBy(*FRAME, "gt").agg(F.max(F.col("n") / (F.col("rows") + F.col("cols") - F.col("n"))).alias("iou"), F.max("rows").alias("area"))
    return best.groupBy(*FRAME).agg((F.sum(F.col("area") * F.col("iou")) / F.sum("area")).alias("sc"))


def clustering(px: DataFrame) -> DataFrame:
    """Rand index and variation of information (bits) of a frame."""
    m = _margins(px)
    n, r, c, t = (F.col(x).cast("double") for x in ("n", "rows", "cols", "total"))
    sums = m.groupBy(*FRAME).agg(
        F.max(t).alias("t"), F.sum(n * n).alias("nn"), F.sum(n * r).alias("rr"), F.sum(n * c).alias("cc"), F.sum(n / t * (F.log2(n / r) + F.log2(n / c))).alias("h")
    )  # sum(n * rows) is the sum of squared row totals
    pairs = F.col("t") * F.col("t") - F.col("t")
    rand = F.when(pairs == 0, 1.0).otherwise((F.col("t") * F.col("t") + 2 * F.col("nn") - F.col("rr") - F.col("cc") - F.col("t")) / pairs)
    return sums.select(*FRAME, rand.alias("rand_index"), F.abs(F.col("h")).alias("voi"))


def _over(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def binary_scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    p, r = _over(tp, tp + fp), _over(tp, tp + fn)
    return {
        "bp_accuracy": _over(tp + tn, tp + fp + fn + tn),
        "bp_precision": p,
        "bp_recall": r,
        "bp_f1": 2 * p * r / F.greatest(p + r, F.lit(1e-8)),
        "bp_iou": _over(tp, tp + fp + fn),
    }


def binary_planarity(px: DataFrame, background: int = 0) -> DataFrame:
    """Planar against non-planar scores of a frame, with guarded denominators."""
    g, q = F.col("gt") != background, F.col("pred") != background
    counts = px.groupBy(*FRAME).agg(F.count_if(g & q).alias("tp"), F.count_if(~g & q).alias("fp"), F.count_if(g & ~q).alias("fn"), F.count_if(~g & ~q).alias("tn"))
    return counts.select(*FRAME, *[c.alias(k) for k, c in binary_scores(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))).items()])


def frame_metrics(px: DataFrame) -> DataFrame:
    """All label metrics of a frame in one row."""
    return segmentation_covering(px).join(clustering(px), FRAME).join(binary_planarity(px), FRAME)


def gated(points: DataFrame, planes: DataFrame, thresholds: list[float], gates: list[float], keys: list[str], total: str = "all") -> DataFrame:
    """Inlier precision and recall for each threshold and gate, in long form.

    ``points``: keys, label, x, y, z; ``planes``: keys, label, a, b, c, d of the fitted segments. A segment counts if its
    inlier share reaches the gate. Precision is over the points of fitted segments, recall over all points.
    """
    on = [*keys, "label"]
    residual = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))
    # points are small in their files and large in memory, so they may not be broadcast by their size
    hit = points.join(planes.hint("merge"), on).withColumn("residual", residual)
    per = hit.groupBy(*on).agg(F.count("*").alias("n"), *[F.count_if(F.col("residual") < t).alias(f"in{k}") for k, t in enumerate(thresholds)])
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(g)).alias("gate"), F.col(f"in{k}").alias("inliers")) for k, t in enumerate(thresholds) for g in gates])
    long = per.select(*on, "n", F.explode(cells).alias("c")).select(*on, "n", "c.*")
    sums = long.groupBy(*keys, "threshold", "gate").agg(F.sum(F.when(F.col("inliers") >= F.col("gate") * F.col("n"), F.col("inliers")).otherwise(0)).alias("kept"), F.sum("n").alias("fitted"))
    # every group and cell has a row: without a fitted segment both are 0
    every = points.groupBy(*keys).agg(F.count("*").alias(total)) if keys else points.agg(F.count("*").alias(total))
    grid = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(g)).alias("gate")) for t in thresholds for g in gates])
    every = every.select(*keys, total, F.explode(grid).alias("c")).select(*keys, total, "c.*")
    both = every.join(sums, [*keys, "threshold", "gate"], "left")
    ratio = lambda d: F.when(F.col(d) > 0, F.coalesce("kept", F.lit(0)) / F.col(d)).otherwise(0.0)
    return both.select(*keys, "threshold", "gate", ratio("fitted").alias("precision"), ratio(total).alias("recall"))


def plane_precision_recall(planes: DataFrame, total_points: Column) -> DataFrame:
    """Per plane: refined inliers over its points and over all points; sums over the planes are the global values."""
    return planes.withColumns({"precision": F.col("refined_inliers") / F.greatest("num_points", F.lit(1)), "recall": F.col("refined_inliers") / F.greatest(total_points, F.lit(1))})


def wide(long: DataFrame, keys: list[str], thresholds: list[float], gates: list[float]) -> DataFrame:
    """One column for each metric, threshold and gate, from an explicit list so that the schema does not depend on the data."""
    out = []
    for t in thresholds:
        for g in gates:
            here = (F.col("threshold") == t) & (F.col("gate") == g)
            name = f"{t * 100:g}cm_gate{g:g}".replace(".", "_")
            out += [F.max(F.when(here, F.col("precision"))).alias(f"prec_{name}"), F.max(F.when(here, F.col("recall"))).alias(f"rec_{name}")]
    return long.groupBy(*keys).agg(*out) if keys else long.agg(*out)
