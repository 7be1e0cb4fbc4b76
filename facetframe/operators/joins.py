"""Key lookups of the benchmark: prioritised keys, semi and anti joins, overlaps and splats."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .kernels import touching
from .sampling import position


def matched(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Ground-truth frames with a flag for those that a prediction exists for."""
    found = pred.select(*keys).distinct().withColumn("found", F.lit(True))
    return gt.join(found, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _number(c: str):
    return F.col(c).try_cast("bigint")


def prioritised(gt: DataFrame, pred: DataFrame, gt_key: str = "gt_key", pred_key: str = "pred_key", ordinal: str | None = "frame_ord") -> DataFrame:
    """``gt`` with the prediction of the first rule that finds one: equal key, equal number, ``frame_`` before the key, ordinal position.

    One join for each rule, each on a plain key; repeated prediction keys take the smallest.
    """
    def side(key, rank: int) -> DataFrame:
        return pred.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.min(pred_key).alias(f"m{rank}"))

    out = gt
    stripped = lambda c: F.regexp_replace(F.col(c), "^0+(?=.)", "")
    rules = [(F.col(gt_key), F.col(pred_key)), (stripped(gt_key), stripped(pred_key)), (F.concat(F.lit("frame_"), F.col(gt_key)), F.col(pred_key)), (_number(gt_key), _number(pred_key))]
    for rank, (left, right) in enumerate(rules):
        out = out.withColumn("_k", left).join(side(right, rank).withColumnRenamed("k", "_k"), "_k", "left").drop("_k")
    names = [f"m{k}" for k in range(len(rules))]
    if ordinal:
        out = out.join(pred.groupBy(F.col(ordinal)).agg(F.min(pred_key).alias("m_ord")), ordinal, "left")
        names.append("m_ord")
    rank = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(k)) for k, n in enumerate(names)])
    return out.select(*gt.columns, F.coalesce(*names).alias("match"), rank.alias("rule"))


def complete(listing: DataFrame, key: str, kind: str, needed: list[str]) -> DataFrame:
    """Keys that have all needed kinds in a file listing."""
    return listing.where(F.col(kind).isin(needed)).groupBy(key).agg(F.count_distinct(kind).alias("kinds")).where(F.col("kinds") == len(needed)).select(key)


def outstanding(scenes: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return scenes.join(done.select(key).distinct(), key, "left_anti")


def status(scenes: DataFrame, started: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """done, incomplete (started only) or missing for each scene."""
    s, d = (t.select(key).distinct().withColumn(n, F.lit(True)) for t, n in ((started, "s"), (done, "d")))
    return scenes.join(s, key, "left").join(d, key, "left").select(key, F.when(F.col("d"), "done").when(F.col("s"), "incomplete").otherwise("missing").alias("status"))


def same_lists(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """Whether two tables list the same keys, each as often, for each group; from counts by key instead of gathered lists."""
    both = a.select(group, key, F.lit(1).alias("_n")).union(b.select(group, key, F.lit(-1)))
    return both.groupBy(group, key).agg(F.sum("_n").alias("_n")).groupBy(group).agg(F.bool_and(F.col("_n") == 0).alias("same"))


def shard_range(rows: DataFrame, scenes: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows of the scenes whose position in sorted order is in [start, stop)."""
    at = position(scenes.select(key).distinct(), [key])
    return rows.join(at.where((F.col("pos") >= start) & (F.col("pos") < stop)).select(key), key, "left_semi")


def with_default(rows: DataFrame, table: DataFrame, key: str, value: str, default: str) -> DataFrame:
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def overlap_match(px: DataFrame, a: str, b: str, least: int, keys: list[str]) -> DataFrame:
    """Each segment of one view with the segment of the other that covers most of it (ties to the smaller id)."""
    pairs = px.where((F.col(a) > 0) & (F.col(b) > 0)).groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    best = pairs.groupBy(*keys, a).agg(F.max_by(b, F.struct("n", -F.col(b))).alias("match"), F.max("n").alias("pixels"))
    return best.where(F.col("pixels") >= least)


def splat(points: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Values of points on a pixel: the last in ``order`` wins."""
    return points.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def z_buffer(points: DataFrame, keys: list[str], value: str, depth: str, radius: int = 0) -> DataFrame:
    """Nearest point of each pixel within a square of ``radius``; ties go to the smaller value."""
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)])
    # the nearest of a square is the nearest of its pixels' nearest, so points are thinned out before they are spread
    own = points.groupBy(*keys, "v", "u").agg(F.min(F.struct(depth, value)).alias("_near"), F.min(depth).alias("_depth"))
    wide = own.withColumn("o", F.explode(cells)).withColumns({"u": F.col("u") + F.col("o.a"), "v": F.col("v") + F.col("o.b")})
    return wide.groupBy(*keys, "v", "u").agg(F.min("_near").getField(value).alias(value), F.min("_depth").alias(depth))


def near_pairs(px: DataFrame, label: str, radius: int, keys: list[str]) -> DataFrame:
    """Pairs of labels with pixels within ``radius`` (Euclidean) of each other.

    A group of ``keys`` is one raster; it is laid over itself at each offset, so no pixel is copied to the places around it.
    """
    ship(px.sparkSession)
    own = px.where(F.col(label) > 0).select(*keys, "v", "u", F.col(label).alias("_l"))
    kinds = dict(own.dtypes)

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        met = touching(*(rows.column(c).to_numpy() for c in ("v", "u", "_l")), radius)
        head = [pa.array([k.as_py()] * len(met), rows.schema.field(c).type) for c, k in zip(keys, key, strict=True)]
        return pa.table([*head, *[pa.array(met[:, k], rows.schema.field("_l").type) for k in (0, 1)]], names=[*keys, "a", "b"])

    return own.groupBy(*keys).applyInArrow(one, ", ".join(f"{c} {kinds[c]}" for c in keys) + f", a {kinds['_l']}, b {kinds['_l']}")


def bridged_pairs(px: DataFrame, label: str, gap: int, keys: list[str]) -> DataFrame:
    """Pairs of labels that touch once background pixels within ``gap`` of a label have taken up the nearest one.

    Of labels equally far the one first in row order is taken. The nearest one of a background pixel always lies on an edge, so
    only pixels without a label at one of their four sides look around.
    """
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-gap, gap + 1) for b in range(-gap, gap + 1) if a * a + b * b <= gap * gap])
    own = px.where(F.col(label) > 0).select(*keys, "v", "u", F.col(label).alias("_l"))
    row, column = Window.partitionBy(*keys, "v").orderBy("u"), Window.partitionBy(*keys, "u").orderBy("v")
    held = [F.lag("u").over(row) == F.col("u") - 1, F.lead("u").over(row) == F.col("u") + 1, F.lag("v").over(column) == F.col("v") - 1, F.lead("v").over(column) == F.col("v") + 1]
    edge = own.withColumn("_in", F.coalesce(held[0] & held[1] & held[2] & held[3], F.lit(False))).where(~F.col("_in"))
    reach = edge.select(*keys, F.col("v").alias("_v"), F.col("u").alias("_u"), "_l", F.explode(offsets).alias("o")).select(*keys, (F.col("_v") - F.col("o.a")).alias("v"), (F.col("_u") - F.col("o.b")).alias("u"), "_l", F.struct((F.col("o.a") * F.col("o.a") + F.col("o.b") * F.col("o.b")).alias("d"), "_v", "_u").alias("_far"))
    free = px.where(F.col(label) <= 0).select(*keys, "v", "u")
    wide = own.union(free.join(reach, [*keys, "v", "u"]).groupBy(*keys, "v", "u").agg(F.min_by("_l", "_far").alias("_l")))
    steps = F.array(F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")), F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")))
    moved = wide.select(*keys, F.col("_l").alias("_m"), F.explode(steps).alias("o"), "v", "u").select(*keys, (F.col("v") + F.col("o.a")).alias("v"), (F.col("u") + F.col("o.b")).alias("u"), "_m")
    met = wide.join(moved, [*keys, "v", "u"]).where("_l <> _m")
    return met.select(*keys, F.least("_l", "_m").alias("a"), F.greatest("_l", "_m").alias("b")).distinct()
