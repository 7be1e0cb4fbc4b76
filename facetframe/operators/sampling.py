"""Shards, splits, strides and samples with a total order, so that they repeat on any partitioning."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def position(rows: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """Position from 0 in order, in each group of ``by``.

    Without ``by`` all rows are numbered: they are dealt to ranges of the order, which are counted and numbered each, so no task
    has them all.
    """
    if by:
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("pos", (F.col("_before") + F.col("_own") - 1).cast("int")).drop("_range", "_own", "_before")


def stride(frames: DataFrame, by: list[str], order: str, step: int) -> DataFrame:
    return position(frames, [order], by).where(F.col("pos") % step == 0)


def shards(scenes: DataFrame, order: str, parts: int) -> DataFrame:
    """Contiguous shards whose sizes differ by one at most, larger ones first."""
    return scenes.withColumn("shard", F.ntile(parts).over(Window.orderBy(order)) - 1)


def batches(scenes: DataFrame, order: str, count: int, total: int) -> DataFrame:
    """Batches of ceil(total / count) scenes; the last ones may be short or empty."""
    return position(scenes, [order]).withColumn("batch", F.floor(F.col("pos") / ceil(total / count)))


def linspace(rows: DataFrame, order: str, wanted: int, by: list[str] | None = None) -> DataFrame:
    """About ``wanted`` rows at even distances, first and last among them."""
    numbered = position(rows, [order], by).withColumn("_n", F.count("*").over(Window.partitionBy(*(by or []))))
    steps = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(1, wanted - 1)))
    return numbered.where((F.col("_n") <= wanted) | F.array_contains(steps, F.col("pos").cast("bigint"))).drop("_n")


def hash_order(key: str, seed: int):
    """Order of a seeded shuffle that both engines can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def split(scenes: DataFrame, key: str, total: int, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Splits of a seeded shuffle at cut points; the last split takes what rounding leaves."""
    at = position(scenes, [hash_order(key, seed), F.col(key)])
    upto = 0.0
    out, names = None, list(shares)
    for n in names[:-1]:
        upto += shares[n]
        cond = F.col("pos") < int(total * upto + 1e-9)
        out = F.when(cond, n) if out is None else out.when(cond, n)
    return at.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[-1])).drop("pos")


def capped(rows: DataFrame, by: list[str], key: str, most: int, seed: int = 0) -> DataFrame:
    """A seeded sample of ``most`` rows of each group (the operator is a sampler)."""
    w = Window.partitionBy(*by).orderBy(hash_order(key, seed), key)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def every_kth(rows: DataFrame, by: list[str], order: str, wanted: int) -> DataFrame:
    """Every k-th row of a group so that about ``wanted`` remain."""
    numbered = position(rows, [order], by).withColumn("_k", F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(*by)) / wanted)))
    return numbered.where(F.col("pos") % F.col("_k") == 0).drop("_k")


def interleaved(a: DataFrame, b: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Rows of ``a`` with probability ``share`` and of ``b`` otherwise, decided by a hash of the key."""
    coin = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    return a.where(coin < share).withColumn("origin", F.lit(0)).unionByName(b.where(coin >= share).withColumn("origin", F.lit(1)))
