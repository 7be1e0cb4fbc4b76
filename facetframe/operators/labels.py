"""Label algebra: conventions, relabelling, votes, lookups and set operations on label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["scene_id", "frame_id"]


def shift(label: str) -> Column:
    """Mesh labels (-1 none, 0 the largest plane) to raster labels (0 none)."""
    return F.when(F.col(label) < 0, 0).otherwise(F.col(label) + 1)


def legacy_shift(label: str) -> Column:
    """The older rule that merges plane 0 with the background."""
    return F.greatest(F.col(label), F.lit(0))


def nonplanar_to_zero(label: str, nonplanar: int, shifted: bool, offset: int = 0) -> Column:
    """A method's non-planar label to 0; the others move up by one first only if ``shifted``."""
    return F.when(F.col(label) == nonplanar, 0).otherwise(F.col(label) + (1 if shifted else 0) + offset)


def dense(px: DataFrame, label: str = "pred", start: int = 1) -> DataFrame:
    """Positive labels of a frame to ``start``.. in their order; the rest to 0.

    The labels of a frame are few: they are ranked once each and joined back, so pixels are not sorted.
    """
    found = px.where(F.col(label) > 0).groupBy(*FRAME, label).agg(F.count("*").alias("_n"))
    ranks = found.select(*FRAME, label, (F.row_number().over(Window.partitionBy(*FRAME).orderBy(label)) + (start - 1)).alias("dense"))
    return px.join(ranks, [*FRAME, label], "left").withColumn("dense", F.coalesce("dense", F.lit(0)))


def _sized(px: DataFrame, label: str) -> DataFrame:
    return px.where(F.col(label) > 0).groupBy(*FRAME, label).agg(F.count("*").alias("size"))


def drop_small(px: DataFrame, least: int, label: str = "pred") -> DataFrame:
    """Segments of fewer than ``least`` pixels to 0, the others to 1.. in their order."""
    kept = _sized(px, label).where(F.col("size") >= least)
    ranks = kept.select(*FRAME, label, F.row_number().over(Window.partitionBy(*FRAME).orderBy(label)).alias("kept_label"))
    return px.join(ranks, [*FRAME, label], "left").withColumn("kept_label", F.coalesce("kept_label", F.lit(0)))


def top_segments(px: DataFrame, k: int, label: str = "pred") -> DataFrame:
    """The ``k`` largest segments of a frame with their rank; ties go to the smaller label."""
    w = Window.partitionBy(*FRAME).orderBy(F.desc("size"), label)
    return _sized(px, label).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep_top(px: DataFrame, k: int, ignore: int = 0, label: str = "pred") -> DataFrame:
    kept = top_segments(px, k, label).select(*FRAME, label, F.col(label).alias("top_label"))
    return px.join(kept, [*FRAME, label], "left").withColumn("top_label", F.coalesce("top_label", F.lit(ignore)))


def mapped(rows: DataFrame, column: str, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """``column`` through a lookup table, ``default`` where it has no entry; the table joins at its size (AQE broadcasts a small one)."""
    looked = table.select(F.col(key).alias(column), F.col(value).alias("mapped"))
    return rows.join(looked, column, "left").withColumn("mapped", F.coalesce("mapped", F.lit(default)))


def two_stage(rows: DataFrame, column: str, names: DataFrame, targets: DataFrame) -> DataFrame:
    """id to name to target; what either table lacks is 0."""
    named = rows.join(names.select(F.col("id").alias(column), "name"), column, "left")
    return named.join(targets.select("name", "target"), "name", "left").withColumn("target", F.coalesce("target", F.lit(0)))


def can_merge(a: str, b: str, groups: list[list[int]]) -> Column:
    """Equal classes or two of one group."""
    same = F.col(a) == F.col(b)
    for g in groups:
        same = same | (F.col(a).isin(g) & F.col(b).isin(g))
    return same


def vote(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label of each key; ties go to the smallest."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("votes"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("votes", -F.col(label))).alias("label"), F.max("votes").alias("votes"))


def last_channel(rows: DataFrame, keys: list[str], channel: str, mask: str) -> DataFrame:
    """Stacked instance masks to one map: the last channel that covers a pixel wins, numbered from 1."""
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(mask) > 0, F.col(channel) + 1)), F.lit(0)).alias("instance"))


#: Tokens of a policy, at most.
MOST_TOKENS = 10_000


def resolve_names(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Policy tokens to label ids: a number is the id, else an exact name, else every name that contains the token.

    Each token takes the best kind that matches at all; one without a match is kept with a null id. Ids and names meet in
    equi-joins. A policy is a short list, so for the third kind its tokens go to the names, of which there may be any number.
    """
    if (n := tokens.count()) > MOST_TOKENS:
        raise ValueError(f"{n} tokens in a policy")
    asked = tokens.distinct()
    number = F.when(F.col("token").rlike("^[0-9]+$"), F.col("token").try_cast("long"))
    by_id = asked.withColumn("_n", number).join(labels.select("id"), F.col("_n") == F.col("id")).select("token", "id", F.lit(1).alias("kind"))
    by_name = asked.withColumn("_n", F.lower("token")).join(labels.select("id", F.lower("name").alias("_m")), F.col("_n") == F.col("_m")).select("token", "id", F.lit(2).alias("kind"))
    inside = labels.join(F.broadcast(asked), F.contains(F.lower("name"), F.lower("token"))).select("token", "id", F.lit(3).alias("kind"))
    pairs = by_id.union(by_name).union(inside)
    best = pairs.groupBy("token").agg(F.min("kind").alias("best")).withColumnRenamed("token", "_t")
    best = pairs.join(F.broadcast(best), (F.col("token") == F.col("_t")) & (F.col("kind") == F.col("best"))).select("token", "id", "kind")
    return tokens.join(best, "token", "left")


def rgb_key(r: str, g: str, b: str) -> Column:
    return F.shiftleft(F.col(r), 16) + F.shiftleft(F.col(g), 8) + F.col(b)


def packed_legend(rows: DataFrame, legend: DataFrame) -> DataFrame:
    """Colours (r, g, b) to the ids of a legend (r, g, b, id); unknown colours are -1."""
    keyed = legend.select(rgb_key("r", "g", "b").alias("rgb"), "id")
    return rows.withColumn("rgb", rgb_key("r", "g", "b")).join(keyed, "rgb", "left").withColumn("id", F.coalesce("id", F.lit(-1)))
