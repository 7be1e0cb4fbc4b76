"""Results of shards, guarded by a manifest: what a run has finished is listed last, and only that is read.

A shard's rows go to a folder of the attempt; an entry of the manifest then names the attempt, its rows and how many shards the run has.
Rows of attempts that were not listed are never read; a shard that is missing, listed twice or left by another run is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup
from .frames import exists

_ENTRY = "run string, shard int, of int, attempt string, n long"


def save_shard(rows: DataFrame, path: str, run: str, shard: int, of: int) -> str:
    """Writes one shard and then its entry; returns the attempt. Until the entry is there the shard does not exist."""
    if not 0 <= shard < of:
        raise ValueError(f"shard {shard} of {of}")
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    at = f"{path}/rows/{attempt}"
    rows.write.parquet(at)
    n = spark.read.parquet(at).count()
    spark.createDataFrame([(run, shard, of, attempt, n)], _ENTRY).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return attempt


def manifest(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).json(f"{path}/manifest")


def read_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """All rows of a run with their ``shard``. Entries are one for each shard, so the list is small.

    Raises ValueError if the run has no entry, lacks a shard, has one twice, disagrees on their number, or if an attempt's rows
    are not as many as its entry says.
    """
    entries = manifest(spark, path).where(F.col("run") == run).collect()
    if not entries:
        raise ValueError(f"no shard of run {run}")
    of = {e["of"] for e in entries}
    have = sorted(e["shard"] for e in entries)
    if len(of) > 1:
        raise ValueError(f"shards of run {run} disagree on their number: {sorted(of)}")
    if twice := sorted({s for s in have if have.count(s) > 1}):
        raise ValueError(f"shards {twice} of run {run} are there twice")
    if missing := sorted(set(range(of.pop())) - set(have)):
        raise ValueError(f"shards {missing} of run {run} are missing")
    attempts = spark.createDataFrame([(e["attempt"], e["shard"], e["n"]) for e in entries], "attempt string, shard int, n long")
    rows = spark.read.parquet(*[f"{path}/rows/{e['attempt']}" for e in entries]).withColumn("attempt", F.element_at(F.split("_metadata.file_path", "/"), -2))
    counts = rows.groupBy("attempt").agg(F.count("*").alias("found"))
    wrong = attempts.join(counts, "attempt", "left").where(F.coalesce("found", F.lit(0)) != F.col("n")).select("shard").collect()
    if wrong:
        raise ValueError(f"shards {sorted(w['shard'] for w in wrong)} of run {run} are not what their entries say")
    return rows.join(attempts.select("attempt", "shard"), "attempt").drop("attempt")


def merged_run(spark: SparkSession, path: str, run: str, keys: list[str]) -> DataFrame:
    """One row for each key of a run; the later shard wins."""
    return rollup.latest(read_run(spark, path, run), keys, "shard")


def stale(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Entries that other runs have left at ``path``."""
    return manifest(spark, path).where(F.col("run") != run)
