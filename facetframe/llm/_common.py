"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: Rows up to which a table of ids or hashes may be broadcast (a few MB, which the driver holds twice).
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder of ``spark.checkpoint.dir`` and reads it again.

    Unlike a checkpoint, the table carries none of the optimiser's size estimates and constraints over, which multiply
    from round to round of a loop. It goes when the application ends, or earlier by ``forget``.
    """
    at = shared_path(df.sparkSession, "table")
    df.write.parquet(at)
    table = df.sparkSession.read.schema(df.schema).parquet(at)
    table._cut_at = at
    return table


def counted(df: DataFrame) -> DataFrame:
    """As ``cut``; the rows are counted as they are written, so that ``rows_of`` takes no job of its own."""
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    table._rows = seen.get["rows"]
    return table


def rows_of(table: DataFrame) -> int:
    """Rows of a table made by ``counted``; those of any other are counted now."""
    known = getattr(table, "_rows", None)
    return table.count() if known is None else known


def place_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared file or folder, for tasks."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables made by ``cut`` that nothing will read again."""
    for table in tables:
        if at := getattr(table, "_cut_at", None):
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its ``rows``, counted if not given, stay within ``most``; else the join shuffles."""
    return F.broadcast(df) if (rows_of(df) if rows is None else rows) <= most else df


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of a column's text form modulo ``n``: the split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings (``__`` for a dot) that hold for the eager jobs inside, as for a checkpoint."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    usual = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those whose doc_id and text ``gone`` (doc_id, text_hash) has; all columns as they are.

    Only keys of the rows to drop are moved: broadcast while few, else both sides shuffle.
    """
    keys = small(counted(gone.selectExpr("doc_id as gone_id", "text_hash as gone_hash").distinct()))
    same = docs["doc_id"].eqNullSafe(keys["gone_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["gone_hash"])
    return docs.join(keys, same, "left_anti")


def folded(docs: DataFrame, *used: str) -> DataFrame:
    """Columns ``used`` of ``docs`` and all others in one column ``rest``, so that names of other columns clash with nothing."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(F.lit(0).alias("_"), *others).alias("rest"))


def unfolded(rows: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` from rows made by ``folded``."""
    return rows.select(*[F.col(c) if c in used else F.col("rest").getField(c).alias(c) for c in docs.columns])
