"""Session set-up: a local builder for tests and the package for executors that do not have it."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Bytes of an Arrow batch on its way to a Python worker, where the session has Spark's own default of 64 MB.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")


def local_session(cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("facetframe")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Gives this package to the executors' Python workers, once for each application, and bounds their batches."""
    context = spark.sparkContext
    key, usual, bound = _BATCH
    if spark.conf.get(key) == usual:
        spark.conf.set(key, bound)
    if context.applicationId not in _shipped:
        folder = Path(tempfile.mkdtemp(prefix="facetframe-"))
        staged = folder / "staged"
        shutil.copytree(_PACKAGE, staged / _PACKAGE.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(folder / "facetframe_package"), "zip", staged))
        shutil.rmtree(staged)
        _shipped.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of ``spark.checkpoint.dir``. Without the setting, a local session gets one of its own.

    A cluster's executors share no local folder, so there the setting must be given.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the application ends."""
    context = spark.sparkContext
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at
