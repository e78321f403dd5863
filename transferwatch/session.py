"""Session settings every job of this library relies on."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone (calendar parts depend on it), make checkpoints possible, ship this package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # What a query shuffled is deleted when it has ended, not when the driver happens to collect its garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    ensure_checkpoint_dir(spark)
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python code imports it."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        _shipped.add(application)
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="transferwatch-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="transferwatch-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def carried_along() -> Iterator[None]:
    """Python code of this package that a plan built inside holds travels with the plan itself.

    Streams run in sessions of their own, which do not see files sent to the executors by :func:`ship`.
    """
    package = sys.modules[__name__.partition(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)


class _Open(threading.local):
    """Folders written since each open ``scratch`` of this thread began, the innermost last."""

    def __init__(self) -> None:
        self.folders: list[list[str]] = []


_open = _Open()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is materialised inside once the block has ended, however it ends.

    Tables materialised outside of any such block stay: their readers may come later.
    """
    _open.folders.append([])
    try:
        yield
    finally:
        for path in _open.folders.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder on whichever file system it names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared checkpoint folder, owned by the innermost ``scratch``."""
    path = f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if _open.folders:
        _open.folders[-1].append(path)
    return path


def forget_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that nothing refers to any more deleted now: Spark does so when the driver collects garbage."""
    spark._jvm.System.gc()


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there afterwards.

    A written table cuts the lineage, survives the loss of executors, is read column by column,
    and its size is known to the planner. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
