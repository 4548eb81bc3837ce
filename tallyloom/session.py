"""Session helpers: the shared folder and tables written to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows that go to a Python worker at once.
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) is a local folder chosen.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + os.path.join(tempfile.gettempdir(), "tallyloom-shared")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/tallyloom/{label}-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.unregister(_remove)
        atexit.register(_remove)
    _FOLDERS.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _FOLDERS:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may have gone already
            return


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the stored table.

    The table survives lost executors, cuts the lineage, and gives the optimizer true sizes. The
    shuffle files behind it are no longer needed and go with the end of the write.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP_SETTING, None)
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP_SETTING, before) if before is not None else spark.conf.unset(_CLEANUP_SETTING)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch = path
    return stored


def release(*tables: DataFrame) -> None:
    """Deletes stored tables of :func:`materialize` that nothing reads any more: all that came from them is written."""
    for table in tables:
        if path := getattr(table, "_scratch", None):
            drop_path(table.sparkSession, path)
            _FOLDERS[:] = [(spark, other) for spark, other in _FOLDERS if other != path]


def fresh(columns: list[str], *stems: str) -> list[str]:
    """Names for temporary columns that clash with none of ``columns``: longer than all of them."""
    longest = max(map(len, columns), default=0)
    return [stem + "_" * max(1, longest + 1 - len(stem)) for stem in stems]


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for a broadcast where a count finds at most ``rows`` rows; any other is joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_tallyloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tallyloom-"), "tallyloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, os.path.join(root.name, path.relative_to(root)))
    context.addPyFile(target)
    context._tallyloom_shipped = True


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers.

    Rows may hold whole documents, so a batch has ``BATCH_ROWS`` rows, unless the session names another number.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH_SETTING) == "10000":  # Spark's own default
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    return df.mapInArrow(function, schema)
