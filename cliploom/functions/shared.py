"""The folder that driver and executors share, and work tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The setting by which Spark drops an execution's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which goes when the application ends.

    A temporary folder serves only where that setting is missing and the master is local (tests).
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cliploom-")
        spark.sparkContext.setCheckpointDir(found)
    path = f"{found}/cliploom-{spark.sparkContext.applicationId}"
    if path not in _announced:
        _announced.add(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


_announced: set[str] = set()
_scope: ContextVar[list[DataFrame] | None] = ContextVar("work tables", default=None)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    Shuffle files behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _scope.get() is not None:
        _scope.get().append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def work_tables() -> Iterator[list[DataFrame]]:
    """Tables that stored() makes inside, in this thread; those still in the list at the end are deleted."""
    made: list[DataFrame] = []
    token = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)
        discard(*made)
