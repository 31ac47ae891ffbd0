"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from absorbia.errors import AbsorbiaError

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where none is named, a local session gets one of its own, removed at exit; on a cluster, where
    a folder of one machine would lose data, storage.shared_folder is raised.
    """
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise AbsorbiaError("storage.shared_folder", "no folder for intermediate tables", stage="storage", suggestion="set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        path = tempfile.mkdtemp(prefix="absorbia-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own = "file://" + path
    return _own


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/absorbia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and caches that nothing refers to any more.

    It does so when the driver collects garbage, which a driver with little to do puts off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
