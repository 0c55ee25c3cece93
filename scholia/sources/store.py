"""Shared storage for frames that are written once and read often: cuts lineage, survives lost executors."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    The cluster names it in ``spark.checkpoint.dir``; a temporary folder is set
    only where that is unset and driver and executors are one process. A cluster
    without it is an error, as a folder of the driver would not be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="scholia-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", f"file://{found}")
        found = f"file://{found}"
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/scholia-{tag}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, also on a remote file system; silent if the session has gone."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    try:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the gateway may be closing
        pass


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished steps, which a garbage collection tells it of."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The frame from Parquet in the shared folder, and the path of that."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path
