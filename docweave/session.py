"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="docweave-")


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme lies in the session's default file system, for every process alike."""
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    if at.toUri().getScheme() is None:
        at = at.makeQualified(fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()), fs.Path("/"))
    return at.toString().rstrip("/")


def stage_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` as the session names it.

    Only a local session without that setting gets a temporary folder; on a cluster a
    machine-local folder would lose data with its machine, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return qualified(spark, configured)
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from that table.

    Cuts lineage like a checkpoint, but later steps read only the columns they need,
    and rows keep any id computed before the write however often tasks are retried.
    """
    path = f"{stage_dir(df.sparkSession)}/docweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders or files of one file system; one that is not there makes no difference."""
    new, conf, fs = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration(), None
    for path in paths:
        at = new(path)
        fs = fs or at.getFileSystem(conf)
        fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, nothing if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
