"""Intermediate tables in the folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.named_files import qualified, remove

_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local master may go without: then a local folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new place for a table; it goes when the driver ends, or with :func:`clear`."""
    made = f"{shared_dir(spark)}/tessera-scratch/{uuid.uuid4().hex}-{name}"
    _MADE.add(made)
    return made


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back; outlives lost executors. With ``by``, a folder a value of that column."""
    at = path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def clear(spark: SparkSession) -> None:
    """Delete all places given out; tables read from them become unreadable."""
    for made in list(_MADE):
        local = qualified(spark, made).removeprefix("file://")
        if local.startswith("/"):  # Hadoop would list a folder's files in the driver
            if os.path.isdir(local):
                remove(local)
            _MADE.discard(made)
            continue
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _MADE.discard(made)


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _MADE else None
    if spark is not None:
        try:
            clear(spark)
        except Exception:  # the JVM may be gone already
            _MADE.clear()
