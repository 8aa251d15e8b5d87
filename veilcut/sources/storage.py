"""Shared storage: lineage is cut with tables in the folder that the whole cluster sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and the master is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="veilcut-")
        base = _own[app]
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table of this application in the shared folder."""
    return f"{shared_dir(spark)}/veilcut/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has written on the way.  Results that still read them can't be used any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/veilcut/{spark.sparkContext.applicationId}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
