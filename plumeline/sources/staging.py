"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or else the context's checkpoint folder. Where both are unset, one machine gets a temporary folder and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base and spark.sparkContext.master.startswith("local["):
        base = tempfile.mkdtemp(prefix="plumeline-")
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have gone before the process ends
        return


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: what several parts of a plan use is made once, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumeline-staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
