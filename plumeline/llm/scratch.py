"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Where neither is set, a session of one machine gets a temporary folder; a cluster gets an error,
    as its executors would not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ref = spark.sparkContext._jsc.sc().getCheckpointDir()
        if ref.isDefined():
            base = ref.get()
        elif spark.sparkContext.master.startswith("local["):
            base = tempfile.mkdtemp(prefix="plumeline-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


class Scratch:
    """Named Parquet tables under a folder of their own, removed when the driver's process ends.

    Writing a table cuts lineage: a lost executor costs a re-read, never a recomputation of what
    came before. Tables that are no longer needed are dropped early with :meth:`drop`.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/plumeline/{what}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write df and read it back."""
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._remove(self.path(name))

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have gone before the process ends
            return
