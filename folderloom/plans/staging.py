"""Intermediate results as Parquet in the shared folder the cluster names in ``spark.checkpoint.dir``.

A written table cuts the lineage, survives lost executors, and has a known size for join planning.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names, else its warehouse: both are shared between driver and executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


class Stage:
    """One run's intermediate tables. What is not discarded before goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, f"{(root or shared_folder(spark)).rstrip('/')}/folderloom/{uuid.uuid4().hex}"
        self._path().getFileSystem(self._conf()).deleteOnExit(self._path())

    def keep(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        """Write and read back; ``by`` are columns that get a folder per value, so that a filter on them reads that folder only.

        For those, rows are dealt out by value, and adaptive execution splits large values and joins small ones.
        """
        path = f"{self.root}/{name}"
        if by:
            df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        self._path().getFileSystem(self._conf()).delete(self._path(), True)

    def _path(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.root)

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()
