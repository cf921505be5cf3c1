"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from crashlens.session import checkpoint_dir


class Scratch:
    """Parquet tables of one operator call, below ``spark.checkpoint.dir``.

    A saved table cuts lineage and outlives any executor.  ``drop()`` removes
    a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and return the stored table."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        schema = df.schema
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that are no longer referenced:
        it does so when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
