"""Session helpers: one place for the settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "crashlens") -> SparkSession:
    """Session for tests and local runs (AQE on, UI off, UTC clock)."""
    spark = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


# Settings for a large cluster (about 1000 executors, 100 TB of reports).
# Shuffle partitions start high and AQE coalesces them to the advisory size;
# skewed join partitions are split; scans read 256 MB splits; the streaming
# state (hourly rollup windows, the Python limiter) lives in RocksDB so it is
# not bounded by executor heap.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.session.timeZone": "UTC",
}


def apply_cluster_conf(spark: SparkSession, overrides: dict | None = None) -> SparkSession:
    """Apply ``CLUSTER_CONF`` (plus ``overrides``) to a running session."""
    for key, value in {**CLUSTER_CONF, **(overrides or {})}.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001 - static confs must be set at launch instead
            pass
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every crashlens plan assumes, applied to any session.

    Timestamps are stored and compared in UTC; the reference service keeps
    ISO-8601 ``Z`` times.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; only when that is unset
    (tests, local runs) a scratch folder is created and registered.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="crashlens-ckpt-",
                                dir=os.environ.get("CRASHLENS_SCRATCH", "/tmp"))
        spark.sparkContext.setCheckpointDir(path)
    return path


def overwrite_partitions(df, *columns):
    """Writer that replaces only the partitions present in ``df`` (dynamic
    partition overwrite as a write option, not a session setting): writing
    the same batch twice leaves one copy."""
    return (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy(*columns))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of ``path`` (any scheme)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def by_partition(df, column: str, files_per_value: int | None = None):
    """Lay rows out for a write partitioned by ``column``.

    ``files_per_value=None`` adds no shuffle: each task sorts its rows by the
    partition value and writes at most one file per value it holds.  With a
    number, rows are hash-spread over ``column`` and a salt from every
    column's hash, so one value (one busy day) is written by that many tasks
    instead of one; choose it near the value's bytes / 512 MB.
    """
    from pyspark.sql import functions as F

    if files_per_value is None:
        return df.sortWithinPartitions(column)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_value))
    return df.repartition(F.col(column), salt).sortWithinPartitions(column)
