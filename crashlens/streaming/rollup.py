"""Streaming hourly rollup, distinct users, spike alerts.

The rollup is a tumbling one-hour window on the arrival clock
(``created_at``) with a short watermark.  It runs in update mode and each
micro-batch's changed cells are written with their batch id (idempotent
dynamic overwrite); readers take the newest value per cell.  Append mode
would only emit a window after the watermark passes its end, so the last
hours of a finite run would never appear.  Cells older than the watermark
are final and leave the state store.

Distinct users per hour are not exact on a stream (distinct aggregation is
refused); the rollup carries a mergeable HLL sketch instead, which later
unions across cells and estimates with ``hll_sketch_estimate``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.functions.time import as_timestamp
from crashlens.session import overwrite_partitions


def hourly_rollup_stream(accepted: DataFrame, watermark: str | None = None,
                         sketch: bool = True) -> DataFrame:
    """X4 (+X5): ``app_name, app_version, platform, hour, crash_count,
    unique_users[, users_sketch]`` from a stream of accepted reports.

    By default every late row is counted and cells stay in the state store.  With a ``watermark`` rows later than it
    are left out and old cells leave the state (append mode needs one).  ``late.start_exact_rollup`` bounds the state
    and loses no row; ``write_rollup_partial`` counts late rows with no state."""
    aggs = [F.count(F.lit(1)).alias("crash_count"),
            F.count(F.lit(1)).alias("unique_users")]
    if sketch:
        aggs.append(F.hll_sketch_agg("ip_hash").alias("users_sketch"))
    if watermark is not None:
        accepted = accepted.withWatermark("created_at", watermark)
    return (accepted.groupBy("app_name", "app_version", "platform",
                             F.window("created_at", "1 hour").alias("w"))
                    .agg(*aggs)
                    .withColumn("hour", F.col("w.start"))
                    .drop("w"))


def start_rollup(rollup: DataFrame, path: str, checkpoint: str,
                 available_now: bool = True, on_batch=None, output_mode: str = "update"):
    """Write rollup cells per micro-batch (``batch_id`` partitions).

    ``output_mode="update"`` writes every changed cell each batch (readers
    take the newest, ``read_rollup``); ``"append"`` writes each cell once,
    when the watermark has closed its hour, so the newest hours appear only
    after later data moves the watermark past them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        overwrite_partitions(batch.withColumn("batch_id", F.lit(batch_id)),
                             "batch_id").parquet(path)
        if on_batch is not None:
            on_batch(batch, batch_id)

    writer = (rollup.writeStream.outputMode(output_mode).foreachBatch(write)
                    .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Current rollup: the newest version of each (app, version, platform,
    hour) cell.  One shuffle on the cell key."""
    cells = spark.read.parquet(path)
    key = ["app_name", "app_version", "platform", "hour"]
    newest = Window.partitionBy(*key).orderBy(F.desc("batch_id"))
    return (cells.withColumn("_r", F.row_number().over(newest))
                 .where(F.col("_r") == 1).drop("_r", "batch_id"))


def spike_alerts(baseline: DataFrame, path: str, *, as_of, k: float = 2.0,
                 baseline_days: float = 7):
    """A ``foreachBatch`` callback flagging new rollup cells above
    ``mean + k * sd`` of a static per-app baseline, written to ``path``.

    ``baseline`` is a batch rollup; its per-app mean and deviation are one
    row per app, joined to each micro-batch's changed cells (AQE broadcasts
    the small side).  Alerts are partitioned by batch id with dynamic
    overwrite, so a replayed batch rewrites its own alerts only.
    """
    now = as_timestamp(as_of)
    since = now - dt.timedelta(days=baseline_days)
    htype = baseline.schema["hour"].dataType
    from crashlens.functions.time import ts_literal
    stats = (baseline.where(F.col("hour") > ts_literal(since, htype))
                     .groupBy("app_name")
                     .agg(F.avg("crash_count").alias("avg_crashes"),
                          F.stddev_samp("crash_count").alias("stddev_crashes")))

    def callback(batch: DataFrame, batch_id: int) -> None:
        flagged = (batch.join(stats, "app_name")
                        .where(F.col("crash_count") > F.col("avg_crashes")
                               + F.lit(k) * F.col("stddev_crashes"))
                        .select("app_name", "app_version", "platform", "hour",
                                F.col("crash_count").alias("recent_crashes"),
                                "avg_crashes",
                                F.round((F.col("crash_count") - F.col("avg_crashes"))
                                        / F.nullif(F.col("stddev_crashes"), F.lit(0.0)),
                                        2).alias("z_score"),
                                F.lit(batch_id).alias("batch_id")))
        overwrite_partitions(flagged, "batch_id").parquet(path)

    return callback


def write_rollup_partial(accepted: DataFrame, path: str, batch_id: int) -> None:
    """Per-batch partial rollup cells of accepted rows (``batch_id``
    partition, dynamic overwrite).  Counts are additive, so the rollup of
    all batches is the per-cell sum of these partials (``read_rollup_sums``):
    an exact hourly rollup from the ingest stream itself, with no state
    store and nothing held back by a watermark."""
    from crashlens.operators.rollup import hourly_rollup

    overwrite_partitions(hourly_rollup(accepted).withColumn("batch_id", F.lit(batch_id)),
                         "batch_id").parquet(path)


def read_rollup_sums(spark: SparkSession, path: str) -> DataFrame:
    """Rollup from per-batch partials: one grouped sum per cell."""
    key = ["app_name", "app_version", "platform", "hour"]
    return (spark.read.parquet(path).groupBy(*key)
                 .agg(F.sum("crash_count").cast("bigint").alias("crash_count"),
                      F.sum("unique_users").cast("bigint").alias("unique_users")))
