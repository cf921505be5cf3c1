"""Hourly rollup ``crash_analytics`` (S3): one row per app, version,
platform and arrival hour."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.functions.time import as_timestamp, lookback, trunc_like, ts_literal
from crashlens.session import by_partition, overwrite_partitions


def hourly_rollup(reports: DataFrame, *, as_of=None, hours: float = 0,
                  days: float = 0, distinct_users: bool = False) -> DataFrame:
    """``app_name, app_version, platform, hour, crash_count, unique_users``.

    ``unique_users`` is ``count(*)`` like the original view; pass
    ``distinct_users=True`` for an extra exact ``distinct_users`` column.

    With ``as_of`` and a window the rollup keeps hours ``> as_of - window``.
    Because ``date_trunc(hour, t) > x`` implies ``t > x`` the same bound is
    first applied to the raw ``created_at`` column, where it reaches the scan
    (pushdown and partition pruning); the exact test on ``hour`` follows.
    """
    src = reports
    if as_of is not None and (hours or days):
        src = lookback(src, as_of, hours=hours, days=days)
    aggs = [F.count(F.lit(1)).alias("crash_count"),
            F.count(F.lit(1)).alias("unique_users")]
    if distinct_users:
        aggs.append(F.count_distinct("ip_hash").alias("distinct_users"))
    out = (src.groupBy("app_name", "app_version", "platform",
                       trunc_like("hour", src, "created_at").alias("hour"))
              .agg(*aggs))
    if as_of is not None and (hours or days):
        since = as_timestamp(as_of) - dt.timedelta(days=days, hours=hours)
        out = out.where(F.col("hour") > ts_literal(since, out.schema["hour"].dataType))
    return out


def crash_analytics(reports: DataFrame) -> DataFrame:
    """S3: the hourly view over the whole fact table (``hourly_rollup``)."""
    return hourly_rollup(reports)


def hour_window(rollup: DataFrame, as_of, *, hours: float = 0,
                days: float = 0) -> DataFrame:
    """Rows of an existing rollup with ``hour > as_of - window``."""
    since = as_timestamp(as_of) - dt.timedelta(days=days, hours=hours)
    if "hour_date" in rollup.columns:  # implied by the bound on ``hour``; prunes partitions
        rollup = rollup.where(F.col("hour_date") >= F.lit(since.date()))
    return rollup.where(F.col("hour") > ts_literal(since, rollup.schema["hour"].dataType))


def refresh_rollup(reports: DataFrame, path: str, dates=None,
                   files_per_date: int | None = None) -> None:
    """Materialise the rollup, partitioned by ``hour_date``.

    With ``dates`` (arrival dates that received new reports) only those
    partitions are recomputed from the fact table (partition-pruned scan)
    and overwritten (dynamic partition overwrite); without, everything is.
    An hour never spans two dates, so a date's cells depend only on that
    date's reports.
    """
    src = reports
    if dates is not None:
        dates = sorted({d if hasattr(d, "isoformat") else dt.date.fromisoformat(str(d))
                        for d in dates})
        day = (F.col("created_date") if "created_date" in reports.columns
               else F.to_date("created_at"))
        src = src.where(day.isin(*[F.lit(d) for d in dates]))
    out = hourly_rollup(src).withColumn("hour_date", F.to_date("hour"))
    overwrite_partitions(by_partition(out, "hour_date", files_per_date), "hour_date").parquet(path)


def read_rollup_table(spark, path: str) -> DataFrame:
    """The materialised rollup (``hour_date`` prunes look-backs on ``hour``)."""
    return spark.read.parquet(path)
