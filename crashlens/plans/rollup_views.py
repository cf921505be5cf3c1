"""Queries over the hourly rollup ``crash_analytics``.

Each accepts either a rollup DataFrame (has ``crash_count``) or the fact
table; from the fact table the rollup is built for the look-back window
only, with the bound pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.operators.rollup import hour_window, hourly_rollup


def rollup_window(source: DataFrame, *, as_of, hours: float = 0,
                  days: float = 0) -> DataFrame:
    """Rollup rows with ``hour > as_of - window``."""
    if "crash_count" in source.columns:
        return hour_window(source, as_of, hours=hours, days=days)
    return hourly_rollup(source, as_of=as_of, hours=hours, days=days)


def dashboard(source: DataFrame, *, as_of, hours: float = 24) -> DataFrame:
    """Rollup rows of the last ``hours``, newest first."""
    return (rollup_window(source, as_of=as_of, hours=hours)
            .orderBy(F.desc("hour"), "app_name", "app_version", "platform"))


def top_apps(source: DataFrame, *, as_of, days: float = 7,
             with_users: bool = True) -> DataFrame:
    """Q26 (``with_users``) / R03: crashes summed per app over the window."""
    aggs = [F.sum("crash_count").cast("bigint").alias("total_crashes")]
    if with_users:
        aggs.append(F.sum("unique_users").cast("bigint").alias("total_users"))
    return (rollup_window(source, as_of=as_of, days=days)
            .groupBy("app_name").agg(*aggs)
            .orderBy(F.desc("total_crashes"), "app_name"))


def platform_rates(source: DataFrame, *, as_of, days: float = 30) -> DataFrame:
    """Q27: mean and peak rollup cell per platform."""
    return (rollup_window(source, as_of=as_of, days=days)
            .groupBy("platform")
            .agg(F.avg("crash_count").alias("avg_crashes_per_hour"),
                 F.max("crash_count").alias("peak_crashes_per_hour"))
            .orderBy(F.desc("avg_crashes_per_hour"), "platform"))
