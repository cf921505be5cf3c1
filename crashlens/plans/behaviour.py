"""Time-of-week, hour-of-day, repeat users and sessions (Q21–Q24)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.functions.time import day_name, dow_sunday0

def _n():
    return F.count(F.lit(1))


def by_day_of_week(df: DataFrame) -> DataFrame:
    """Q21: crashes per weekday, Sunday first (sorted by a hidden key)."""
    return (df.groupBy(day_name(F.col("created_at")).alias("day_of_week"),
                       dow_sunday0(F.col("created_at")).alias("_dow"))
              .agg(_n().alias("crashes"))
              .orderBy("_dow")
              .drop("_dow"))


def by_hour_of_day(df: DataFrame) -> DataFrame:
    """Q22: crashes and users per hour of day."""
    return (df.groupBy(F.hour("created_at").cast("int").alias("hour"))
              .agg(_n().alias("crashes"), F.count_distinct("ip_hash").alias("unique_users"))
              .orderBy("hour"))


def repeat_users(df: DataFrame, more_than: int = 5) -> DataFrame:
    """Q23: users (IP hashes) with more than ``more_than`` crashes.

    The app list per user is bounded by the number of apps; a hot user key
    is pre-aggregated map-side like every count here.
    """
    return (df.groupBy("ip_hash")
              .agg(_n().alias("crash_count"),
                   F.count_distinct("app_name").alias("apps_affected"),
                   F.array_sort(F.collect_set("app_name")).alias("app_list"),
                   F.min("created_at").alias("first_crash"),
                   F.max("created_at").alias("latest_crash"))
              .where(F.col("crash_count") > more_than)
              .orderBy(F.desc("crash_count"), F.asc_nulls_last("ip_hash")))


def session_crashes(df: DataFrame, more_than: int = 1) -> DataFrame:
    """Q24: sessions with more than ``more_than`` crashes and their span.

    ``session_duration`` is the interval ``max - min`` of arrival times;
    ``session_seconds`` gives the same span as seconds (double).
    """
    out = (df.where(F.col("session_id").isNotNull())
             .groupBy("session_id", "app_name", "user_id")
             .agg(_n().alias("crashes_in_session"),
                  F.min("created_at").alias("_first"),
                  F.max("created_at").alias("_last"))
             .where(F.col("crashes_in_session") > more_than))
    first = F.col("_first").cast("timestamp")
    last = F.col("_last").cast("timestamp")
    return (out.select(
                "session_id", "crashes_in_session",
                (F.col("_last") - F.col("_first")).alias("session_duration"),
                "app_name", "user_id",
                ((F.unix_micros(last) - F.unix_micros(first)) / F.lit(1e6))
                .alias("session_seconds"))
              .orderBy(F.desc("crashes_in_session"), "session_id", "app_name",
                       F.asc_nulls_last("user_id")))
