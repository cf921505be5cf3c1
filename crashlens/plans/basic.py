"""App, version, platform and error analytics over the fact table.

Every function takes the fact table (``crash_reports`` / ``crash_table``)
and returns a sorted DataFrame; look-backs take an explicit ``as_of``.
Sorts carry a tie-breaker on the group key so limits are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.functions.numeric import round_ratio
from crashlens.functions.text import left
from crashlens.functions.time import lookback, trunc_like

def _n():
    return F.count(F.lit(1))


def _users():
    return F.count_distinct("ip_hash")


def app_totals(df: DataFrame) -> DataFrame:
    """Q01: crashes, distinct users, first and last arrival per app."""
    return (df.groupBy("app_name")
              .agg(_n().alias("total_crashes"), _users().alias("unique_users"),
                   F.min("created_at").alias("first_crash"),
                   F.max("created_at").alias("latest_crash"))
              .orderBy(F.desc("total_crashes"), "app_name"))


def recent_by_app(df: DataFrame, *, as_of, hours: float = 24, days: float = 0,
                  name: str = "crashes_today") -> DataFrame:
    """Q02 (24 h, ``crashes_today``) and R01 (7 days, ``crashes``)."""
    return (lookback(df, as_of, hours=hours, days=days)
            .groupBy("app_name").agg(_n().alias(name))
            .orderBy(F.desc(name), "app_name"))


def hourly_trend(df: DataFrame, *, as_of, days: float = 7) -> DataFrame:
    """Q03: crashes and distinct users per arrival hour."""
    src = lookback(df, as_of, days=days)
    return (src.groupBy(trunc_like("hour", src, "created_at").alias("hour"))
            .agg(_n().alias("crashes"), _users().alias("unique_users"))
            .orderBy("hour"))


def version_health(df: DataFrame) -> DataFrame:
    """Q04: crashes, affected users and crashes per user by app and version."""
    return (df.groupBy("app_name", "app_version")
              .agg(_n().alias("crashes"), _users().alias("affected_users"))
              .withColumn("crashes_per_user",
                          round_ratio(F.col("crashes"), F.col("affected_users"), 2))
              .orderBy("app_name", F.desc("crashes"), "app_version"))


def version_compare(df: DataFrame, app: str) -> DataFrame:
    """Q05: per version of one app, with the date it was first seen."""
    return (df.where(F.col("app_name") == app)
              .groupBy("app_version")
              .agg(_n().alias("total_crashes"), _users().alias("unique_users"),
                   F.to_date(F.min("created_at")).alias("version_first_seen"))
              .orderBy(F.desc_nulls_first("version_first_seen"), "app_version"))


def version_ratio(df: DataFrame, app: str) -> DataFrame:
    """Per version of one app, with crashes per user."""
    return (df.where(F.col("app_name") == app)
              .groupBy("app_version")
              .agg(_n().alias("total_crashes"), _users().alias("unique_users"))
              .withColumn("crashes_per_user",
                          round_ratio(F.col("total_crashes"), F.col("unique_users"), 2))
              .orderBy(F.desc("total_crashes"), "app_version"))


def platform_share(df: DataFrame) -> DataFrame:
    """Q06: crashes, users and percent of all crashes per platform.

    The share uses ``sum(crashes) over ()`` on the aggregated rows, at most
    one per platform (the table CHECK allows five), so the single-partition
    window sees five rows whatever the table size.
    """
    agg = (df.groupBy("platform")
             .agg(_n().alias("crashes"), _users().alias("unique_users")))
    total = F.sum("crashes").over(Window.partitionBy())
    return (agg.withColumn("percentage",
                           round_ratio(F.col("crashes"), total, 2, scale=100))
               .orderBy(F.desc("crashes"), "platform"))


def platform_daily(df: DataFrame, *, as_of, days: float = 30) -> DataFrame:
    """Q07: crashes per platform and arrival date."""
    return (lookback(df, as_of, days=days)
            .groupBy("platform", F.to_date("created_at").alias("date"))
            .agg(_n().alias("daily_crashes"))
            .orderBy(F.desc("date"), F.desc("daily_crashes"), "platform"))


def top_errors(df: DataFrame, n: int = 20, width: int = 100) -> DataFrame:
    """The ``n`` most frequent error prefixes.

    ``affected_apps`` is the sorted distinct app list; it is bounded by the
    number of apps, and ``collect_set`` deduplicates map-side.
    """
    return (df.where(F.col("error_message").isNotNull())
              .groupBy(left(F.col("error_message"), width).alias("error_preview"))
              .agg(_n().alias("frequency"), _users().alias("affected_users"),
                   F.array_sort(F.collect_set("app_name")).alias("affected_apps"))
              .orderBy(F.desc("frequency"), "error_preview")
              .limit(n))


def errors_for_app(df: DataFrame, app: str, width: int = 80) -> DataFrame:
    """Q09: error prefixes of one app by occurrences."""
    return (df.where((F.col("app_name") == app) & F.col("error_message").isNotNull())
              .groupBy("app_name", left(F.col("error_message"), width).alias("error_type"))
              .agg(_n().alias("occurrences"))
              .orderBy(F.desc("occurrences"), "error_type"))
