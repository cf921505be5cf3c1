"""Trailing baselines from prefix moments (J1, Q28 at every hour).

The mean and deviation of rollup cells over any window need only three sums: cells, crashes and squared
crashes.  Kept per app and hour, and added up along the hours, a window's sums are the difference of
two prefixes, so that every hour gets a baseline of its own in one pass, and a new hour adds one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.functions.numeric import round_ratio

HOUR, DAY = 3600, 86_400
_BIG = "decimal(38,0)"


def hour_moments(cells: DataFrame) -> DataFrame:
    """``app_name, hour, n, s, s2`` of rollup cells (a cell's crashes, their sum and their squares' sum)."""
    x = F.col("crash_count").cast(_BIG)
    return cells.groupBy("app_name", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.sum("crash_count").cast("long").alias("s"), F.sum(x * x).cast(_BIG).alias("s2"))


def add_moments(moments: DataFrame) -> DataFrame:
    """One row per app and hour of moments that came in parts (cells of different batches are different cells
    only if their keys differ, see ``hour_moments``)."""
    return moments.groupBy("app_name", "hour").agg(
        F.sum("n").cast("long").alias("n"), F.sum("s").cast("long").alias("s"), F.sum("s2").cast(_BIG).alias("s2"))


def trailing_baseline(moments: DataFrame, baseline_days: float = 7) -> DataFrame:
    """``app_name, hour`` and ``base_n, base_s, base_s2`` of the cells with ``hour + 1h - baseline_days < cell hour < hour``.

    That is the baseline of Q28 asked when the hour has just ended.  Both prefixes are running sums over the hours
    of an app (at most one row an hour, whatever the number of reports).
    """
    at = F.unix_seconds(F.col("hour").cast("timestamp"))
    rows = moments.withColumn("_at", at)
    w = Window.partitionBy("app_name").orderBy("_at")
    upper = w.rangeBetween(Window.unboundedPreceding, -1)
    lower = w.rangeBetween(Window.unboundedPreceding, int(HOUR - baseline_days * DAY))

    def between(c: str) -> Column:
        return F.coalesce(F.sum(c).over(upper), F.lit(0)) - F.coalesce(F.sum(c).over(lower), F.lit(0))

    return rows.select("app_name", "hour", between("n").cast("long").alias("base_n"),
                       between("s").cast("long").alias("base_s"), between("s2").cast(_BIG).alias("base_s2"))


def spikes_by_hour(cells: DataFrame, baseline: DataFrame, k: float = 2.0) -> DataFrame:
    """Cells above ``mean + k * sd`` of their own hour's baseline: app_name, app_version, platform, hour,
    recent_crashes, avg_crashes (6 decimals) and z_score (2 decimals).

    As in Q28, a baseline of fewer than two cells has no deviation and flags nothing; equal cells have deviation 0,
    and then a larger cell is flagged without a z-score.
    """
    n, s, s2 = F.col("base_n").cast("double"), F.col("base_s").cast("double"), F.col("base_s2").cast("double")
    spread = F.nullif(n * (n - 1), F.lit(0.0))
    sd = F.sqrt(F.greatest(n * s2 - s * s, F.lit(0.0)) / spread)
    mean = s / n
    rated = baseline.where(F.col("base_n") > 0).withColumn("_sd", sd).withColumn("_mean", mean)
    met = cells.join(rated, ["app_name", "hour"])
    x = F.col("crash_count")
    return met.where(x > F.col("_mean") + F.lit(k) * F.col("_sd")).select(
        "app_name", "app_version", "platform", "hour", x.alias("recent_crashes"),
        round_ratio(F.col("base_s"), F.col("base_n"), 6).alias("avg_crashes"),
        F.round((x - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)), 2).alias("z_score"))
