"""Monitoring: spike detection (Q28) and new error types (Q29)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.functions.numeric import round_ratio
from crashlens.functions.text import left
from crashlens.functions.time import as_timestamp, ts_literal
from crashlens.plans.rollup_views import rollup_window

HOUR = dt.timedelta(hours=1)


def _trunc_hour(t: dt.datetime) -> dt.datetime:
    return t.replace(minute=0, second=0, microsecond=0)


def spikes(source: DataFrame, *, as_of, k: float = 2.0, baseline_days: float = 7,
           exclude_current: bool = False, zero_fill: bool = False) -> DataFrame:
    """Q28: rollup cells of the last full hour above ``mean + k * sd``.

    Baseline: per app, the rollup cells with ``as_of - baseline_days < hour
    < as_of - 1h`` (this includes the hour under test unless ``as_of`` is
    on the hour; ``exclude_current=True`` leaves it out).  ``zero_fill``
    switches to the app-hour grain and counts hours without crashes as 0,
    from sums and sums of squares (no row per empty hour is generated).

    Output ``app_name, recent_crashes, avg_crashes, z_score`` with the mean
    rounded to 6 and the z-score to 2 decimals.

    Plan: the rollup for the window is built once (one scan, one shuffle on
    the cell key); the per-app baseline is a window over the cells of each
    app (conditional aggregates, no join), and only then are the cells of
    the tested hour kept.  An app's cells are bounded by versions x
    platforms x hours in the window, whatever the raw row count.
    """
    now = as_timestamp(as_of)
    recent_hour = _trunc_hour(now - HOUR)
    upper = recent_hour if exclude_current else now - HOUR
    cells = rollup_window(source, as_of=now, days=baseline_days)
    htype = cells.schema["hour"].dataType
    if zero_fill:
        cells = (cells.groupBy("app_name", "hour")
                      .agg(F.sum("crash_count").cast("bigint").alias("crash_count")))
    in_base = F.col("hour") < ts_literal(upper, htype)
    x = F.when(in_base, F.col("crash_count"))
    app = Window.partitionBy("app_name")
    if zero_fill:
        start = now - dt.timedelta(days=baseline_days)
        n_hours, h = 0, _trunc_hour(start) + HOUR
        while h < upper:
            n_hours += 1
            h += HOUR
        c = F.lit(n_hours).cast("bigint")
        cells = cells.select("*", F.sum(x).over(app).alias("_s"),
                             F.sum(x * x).over(app).alias("_s2"))
        mean = F.col("_s") / c
        sd = F.when(c > 1, F.sqrt((F.col("_s2") - c * mean * mean) / (c - 1)))
        cells = cells.select("*", c.alias("_c"), mean.alias("_mean"), sd.alias("_sd"))
    else:
        # one window pass: all four aggregates share the per-app spec
        cells = cells.select("*", F.sum(x).over(app).alias("_s"),
                             F.count(x).over(app).alias("_c"),
                             F.avg(x).over(app).alias("_mean"),
                             F.stddev_samp(x).over(app).alias("_sd"))
    recent = cells.where((F.col("hour") == ts_literal(recent_hour, htype))
                         & (F.col("_c") > 0))
    z = F.round((F.col("crash_count") - F.col("_mean"))
                / F.nullif(F.col("_sd"), F.lit(0.0)), 2)
    return (recent.where(F.col("crash_count") > F.col("_mean") + F.lit(k) * F.col("_sd"))
                  .select("app_name", F.col("crash_count").alias("recent_crashes"),
                          round_ratio(F.col("_s"), F.col("_c"), 6).alias("avg_crashes"),
                          z.alias("z_score"))
                  .orderBy(F.desc_nulls_first("z_score"), "app_name", "recent_crashes"))


def new_errors(df: DataFrame, *, as_of, width: int = 100, recent_hours: float = 24,
               history_days: float = 30, method: str = "aggregate") -> DataFrame:
    """Q29: error prefixes seen in the last ``recent_hours`` but not in
    ``[as_of - history_days, as_of - recent_hours]``, with their count.

    ``method="aggregate"`` (default) reads the 30-day range once and decides
    per prefix in one grouped aggregation: one shuffle, map-side combined, so
    a hot prefix never lands whole in one task.  ``method="anti_join"``
    writes the same as a ``left_anti`` join of recent counts against the
    distinct historical prefixes.
    """
    now = as_timestamp(as_of)
    cut = now - dt.timedelta(hours=recent_hours)
    start = now - dt.timedelta(days=history_days)
    ctype = df.schema["created_at"].dataType
    created = F.col("created_at")
    prefix = left(F.col("error_message"), width).alias("new_error")
    msgs = df.where(F.col("error_message").isNotNull())
    if "created_date" in df.columns:
        msgs = msgs.where(F.col("created_date") >= F.lit(start.date()))
    if method == "anti_join":
        recent = (msgs.where(created > ts_literal(cut, ctype))
                      .groupBy(prefix).agg(F.count(F.lit(1)).alias("occurrences")))
        hist = (msgs.where(created.between(ts_literal(start, ctype), ts_literal(cut, ctype)))
                    .select(prefix).distinct())
        out = recent.join(hist, "new_error", "left_anti")
    elif method == "aggregate":
        is_recent = created > ts_literal(cut, ctype)
        out = (msgs.where(created >= ts_literal(start, ctype))
                   .groupBy(prefix)
                   .agg(F.count_if(is_recent).alias("occurrences"),
                        F.max(~is_recent).alias("_seen"))
                   .where((F.col("occurrences") > 0) & ~F.col("_seen"))
                   .drop("_seen"))
    else:
        raise ValueError(f"unknown method: {method}")
    return out.orderBy(F.desc("occurrences"), "new_error")
