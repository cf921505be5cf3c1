"""Reader operations (C-1 … C-4): paged reads, statistics, searches.

The original reader clients fetched at most 100 rows and computed their
statistics locally; here every statistic is a distributed aggregate over
all matching rows and only a few result rows reach the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.functions.text import contains_ci, unknown_if_blank
from crashlens.functions.time import as_timestamp, lookback, ts_literal
from crashlens.schema import (
    READ_DAYS_DEFAULT, READ_DAYS_RANGE, READ_LIMIT_DEFAULT, READ_LIMIT_RANGE,
    REPORT_COLUMNS,
)


def _check_params(limit: int, offset: int, days: int) -> None:
    lo, hi = READ_LIMIT_RANGE
    if not lo <= limit <= hi:
        raise ValueError(f"Limit must be between {lo} and {hi}")
    if offset < 0:
        raise ValueError("Offset must be non-negative")
    lo, hi = READ_DAYS_RANGE
    if not lo <= days <= hi:
        raise ValueError(f"Days must be between {lo} and {hi}")


def _matching(df: DataFrame, app: str | None, version: str | None,
              as_of, days: float = 0, hours: float = 0) -> DataFrame:
    if app is not None:
        df = df.where(F.col("app_name") == app)
    if version is not None:
        df = df.where(F.col("app_version") == version)
    return lookback(df, as_of, days=days, hours=hours)


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in REPORT_COLUMNS if c in df.columns])


def read_page(df: DataFrame, *, app: str, as_of, version: str | None = None,
              days: int = READ_DAYS_DEFAULT, limit: int = READ_LIMIT_DEFAULT,
              offset: int = 0) -> DataFrame:
    """C-1 / S4: one page of reports, newest arrival first (``id`` breaks
    ties).  Bounds: ``1 <= limit <= 100``, ``offset >= 0``, ``1 <= days <=
    365`` (``ValueError`` otherwise).  Plans as a top-(offset+limit) sort;
    for deep pages use a keyset filter (``created_at < last seen``)."""
    _check_params(limit, offset, days)
    out = (_rows(_matching(df, app, version, as_of, days=days))
           .orderBy(F.desc("created_at"), "id"))
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def read_page_after(df: DataFrame, *, app: str, as_of, after_created_at=None,
                    after_id=None, version: str | None = None,
                    days: int = READ_DAYS_DEFAULT,
                    limit: int = READ_LIMIT_DEFAULT) -> DataFrame:
    """Keyset page: the ``limit`` reports that follow ``(after_created_at,
    after_id)`` in ``created_at desc, id`` order.  Unlike an offset, deep
    pages cost the same as the first (the bound is a pushed-down filter)."""
    _check_params(limit, 0, days)
    src = _matching(df, app, version, as_of, days=days)
    if after_created_at is not None:
        t = ts_literal(after_created_at, src.schema["created_at"].dataType)
        c = F.col("created_at")
        cond = c < t
        if after_id is not None:
            cond = cond | ((c == t) & (F.col("id") > F.lit(after_id)))
        src = src.where(cond)
    return _rows(src).orderBy(F.desc("created_at"), "id").limit(limit)


def page_info(df: DataFrame, *, app: str, as_of, version: str | None = None,
              days: int = READ_DAYS_DEFAULT, limit: int = READ_LIMIT_DEFAULT,
              offset: int = 0) -> dict:
    """Pagination envelope for ``read_page``: exact total (S9) and has_more."""
    _check_params(limit, offset, days)
    total = _matching(df, app, version, as_of, days=days).count()
    return {"limit": limit, "offset": offset, "total": total,
            "has_more": offset + limit < total,
            "filters": {"app_name": app, "app_version": version, "days": days}}


def crash_stats(df: DataFrame, *, as_of, app: str | None = None,
                version: str | None = None, days: int = READ_DAYS_DEFAULT,
                top: int = 10) -> DataFrame:
    """C-2: statistics as long rows ``(dimension, value, n)``.

    Dimensions: ``total_crashes``, ``unique_users``, ``unique_sessions``,
    ``last_24h`` / ``last_7d`` / ``last_30d`` (cumulative, crash time ``>=``
    cut-off), and one row per value for ``platform``, ``version`` and the
    ``top`` most frequent ``error`` texts (NULL or '' count as ``unknown``).
    Frequencies come from one grouped aggregation over an exploded
    (dimension, value) pair; the error top-k is a ranked filter that Spark
    runs as a partial per-task limit before the shuffle.
    """
    now = as_timestamp(as_of)
    src = _matching(df, app, version, now, days=days)
    ctype = src.schema["crash_timestamp"].dataType

    def since(d):
        return F.col("crash_timestamp") >= ts_literal(now - dt.timedelta(days=d), ctype)

    scalars = src.agg(
        F.count(F.lit(1)).alias("total_crashes"),
        F.count_distinct(F.nullif(F.col("user_id"), F.lit(""))).alias("unique_users"),
        F.count_distinct(F.nullif(F.col("session_id"), F.lit(""))).alias("unique_sessions"),
        F.count_if(since(1)).alias("last_24h"),
        F.count_if(since(7)).alias("last_7d"),
        F.count_if(since(30)).alias("last_30d"))
    names = ["total_crashes", "unique_users", "unique_sessions",
             "last_24h", "last_7d", "last_30d"]
    scalars = scalars.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("dimension"), F.lit(None).cast("string").alias("value"),
                 F.col(n).cast("bigint").alias("n")) for n in names])).alias("r")
    ).select("r.*")
    pairs = src.select(F.explode(F.array(
        F.struct(F.lit("platform").alias("dimension"),
                 unknown_if_blank(F.col("platform")).alias("value")),
        F.struct(F.lit("version").alias("dimension"),
                 unknown_if_blank(F.col("app_version")).alias("value")),
        F.struct(F.lit("error").alias("dimension"),
                 unknown_if_blank(F.col("error_message")).alias("value")),
    )).alias("p")).select("p.*")
    freq = pairs.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(
        Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))
    errors = (freq.where(F.col("dimension") == "error")
                  .withColumn("_r", rank).where(F.col("_r") <= top).drop("_r"))
    others = freq.where(F.col("dimension") != "error")
    return scalars.unionByName(others).unionByName(errors)


def recent_crashes(df: DataFrame, *, as_of, app: str | None = None,
                   version: str | None = None, hours: float = 24) -> DataFrame:
    """C-3: reports that arrived in the last ``hours`` (exact hours)."""
    return (_rows(_matching(df, app, version, as_of, hours=hours))
            .orderBy(F.desc("created_at"), "id"))


def crashes_by_error(df: DataFrame, text: str, *, as_of, app: str | None = None,
                     version: str | None = None, days: float = 30) -> DataFrame:
    """C-4: reports whose error contains ``text`` (case-insensitive,
    literal: ``%`` and ``_`` have no special meaning)."""
    return (_rows(_matching(df, app, version, as_of, days=days)
                  .where(contains_ci(F.col("error_message"), text)))
            .orderBy(F.desc("created_at"), "id"))
