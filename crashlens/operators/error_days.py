"""New error texts from a bitmap of the days on which each was seen.

One snapshot a date holds, for every prefix of the last 31 days, a mask whose bit i says that it was seen i days
before.  "Seen today, and on none of the 30 days before" is the mask 1, so new errors need the snapshot and one
day of facts instead of 30.  A snapshot comes from the one before: masks shift, today's prefixes set bit 0, and
prefixes not seen for 31 days fall out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.functions.text import left
from crashlens.session import overwrite_partitions

DAYS = 31
_FULL = (1 << DAYS) - 1
_SNAPSHOT = "prefix string, mask long, created_date date"


def _date(value) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value))


def _prefixes(facts: DataFrame, width: int) -> DataFrame:
    return facts.where(F.col("error_message").isNotNull()).select(
        left(F.col("error_message"), width).alias("prefix"), "created_date")


def _write(snapshot: DataFrame, path: str, date: dt.date) -> None:
    overwrite_partitions(snapshot.select("prefix", "mask", F.lit(date).alias("created_date")), "created_date").parquet(path)


def build_error_days(facts: DataFrame, path: str, date, width: int = 100) -> None:
    """The snapshot of ``date`` from the facts of its 31 days (start, or repair after late rows)."""
    date = _date(date)
    rows = _prefixes(facts, width).where(F.col("created_date").between(F.lit(date - dt.timedelta(days=DAYS - 1)), F.lit(date)))
    bit = F.expr("shiftleft(1L, int(_age))")
    masks = rows.withColumn("_age", F.datediff(F.lit(date), "created_date")).groupBy("prefix").agg(F.bit_or(bit).alias("mask"))
    _write(masks, path, date)


def read_error_days(spark: SparkSession, path: str, date) -> DataFrame:
    return spark.read.schema(_SNAPSHOT).parquet(path).where(F.col("created_date") == F.lit(_date(date)))


def advance_error_days(facts: DataFrame, path: str, date, previous=None, width: int = 100) -> None:
    """The snapshot of ``date`` from that of ``previous`` (default: the day before) and one day of facts."""
    date = _date(date)
    previous = _date(previous) if previous is not None else date - dt.timedelta(days=1)
    gap = (date - previous).days
    if gap < 1:
        raise ValueError("previous must lie before date")
    moved: Column = F.shiftleft("mask", min(gap, DAYS)).bitwiseAND(F.lit(_FULL))
    old = read_error_days(facts.sparkSession, path, previous).select("prefix", moved.alias("mask"))
    today = _prefixes(facts.where(F.col("created_date") == F.lit(date)), width).select("prefix", F.lit(1).cast("long").alias("mask"))
    masks = old.unionByName(today).groupBy("prefix").agg(F.bit_or("mask").alias("mask")).where("mask <> 0")
    _write(masks, path, date)


def new_errors_of_day(facts: DataFrame, path: str, date, history_days: int = 30, width: int = 100) -> DataFrame:
    """``new_error, occurrences``: prefixes of ``date`` not seen on the ``history_days`` (at most 30) days before."""
    if not 1 <= history_days < DAYS:
        raise ValueError("history_days must be between 1 and 30")
    past = F.lit((1 << (history_days + 1)) - 2)
    fresh = read_error_days(facts.sparkSession, path, date).where(
        (F.col("mask").bitwiseAND(F.lit(1)) == 1) & (F.col("mask").bitwiseAND(past) == 0))
    today = _prefixes(facts.where(F.col("created_date") == F.lit(_date(date))), width)
    counts = today.groupBy("prefix").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.join(fresh.select("prefix"), "prefix", "left_semi").select(F.col("prefix").alias("new_error"), "occurrences")
