"""Deep pages with an exact total, without a scan.

A small index counts the reports of every arrival date, app and version.  Added up from the newest date
on, it turns an offset into a date and a rest, so that a page reads only the dates it lies in, however deep
it is, and gives the total but for the window's first, partial date.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.functions.time import as_timestamp
from crashlens.plans.reader import _check_params, _matching, _rows
from crashlens.schema import READ_DAYS_DEFAULT, READ_LIMIT_DEFAULT
from crashlens.session import overwrite_partitions

_INDEX = "app_name string, app_version string, n long, created_date date"


def refresh_page_index(facts: DataFrame, path: str, dates=None) -> None:
    """Recount the arrival ``dates`` that received reports (None: all)."""
    if dates is not None:
        facts = facts.where(F.col("created_date").isin(*[F.lit(d).cast("date") for d in dates]))
    counts = facts.groupBy("created_date", "app_name", "app_version").agg(F.count(F.lit(1)).alias("n"))
    overwrite_partitions(counts.repartition("created_date"), "created_date").parquet(path)


@dataclass(frozen=True)
class Page:
    """Rows of a page, and its envelope."""

    rows: DataFrame
    total: int
    has_more: bool
    dates: tuple[dt.date, ...]


def page_at(facts: DataFrame, index: str, *, app: str, as_of, version: str | None = None, days: int = READ_DAYS_DEFAULT,
            limit: int = READ_LIMIT_DEFAULT, offset: int = 0) -> Page:
    """The rows of ``reader.read_page`` and the numbers of ``reader.page_info``.

    One row a date reaches the driver (at most 366 up to ``as_of``).
    """
    _check_params(limit, offset, days)
    spark: SparkSession = facts.sparkSession
    since = as_timestamp(as_of) - dt.timedelta(days=days)
    counts = spark.read.schema(_INDEX).parquet(index).where(
        (F.col("created_date") > F.lit(since.date())) & (F.col("app_name") == app))
    if version is not None:
        counts = counts.where(F.col("app_version") == version)
    whole = {r["created_date"]: r["n"] for r in counts.groupBy("created_date").agg(F.sum("n").alias("n")).collect()}
    matching = _matching(facts, app, version, as_of, days=days)
    whole[since.date()] = matching.where(F.col("created_date") == F.lit(since.date())).count()
    chosen, rest, seen = [], 0, 0
    for date in sorted(whole, reverse=True):  # newest first, as pages are
        before, seen = seen, seen + whole[date]
        if seen > offset and before < offset + limit and whole[date]:
            rest = offset - before if not chosen else rest
            chosen.append(date)
    here = matching.where(F.col("created_date").isin(*[F.lit(d) for d in chosen]) if chosen else F.lit(False))
    rows = _rows(here).orderBy(F.desc("created_at"), "id").offset(rest).limit(limit)
    return Page(rows, seen, offset + limit < seen, tuple(chosen))
