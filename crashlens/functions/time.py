"""Time helpers.  Every look-back takes an explicit reference time ``as_of``
so results are reproducible; the literal is folded into the scan filter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_timestamp(value) -> dt.datetime:
    """Parse ``value`` (datetime or ISO text, optional ``Z``) to naive UTC."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return value
    text = str(value).strip().replace("T", " ")
    if text.endswith("Z"):
        text = text[:-1]
    return dt.datetime.fromisoformat(text)


def _fmt(value: dt.datetime) -> str:
    return value.strftime("%Y-%m-%d %H:%M:%S.%f")


def ts_literal(value, like: T.DataType | None = None) -> Column:
    """Timestamp literal of the same flavour as the column it is compared to.

    ``TIMESTAMP_NTZ`` columns get an NTZ literal and ``TIMESTAMP`` columns a
    UTC instant, so the comparison never needs a cast on the column side and
    stays pushable to the Parquet reader.
    """
    text = F.lit(_fmt(as_timestamp(value)))
    if isinstance(like, T.TimestampNTZType):
        return text.cast("timestamp_ntz")
    return text.cast("timestamp")


def lookback(df: DataFrame, as_of, *, hours: float = 0, days: float = 0,
             column: str = "created_at", strict: bool = True) -> DataFrame:
    """Rows with ``column > as_of - (days, hours)`` (``>=`` if not strict).

    The bound is a literal on the raw column (pushed to Parquet).  When the
    table carries the ``created_date`` partition column the implied date
    bound is added too, so whole partitions are pruned.
    """
    since = as_timestamp(as_of) - dt.timedelta(days=days, hours=hours)
    col = F.col(column)
    lit = ts_literal(since, df.schema[column].dataType)
    out = df.where(col > lit if strict else col >= lit)
    if column == "created_at" and "created_date" in df.columns:
        out = out.where(F.col("created_date") >= F.lit(since.date()))
    return out


def day_name(col: Column) -> Column:
    """English weekday name, unpadded (``Monday``)."""
    return F.date_format(col, "EEEE")


def dow_sunday0(col: Column) -> Column:
    """Day of week with Sunday = 0 … Saturday = 6."""
    return (F.dayofweek(col) - 1).cast("int")


def trunc_like(unit: str, df: DataFrame, column: str) -> Column:
    """``date_trunc(unit, column)`` that keeps the column's timestamp type.

    ``date_trunc`` returns a session-zone ``TIMESTAMP`` even for
    ``TIMESTAMP_NTZ`` input; casting back keeps NTZ tables zone-free.
    """
    out = F.date_trunc(unit, F.col(column))
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        out = out.cast("timestamp_ntz")
    return out
