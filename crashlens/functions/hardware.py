"""Typed access to the free-form ``hardware_specs`` JSON.

The JSON is parsed once per row with one explicit schema (unknown keys are
ignored, missing keys are NULL); Catalyst prunes the parsed struct to the
fields a query uses.  Stored tables keep the parsed ``hw`` struct so Parquet
reads only the nested leaves a query touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.schema import HARDWARE_SCHEMA


def _as_text(kind: T.DataType) -> T.DataType:
    """The same shape with every number read as text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind])
    return T.StringType()


def _typed(col: Column, kind: T.DataType) -> Column:
    """Text leaves cast to ``kind``; text that is no number becomes NULL, a missing object stays NULL."""
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_typed(col[f.name], f.dataType).alias(f.name) for f in kind]))
    return col if isinstance(kind, T.StringType) else col.try_cast(kind)


def parse_hardware(col: Column) -> Column:
    """``HARDWARE_SCHEMA`` of a JSON text; a number may also have been sent as text (``"cores": "8"``)."""
    return _typed(F.from_json(col, _as_text(HARDWARE_SCHEMA)), HARDWARE_SCHEMA)


def with_hardware(df: DataFrame, source: str = "hardware_specs",
                  target: str = "hw") -> DataFrame:
    """Add the parsed ``hw`` struct unless the table already carries it."""
    if target in df.columns:
        return df
    return df.withColumn(target, parse_hardware(F.col(source)))


def hw_int(path: str) -> Column:
    """JSON number at ``hw.<path>`` as int, fraction truncated."""
    return F.col(f"hw.{path}").try_cast("int")


def hw_bigint(path: str) -> Column:
    """JSON number at ``hw.<path>`` as bigint, fraction truncated."""
    return F.col(f"hw.{path}").try_cast("bigint")


def cpu_name() -> Column:
    """CPU name; writers that only send ``cpu.model`` are read through it."""
    return F.coalesce(F.col("hw.cpu.name"), F.col("hw.cpu.model"))


def memory_tier(col: Column, edges, labels) -> Column:
    """Searched CASE ``col < edges[i] -> labels[i]``, ELSE the last label.

    A NULL value falls through to the ELSE label, as in SQL.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    expr = None
    for edge, label in zip(edges, labels):
        cond = col < F.lit(edge)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(labels[-1])
