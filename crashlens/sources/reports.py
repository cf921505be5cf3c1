"""Reads and writes of raw reports and of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.functions.hardware import with_hardware
from crashlens.schema import RAW_SCHEMA, REPORT_COLUMNS
from crashlens.session import by_partition, prepare


def read_reports(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw request envelopes (S1): ``request_id, body, signature, client_ip,
    arrived_at``.  ``fmt`` is ``json`` (JSON lines of envelopes, explicit
    schema, no inference), ``parquet``, or ``bodies``: plain text files with
    one report body per line (no signature or address; arrival time is the
    file's modification time, the id a hash of file, line position and line).  Bodies stay
    text; parsing is part of admission so malformed JSON becomes a
    quarantined row, not a failed job."""
    prepare(spark)
    if fmt == "json":
        lines = (spark.read.schema(T.StructType([*RAW_SCHEMA.fields, T.StructField("_corrupt", T.StringType())]))
                 .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path))
        # the text of a malformed line becomes the body, so that it is quarantined as it came
        return lines.withColumn("body", F.coalesce("body", "_corrupt")).select(*[f.name for f in RAW_SCHEMA.fields])
    if fmt == "parquet":
        return spark.read.parquet(path).select(*[f.name for f in RAW_SCHEMA.fields])
    if fmt == "bodies":
        lines = spark.read.text(path).select("value", "_metadata")
        return lines.select(
            F.sha2(F.concat_ws("|", F.col("_metadata.file_path"), F.monotonically_increasing_id().cast("string"),
                               F.col("value")), 256)
             .alias("request_id"),
            F.col("value").alias("body"),
            F.lit(None).cast("string").alias("signature"),
            F.lit(None).cast("string").alias("client_ip"),
            F.col("_metadata.file_modification_time").alias("arrived_at"))
    raise ValueError(f"unsupported format: {fmt}")


def crash_reports(spark: SparkSession, path: str) -> DataFrame:
    """Scan of the stored fact table (S2), partitioned by ``created_date``.

    Look-back filters on ``created_at`` are pushed to the Parquet reader and
    the implied ``created_date`` bound prunes partitions (see ``lookback``).
    """
    prepare(spark)
    return with_hardware(spark.read.parquet(path))


def append_reports(df: DataFrame, path: str, files_per_date: int | None = None) -> None:
    """Append accepted rows (S5, append only: no update or delete path).

    No shuffle by default (see ``session.by_partition``); ``files_per_date``
    spreads each arrival date over that many writer tasks.
    """
    cols = [c for c in REPORT_COLUMNS + ["hw", "created_date"] if c in df.columns]
    out = df.select(*cols)
    if "created_date" not in out.columns:
        out = out.withColumn("created_date", F.to_date("created_at"))
    (by_partition(out, "created_date", files_per_date).write.mode("append")
        .partitionBy("created_date").parquet(path))


def flatten_for_export(df: DataFrame) -> DataFrame:
    """Shape a result for flat sinks (CSV) and for engine comparison.

    Arrays become comma-joined text, decimals doubles, day-time intervals are
    dropped when a ``*_seconds`` twin exists and otherwise become seconds.
    """
    cols = []
    names = set(df.columns)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(c, ",").alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(c.cast("double").alias(f.name))
        elif isinstance(f.dataType, T.DayTimeIntervalType):
            if f"{f.name}_seconds" in names or "session_seconds" in names:
                continue
            cols.append((F.unix_micros(F.timestamp_seconds(F.lit(0)) + c) / 1e6)
                        .alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.MapType, T.VariantType)):
            cols.append(F.to_json(c).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """CSV or JSON export (S6); written in parallel, one file per task."""
    if fmt == "csv":
        flatten_for_export(df).write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode(mode).json(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def register_views(spark: SparkSession, reports: DataFrame | str,
                   rollup: DataFrame | None = None) -> None:
    """Expose ``crash_reports`` and ``crash_analytics`` to SQL users.

    ``reports`` is the fact table or the folder it is stored in."""
    from crashlens.operators.rollup import hourly_rollup

    if isinstance(reports, str):
        reports = crash_reports(spark, reports)
    reports.createOrReplaceTempView("crash_reports")
    (rollup if rollup is not None else hourly_rollup(reports)) \
        .createOrReplaceTempView("crash_analytics")


def replay_fallback(fallback: DataFrame, platform: str | None = None,
                    client_ip: str = "unknown", arrived_at=None) -> DataFrame:
    """Turn locally stored fallback records into raw envelopes.

    Fallback rows carry ``timestamp, error, stack, app_name, app_version``
    (and optionally ``client_ip``, ``arrived_at``, ``platform``).  They have
    no signature and no hardware; the admission run for replays skips the
    signature guard and takes a ``max_age`` fit for late data.  The platform
    goes through the clients' alias map (``darwin`` -> ``macos``).  Without a
    ``platform`` (column or parameter) rows fail rule V3 and are
    quarantined, as they would be if posted.
    """
    from crashlens.functions.text import normalize_platform

    cols = set(fallback.columns)
    plat = F.col("platform") if "platform" in cols else F.lit(platform).cast("string")
    plat = normalize_platform(plat)  # Z11: clients send OS ids through this map
    body = F.to_json(F.struct(
        F.col("app_name"), F.col("app_version"), plat.alias("platform"),
        F.col("timestamp").alias("crash_timestamp"),
        F.col("error").alias("error_message"),
        F.col("stack").alias("stack_trace")))
    ip = F.col("client_ip") if "client_ip" in cols else F.lit(client_ip)
    if "arrived_at" in cols:
        arrived = F.col("arrived_at")
    elif arrived_at is not None:
        from crashlens.functions.time import ts_literal
        arrived = ts_literal(arrived_at, T.TimestampType())
    else:
        arrived = F.current_timestamp()
    rid = (F.col("request_id").cast("string") if "request_id" in cols
           else F.sha2(F.to_json(F.struct("timestamp", "app_name", "app_version", "error", "stack",
                                          ip.cast("string").alias("client"),
                                          *([F.col("arrived_at")] if "arrived_at" in cols else []))), 256))
    return fallback.select(
        rid.alias("request_id"), body.alias("body"),
        F.lit(None).cast("string").alias("signature"),
        ip.cast("string").alias("client_ip"), arrived.cast("timestamp").alias("arrived_at"))
