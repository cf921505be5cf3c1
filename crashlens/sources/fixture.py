"""``crash_reports`` derived from the driver's ``events`` table.

The derivation is a pure projection (no shuffle): every event becomes one
stored crash report, with deterministic irregularities (NULL fields, a
missing GPU, a burst of arrivals at 22:00 on the last day, new error text on
the last day).  The same rules, written as SQL, drive the DuckDB oracle.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.functions.crypto import hmac_sha256_hex, ip_hash
from crashlens.functions.hardware import with_hardware
from crashlens.functions.time import ts_literal
from crashlens.schema import REPORT_COLUMNS
from crashlens.session import prepare

# Reference time of every fixture query ("now" of the analytics).
AS_OF = "2024-01-30 23:30:00"
# First instant of the fixture's last day, and the burst arrival time.
LAST_DAY = "2024-01-30 00:00:00"
BURST_AT = "2024-01-30 22:00:00"
# Shared secret the fixture's raw envelopes are signed with.
FIXTURE_SECRET = "fixture-hmac-secret"
# Events of the whole table for each file of a date.
EVENTS_PER_FILE = 2_000_000
# Whether the analytics' fixture table spreads an under-split events file.
SPREAD_ANALYTICS = True


def _s(c: Column) -> Column:
    return c.cast("string")


def _case(key: Column, values) -> Column:
    expr = None
    for i, v in enumerate(values[:-1]):
        expr = F.when(key == i, v) if expr is None else expr.when(key == i, v)
    return expr.otherwise(values[-1])


def derive_crash_reports(events: DataFrame) -> DataFrame:
    """Stored-report columns plus ``client_ip`` from ``events`` rows."""
    eid, uid, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    etype = F.col("event_type")
    ts_type = events.schema["ts"].dataType
    last_day = ts >= ts_literal(LAST_DAY, ts_type)
    u5 = F.floor(uid / 5).cast("bigint")

    error_message = F.when(eid % 11 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(etype, F.lit(" failed: code "), _s(eid % 17),
                 F.when(last_day & (eid % 7 == 0), F.lit(" NEW")).otherwise(F.lit(""))))
    stack_trace = F.when(eid % 19 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("at "), etype, F.lit(" (main.js:"), _s(eid % 97), F.lit(")")))
    gpu = F.when(uid % 4 == 0, F.lit("")).otherwise(F.concat(
        F.lit(',"gpu":{"name":"gpu-'), _s(uid % 6), F.lit('","memory":'),
        _s((uid % 6 + 1) * F.lit(2_000_000_000)), F.lit("}")))
    hardware = F.when(eid % 13 == 0, F.lit(None).cast("string")).otherwise(F.concat(
        F.lit('{"cpu":{"name":"cpu-'), _s(uid % 7),
        F.lit('","cores":'), _s((uid % 8 + 1) * 2),
        F.lit(',"freq":'), _s(F.lit(2000) + F.lit(100) * (uid % 9)),
        F.lit('},"memory":{"total":'), _s((uid % 12) * F.lit(3_000_000_000) + F.lit(2_000_000_000)),
        F.lit(',"available":'), _s((uid % 12) * F.lit(1_000_000_000) + F.lit(500_000_000)),
        F.lit('},"platform":{"system":"os-'), _s(u5 % 5),
        F.lit('","version":"'), _s(F.lit(10) + uid % 3),
        F.lit('","release":"r'), _s(uid % 4), F.lit('"}'),
        gpu, F.lit("}")))
    created_at = F.when(last_day & (uid % 5 == 3),
                        ts_literal(BURST_AT, ts_type)).otherwise(ts)
    client_ip = F.concat(F.lit("10.0."), _s(F.floor(uid / 250).cast("bigint")),
                         F.lit("."), _s(uid % 250))
    return events.select(
        eid.alias("id"),
        F.concat(F.lit("app-"), _s(uid % 5)).alias("app_name"),
        F.concat(F.lit("v"), _s(1 + uid % 2), F.lit("."), _s(eid % 3),
                 F.lit(".0")).alias("app_version"),
        ts.alias("crash_timestamp"),
        _case(u5 % 5, ["windows", "linux", "macos", "android", "ios"]).alias("platform"),
        error_message.alias("error_message"),
        stack_trace.alias("stack_trace"),
        hardware.alias("hardware_specs"),
        F.when(eid % 6 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("user-"), _s(uid))).alias("user_id"),
        F.when(eid % 9 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("s-"), _s(uid), F.lit("-"),
                             _s(F.to_date(ts)))).alias("session_id"),
        created_at.alias("created_at"),
        client_ip.alias("client_ip"),
    ).withColumn("ip_hash", ip_hash(F.col("client_ip")))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an under-split source over the cluster's cores.

    A file written as one large row group scans as a single task, and every
    per-row expression after it (JSON parsing, regexes, hashing) runs on one
    core.  Only when the scan has fewer splits than
    ``spark.default.parallelism`` is a repartition added; a large input
    already has many splits and is left alone (no extra shuffle at scale).
    """
    try:
        want = df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. Spark Connect): leave as is
        return df
    return df.repartition(want) if have < want else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables, spread if under-split."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def read_events(spark: SparkSession, sf_dir: str, spread_rows: bool = True) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    if spread_rows:
        return read_table(spark, sf_dir, "events")
    return spark.read.parquet(path)


def derived_crash_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy fact rows from ``events``: stored columns, the ``created_date``
    partition key and the parsed ``hw`` struct (no files written)."""
    prepare(spark)
    df = derive_crash_reports(read_events(spark, sf_dir, spread_rows=SPREAD_ANALYTICS))
    df = df.select(*REPORT_COLUMNS).withColumn(
        "created_date", F.to_date("created_at"))
    return with_hardware(df)


# bump when the derivation or the stored layout changes
FACT_LAYOUT_VERSION = "2"
_FACT_PATHS: dict[tuple, str] = {}
# scans of written fixture tables per session: immutable folders, so the file
# listing and footer schema are read once, as a catalog table would cache them
_TABLES: dict[tuple, DataFrame] = {}


def _fingerprint(sf_dir: str) -> str:
    src = os.path.join(os.path.abspath(sf_dir), "events.parquet")
    try:
        st = os.stat(src)
        stamp = f"{st.st_size}:{int(st.st_mtime)}"
    except OSError:
        stamp = "remote"
    key = f"{os.path.abspath(sf_dir)}|{stamp}|{FACT_LAYOUT_VERSION}"
    return hashlib.sha1(key.encode()).hexdigest()[:16]


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jpath.getFileSystem(conf), jpath, jvm


def materialized(spark: SparkSession, sf_dir: str, name: str, build,
                 partition_by: str | None = None, files_per_value=2, fmt: str = "parquet") -> str:
    """Path of a table derived from the driver tables, written once.

    The folder lives under the session's shared ``spark.checkpoint.dir``
    and is keyed by the source files and the layout version, so it is
    reused while the source is unchanged.  It is written to a staging
    folder and renamed into place, so concurrent writers never expose a
    partial table; a written table also cuts the lineage of what reads it.
    ``files_per_value`` may be a function, called only when the table is written.
    """
    from crashlens.session import by_partition, checkpoint_dir

    fp = _fingerprint(sf_dir)
    app = spark.sparkContext.applicationId
    path = _FACT_PATHS.get((app, name, fp))
    if path is not None:
        return path
    path = f"{checkpoint_dir(spark).rstrip('/')}/crashlens-{name}/{fp}"
    fs, target, jvm = _hadoop_fs(spark, path)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        staging = f"{path}.staging-{uuid.uuid4().hex}"
        rows = build()
        if partition_by:
            rows = by_partition(rows, partition_by, files_per_value() if callable(files_per_value) else files_per_value)
        writer = rows.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.format(fmt).save(staging)
        fs.mkdirs(target.getParent())
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
            fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    _FACT_PATHS[(app, name, fp)] = path
    return path


def derived_root(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder below ``spark.checkpoint.dir`` for tables that this application keeps from the fact table."""
    from crashlens.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/crashlens-{name}/{spark.sparkContext.applicationId}-{_fingerprint(sf_dir)}"


def crash_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table as the analytics see it, stored the way ingestion
    stores it: Parquet partitioned by ``created_date`` with the parsed
    ``hw`` struct next to the raw JSON.

    The derivation from ``events`` is written once (``materialized``) and
    then scanned, so every query plan is a real scan: look-backs push
    ``created_at`` bounds into the reader and prune ``created_date``
    partitions, and only the nested ``hw`` leaves a query uses are read.
    """
    prepare(spark)
    from crashlens.sources.reports import crash_reports

    path = crash_table_path(spark, sf_dir)
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = crash_reports(spark, path)
    return _TABLES[key]


def files_per_date(events: int) -> int:
    """Writer tasks a date, more for a longer table, so that none of them has to read more rows for it."""
    return max(2, events // EVENTS_PER_FILE)


def crash_table_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the stored fact table (written on first use)."""
    return materialized(spark, sf_dir, "facts", lambda: derived_crash_table(spark, sf_dir), "created_date",
                        lambda: files_per_date(read_events(spark, sf_dir, spread_rows=False).count()))


def landing_zone(spark: SparkSession, sf_dir: str,
                 secret: str = FIXTURE_SECRET) -> str:
    """Folder of signed raw envelopes (Parquet), as a collector would land
    them; batch and streaming admission read from here."""
    prepare(spark)
    return materialized(spark, sf_dir, f"landing-{hashlib.sha1(secret.encode()).hexdigest()[:8]}",
                        lambda: derive_raw_envelopes(spark, sf_dir, secret))


def raw_envelopes(spark: SparkSession, sf_dir: str,
                  secret: str = FIXTURE_SECRET) -> DataFrame:
    """Signed POST envelopes that would have produced ``crash_table``, read
    from the landing folder (``landing_zone``)."""
    from crashlens.sources.reports import read_reports

    path = landing_zone(spark, sf_dir, secret)
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = read_reports(spark, path, "parquet")
    return _TABLES[key]


def derive_raw_envelopes(spark: SparkSession, sf_dir: str,
                         secret: str = FIXTURE_SECRET) -> DataFrame:
    """Signed POST envelopes that would have produced ``crash_table`` (lazy).

    ``body`` is the JSON report a client sends (ISO ``Z`` timestamp, nested
    hardware object), ``arrived_at`` the arrival instant (``created_at``).
    """
    prepare(spark)
    df = derive_crash_reports(read_events(spark, sf_dir))
    iso = F.concat(F.date_format("crash_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                   F.lit("Z"))
    hw = F.when(F.col("hardware_specs").isNotNull(),
                F.parse_json(F.col("hardware_specs")))
    body = F.to_json(F.struct(
        F.col("app_name"), F.col("app_version"), F.col("platform"),
        iso.alias("crash_timestamp"), F.col("error_message"),
        F.col("stack_trace"), hw.alias("hardware_specs"),
        F.col("user_id"), F.col("session_id")))
    arrived = F.to_timestamp(F.concat(
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    out = df.select(
        _s(F.col("id")).alias("request_id"),
        body.alias("body"),
        F.col("client_ip"),
        arrived.alias("arrived_at"),
    )
    return out.withColumn(
        "signature", F.concat(F.lit("sha256="), hmac_sha256_hex(F.col("body"), secret))
    ).select("request_id", "body", "signature", "client_ip", "arrived_at")
