"""Registered queries: each key pairs a Spark plan over the driver tables
with its DuckDB formulation (``oracle.py``).

Spark callables take ``(spark, sf_dir)`` and return a DataFrame shaped for
comparison (``flatten_for_export``: arrays as joined text, intervals as
seconds).  Keys without SQL are checked by row count only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens import plans as P
from crashlens.functions.text import REMOVED_CHARS, TRIM_CHARS, sanitize
from crashlens.operators import admit, hourly_rollup, split
from crashlens.oracle import (
    CORES, CPU, GPU, MEM, SYS, avg_gb, joined, num, q, ratio, tier, ts,
)
from crashlens.schema import (
    MEMORY_TIERS_3, MEMORY_TIERS_4, MEMORY_TIERS_5, REPORT_COLUMNS,
)
from crashlens.session import checkpoint_dir
from crashlens.sources.fixture import (
    AS_OF, FIXTURE_SECRET, crash_table, crash_table_path, landing_zone, materialized,
    raw_envelopes, read_table,
)
from crashlens.sources.reports import flatten_for_export, replay_fallback
from crashlens.streaming import (
    dedup_stream, hourly_rollup_stream, read_ingested, read_report_stream, read_rollup,
    read_rollup_sums, spike_alerts, start_ingest, start_rollup,
)

APP = "app-1"
SEARCH = "CLICK Failed: code 1"

Query = Callable[[SparkSession, str], DataFrame]
_SPARK: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flatten_for_export(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _SPARK[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _t(spark, d):
    return crash_table(spark, d)


W7 = f"created_at > {ts(days=7)}"
COLS = ", ".join(REPORT_COLUMNS)

# --------------------------------------------------------------- basic ----


@register("q01_app_totals", q(
    "SELECT app_name, COUNT(*) AS total_crashes, COUNT(DISTINCT ip_hash) AS unique_users, "
    "MIN(created_at) AS first_crash, MAX(created_at) AS latest_crash "
    "FROM crash_reports GROUP BY app_name"))
def _q01(spark, d):
    return P.app_totals(_t(spark, d))


@register("q02_recent_by_app", q(
    f"SELECT app_name, COUNT(*) AS crashes_today FROM crash_reports "
    f"WHERE created_at > {ts(hours=24)} GROUP BY app_name"))
def _q02(spark, d):
    return P.recent_by_app(_t(spark, d), as_of=AS_OF, hours=24)


@register("q03_hourly_trend", q(
    f"SELECT date_trunc('hour', created_at) AS hour, COUNT(*) AS crashes, "
    f"COUNT(DISTINCT ip_hash) AS unique_users FROM crash_reports WHERE {W7} GROUP BY 1"))
def _q03(spark, d):
    return P.hourly_trend(_t(spark, d), as_of=AS_OF, days=7)


@register("q04_version_health", q(
    "SELECT app_name, app_version, COUNT(*) AS crashes, COUNT(DISTINCT ip_hash) AS affected_users, "
    f"{ratio('COUNT(*)', 'COUNT(DISTINCT ip_hash)', 2)} AS crashes_per_user "
    "FROM crash_reports GROUP BY app_name, app_version"))
def _q04(spark, d):
    return P.version_health(_t(spark, d))


@register("q05_version_compare", q(
    "SELECT app_version, COUNT(*) AS total_crashes, COUNT(DISTINCT ip_hash) AS unique_users, "
    "CAST(MIN(created_at) AS DATE) AS version_first_seen "
    f"FROM crash_reports WHERE app_name = '{APP}' GROUP BY app_version"))
def _q05(spark, d):
    return P.version_compare(_t(spark, d), APP)


@register("q06_platform_share", q(
    "SELECT platform, COUNT(*) AS crashes, COUNT(DISTINCT ip_hash) AS unique_users, "
    f"{ratio('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 2, 100)} AS percentage "
    "FROM crash_reports GROUP BY platform"))
def _q06(spark, d):
    return P.platform_share(_t(spark, d))


@register("q07_platform_daily", q(
    "SELECT platform, CAST(created_at AS DATE) AS date, COUNT(*) AS daily_crashes "
    f"FROM crash_reports WHERE created_at > {ts(days=30)} GROUP BY 1, 2"))
def _q07(spark, d):
    return P.platform_daily(_t(spark, d), as_of=AS_OF, days=30)


_Q08 = q(
    "SELECT LEFT(error_message, 100) AS error_preview, COUNT(*) AS frequency, "
    f"COUNT(DISTINCT ip_hash) AS affected_users, {joined('app_name')} AS affected_apps "
    "FROM crash_reports WHERE error_message IS NOT NULL GROUP BY 1 "
    "ORDER BY frequency DESC, error_preview LIMIT 20")


@register("q08_top_errors", _Q08)
def _q08(spark, d):
    return P.top_errors(_t(spark, d), n=20, width=100)


@register("q09_errors_for_app", q(
    "SELECT app_name, LEFT(error_message, 80) AS error_type, COUNT(*) AS occurrences "
    f"FROM crash_reports WHERE app_name = '{APP}' AND error_message IS NOT NULL GROUP BY 1, 2"))
def _q09(spark, d):
    return P.errors_for_app(_t(spark, d), APP, width=80)


# ------------------------------------------------------------ hardware ----


@register("q10_by_os", q(
    f"SELECT {SYS} AS operating_system, COUNT(*) AS crashes, COUNT(DISTINCT ip_hash) AS unique_users "
    f"FROM crash_reports WHERE {SYS} IS NOT NULL GROUP BY 1"))
def _q10(spark, d):
    return P.by_os(_t(spark, d))


@register("q11_by_memory_class", q(
    f"SELECT {tier(MEM, *MEMORY_TIERS_4)} AS memory_category, COUNT(*) AS crashes, "
    "COUNT(DISTINCT ip_hash) AS users FROM crash_reports "
    "WHERE (hw->'memory'->>'total') IS NOT NULL GROUP BY 1"))
def _q11(spark, d):
    return P.by_memory_class(_t(spark, d))


@register("q12_by_cpu_cores", q(
    f"SELECT {CORES} AS cpu_cores, COUNT(*) AS crashes, COUNT(DISTINCT ip_hash) AS users "
    "FROM crash_reports WHERE (hw->'cpu'->>'cores') IS NOT NULL GROUP BY 1"))
def _q12(spark, d):
    return P.by_cpu_cores(_t(spark, d))


_GPU_BASE = (f"SELECT {GPU} AS gpu_name, COUNT(*) AS crashes_7d, COUNT(DISTINCT ip_hash) AS unique_users_7d, "
             "COUNT(DISTINCT app_name) AS affected_apps{extra} FROM crash_reports "
             f"WHERE {W7} AND {GPU} IS NOT NULL GROUP BY 1")


@register("q13_by_gpu", q(_GPU_BASE.format(
    extra=f", {avg_gb(num('gpu.memory'))} AS avg_gpu_memory_gb")))
def _q13(spark, d):
    return P.by_gpu(_t(spark, d), as_of=AS_OF)


@register("q14_by_cpu_model", q(
    f"SELECT {CPU} AS cpu_model, {CORES} AS cores, {num('cpu.freq', 'INTEGER')} AS frequency_mhz, "
    "COUNT(*) AS crashes_7d, COUNT(DISTINCT ip_hash) AS unique_users_7d, "
    f"{joined('app_name')} AS affected_apps FROM crash_reports "
    f"WHERE {W7} AND {CPU} IS NOT NULL GROUP BY 1, 2, 3"))
def _q14(spark, d):
    return P.by_cpu_model(_t(spark, d), as_of=AS_OF)


_MEM_BASE = (f"SELECT {tier(MEM, *MEMORY_TIERS_5)} AS memory_range, COUNT(*) AS crashes_7d, "
             "COUNT(DISTINCT ip_hash) AS unique_users_7d{extra} FROM crash_reports "
             f"WHERE {W7} AND (hw->'memory'->>'total') IS NOT NULL GROUP BY 1")


@register("q15_by_memory_range", q(_MEM_BASE.format(
    extra=f", {avg_gb(MEM)} AS avg_memory_gb, {avg_gb(num('memory.available'))} AS avg_available_gb")))
def _q15(spark, d):
    return P.by_memory_range(_t(spark, d), as_of=AS_OF)


@register("q16_by_os_version", q(
    f"SELECT {SYS} AS os, hw->'platform'->>'version' AS os_version, "
    "(hw->'platform'->>'release') AS os_release, COUNT(*) AS crashes_7d, "
    "COUNT(DISTINCT ip_hash) AS unique_users_7d, COUNT(DISTINCT app_name) AS affected_apps "
    f"FROM crash_reports WHERE {W7} AND {SYS} IS NOT NULL GROUP BY 1, 2, 3"))
def _q16(spark, d):
    return P.by_os_version(_t(spark, d), as_of=AS_OF)


def _combos(fallback: str, strict: bool) -> str:
    extra = (" AND (hw->'cpu'->>'cores') IS NOT NULL AND (hw->'memory'->>'total') IS NOT NULL"
             if strict else "")
    return q(
        f"SELECT {SYS} AS os, {CORES} AS cpu_cores, {tier(MEM, *MEMORY_TIERS_3)} AS memory_tier, "
        f"COALESCE({GPU}, '{fallback}') AS gpu_type, COUNT(*) AS crashes_7d, "
        "COUNT(DISTINCT ip_hash) AS unique_users_7d FROM crash_reports "
        f"WHERE {W7} AND {SYS} IS NOT NULL{extra} GROUP BY 1, 2, 3, 4 HAVING COUNT(*) > 1")


@register("q17_hardware_combos", _combos("Integrated/Unknown", True))
def _q17(spark, d):
    return P.hardware_combos(_t(spark, d), as_of=AS_OF, more_than=1, strict=True)


@register("q18_hardware_daily", q(
    f"SELECT CAST(created_at AS DATE) AS crash_date, {SYS} AS os, COUNT(*) AS daily_crashes, "
    f"COUNT(DISTINCT ip_hash) AS daily_users, COUNT(DISTINCT {GPU}) AS unique_gpus, "
    f"COUNT(DISTINCT {CPU}) AS unique_cpus FROM crash_reports "
    f"WHERE {W7} AND {SYS} IS NOT NULL GROUP BY 1, 2"))
def _q18(spark, d):
    return P.hardware_daily(_t(spark, d), as_of=AS_OF)


_LOW = (f"SELECT app_name, COUNT(*) AS crashes_7d, COUNT(DISTINCT ip_hash) AS affected_users, "
        f"AVG({CORES}) AS avg_cpu_cores, {avg_gb(MEM)} AS avg_memory_gb{{extra}} "
        f"FROM crash_reports WHERE {W7} AND ({CORES} <= 4 OR {MEM} < 8000000000) GROUP BY app_name")


@register("q19_low_resource", q(_LOW.format(
    extra=", array_to_string(list_sort(list(DISTINCT LEFT(error_message, 50)) "
          "FILTER (WHERE error_message IS NOT NULL)), ',') AS common_errors")))
def _q19(spark, d):
    return P.low_resource(_t(spark, d), as_of=AS_OF)


@register("q20_high_end", q(
    "SELECT app_name, COUNT(*) AS crashes_7d, COUNT(DISTINCT ip_hash) AS affected_users, "
    f"AVG({CORES}) AS avg_cpu_cores, {avg_gb(MEM)} AS avg_memory_gb, "
    f"COUNT(DISTINCT {GPU}) AS unique_gpus FROM crash_reports "
    f"WHERE {W7} AND {CORES} >= 12 AND {MEM} >= 32000000000 GROUP BY app_name HAVING COUNT(*) > 2"))
def _q20(spark, d):
    return P.high_end(_t(spark, d), as_of=AS_OF)


# ------------------------------------------------------ time and users ----


@register("q21_by_day_of_week", q(
    "SELECT dayname(created_at) AS day_of_week, COUNT(*) AS crashes FROM crash_reports "
    "GROUP BY dayname(created_at), dayofweek(created_at)"))
def _q21(spark, d):
    return P.by_day_of_week(_t(spark, d))


@register("q22_by_hour_of_day", q(
    "SELECT CAST(EXTRACT(hour FROM created_at) AS INTEGER) AS hour, COUNT(*) AS crashes, "
    "COUNT(DISTINCT ip_hash) AS unique_users FROM crash_reports GROUP BY 1"))
def _q22(spark, d):
    return P.by_hour_of_day(_t(spark, d))


@register("q23_repeat_users", q(
    "SELECT ip_hash, COUNT(*) AS crash_count, COUNT(DISTINCT app_name) AS apps_affected, "
    f"{joined('app_name')} AS app_list, MIN(created_at) AS first_crash, "
    "MAX(created_at) AS latest_crash FROM crash_reports GROUP BY ip_hash HAVING COUNT(*) > 5"))
def _q23(spark, d):
    return P.repeat_users(_t(spark, d), more_than=5)


@register("q24_session_crashes", q(
    "SELECT session_id, COUNT(*) AS crashes_in_session, app_name, user_id, "
    "(epoch_us(MAX(created_at)) - epoch_us(MIN(created_at))) / 1e6 AS session_seconds "
    "FROM crash_reports WHERE session_id IS NOT NULL "
    "GROUP BY session_id, app_name, user_id HAVING COUNT(*) > 1"))
def _q24(spark, d):
    return P.session_crashes(_t(spark, d), more_than=1)


# -------------------------------------------------------------- rollup ----


@register("q25_dashboard", q(
    f"SELECT * FROM crash_analytics WHERE hour > {ts(hours=24)}", rollup=True))
def _q25(spark, d):
    return P.dashboard(_t(spark, d), as_of=AS_OF, hours=24)


@register("q26_top_apps", q(
    "SELECT app_name, CAST(SUM(crash_count) AS BIGINT) AS total_crashes, "
    "CAST(SUM(unique_users) AS BIGINT) AS total_users FROM crash_analytics "
    f"WHERE hour > {ts(days=7)} GROUP BY app_name", rollup=True))
def _q26(spark, d):
    return P.top_apps(_t(spark, d), as_of=AS_OF, days=7)


@register("q27_platform_rates", q(
    "SELECT platform, AVG(crash_count) AS avg_crashes_per_hour, "
    "MAX(crash_count) AS peak_crashes_per_hour FROM crash_analytics "
    f"WHERE hour > {ts(days=30)} GROUP BY platform", rollup=True))
def _q27(spark, d):
    return P.platform_rates(_t(spark, d), as_of=AS_OF, days=30)


@register("q28_spikes", q(rollup=True, body=f"""
SELECT app_name, crash_count AS recent_crashes, {ratio('total', 'cells', 6)} AS avg_crashes,
       ROUND((crash_count - mean) / NULLIF(deviation, 0), 2) AS z_score
FROM (
  SELECT app_name, hour, crash_count, SUM(past) OVER app AS total, COUNT(past) OVER app AS cells,
         AVG(past) OVER app AS mean, STDDEV_SAMP(past) OVER app AS deviation
  FROM (SELECT *, CASE WHEN hour < {ts(hours=1)} THEN crash_count END AS past FROM crash_analytics WHERE hour > {ts(days=7)})
  WINDOW app AS (PARTITION BY app_name))
WHERE hour = date_trunc('hour', {ts(hours=1)}) AND crash_count > mean + 2 * deviation"""))
def _q28(spark, d):
    return P.spikes(_t(spark, d), as_of=AS_OF, k=2.0)


_Q29 = q(f"""
SELECT LEFT(error_message, 100) AS new_error, COUNT(*) AS occurrences FROM crash_reports
WHERE error_message IS NOT NULL AND created_at >= {ts(days=30)}
GROUP BY 1 HAVING MIN(created_at) > {ts(hours=24)}""")


@register("q29_new_errors", _Q29)
def _q29(spark, d):
    return P.new_errors(_t(spark, d), as_of=AS_OF)


@register("q29_new_errors_anti_join", _Q29)
def _q29b(spark, d):
    return P.new_errors(_t(spark, d), as_of=AS_OF, method="anti_join")


# ----------------------------------------------------- README variants ----


@register("r01_recent_by_app_7d", q(
    f"SELECT app_name, COUNT(*) AS crashes FROM crash_reports WHERE {W7} GROUP BY app_name"))
def _r01(spark, d):
    return P.recent_by_app(_t(spark, d), as_of=AS_OF, days=7, hours=0, name="crashes")


@register("r02_dashboard", q(
    f"SELECT * FROM crash_analytics WHERE hour > {ts(hours=24)}", rollup=True))
def _r02(spark, d):
    return P.dashboard(_t(spark, d), as_of=AS_OF, hours=24)


@register("r03_top_apps_crashes", q(
    "SELECT app_name, CAST(SUM(crash_count) AS BIGINT) AS total_crashes FROM crash_analytics "
    f"WHERE hour > {ts(days=7)} GROUP BY app_name", rollup=True))
def _r03(spark, d):
    return P.top_apps(_t(spark, d), as_of=AS_OF, days=7, with_users=False)


@register("r04_by_gpu", q(_GPU_BASE.format(extra="")))
def _r04(spark, d):
    return P.by_gpu(_t(spark, d), as_of=AS_OF, with_memory=False)


@register("r05_by_memory_range", q(_MEM_BASE.format(extra="")))
def _r05(spark, d):
    return P.by_memory_range(_t(spark, d), as_of=AS_OF, with_averages=False)


@register("r06_by_cpu_model", q(
    f"SELECT {CPU} AS cpu_model, {CORES} AS cores, COUNT(*) AS crashes_7d, "
    "COUNT(DISTINCT ip_hash) AS unique_users_7d FROM crash_reports "
    f"WHERE {W7} AND {CPU} IS NOT NULL GROUP BY 1, 2"))
def _r06(spark, d):
    return P.by_cpu_model(_t(spark, d), as_of=AS_OF, detailed=False)


@register("r07_low_resource", q(_LOW.format(extra="")))
def _r07(spark, d):
    return P.low_resource(_t(spark, d), as_of=AS_OF, with_errors=False)


@register("r08_hardware_combos_loose", _combos("Integrated", False))
def _r08(spark, d):
    return P.hardware_combos(_t(spark, d), as_of=AS_OF, more_than=1, strict=False)


@register("r09_top_errors", _Q08)
def _r09(spark, d):
    return P.top_errors(_t(spark, d), n=20, width=100)


@register("r10_version_ratio", q(
    "SELECT app_version, COUNT(*) AS total_crashes, COUNT(DISTINCT ip_hash) AS unique_users, "
    f"{ratio('COUNT(*)', 'COUNT(DISTINCT ip_hash)', 2)} AS crashes_per_user "
    f"FROM crash_reports WHERE app_name = '{APP}' GROUP BY app_version"))
def _r10(spark, d):
    return P.version_ratio(_t(spark, d), APP)


# -------------------------------------------------------------- reader ----


@register("c1_read_page", q(
    f"SELECT {COLS} FROM crash_reports WHERE app_name = '{APP}' AND created_at > {ts(days=30)} "
    "ORDER BY created_at DESC, id LIMIT 25 OFFSET 10"))
def _c1(spark, d):
    return P.read_page(_t(spark, d), app=APP, as_of=AS_OF, days=30, limit=25, offset=10)


_STATS = q(ctes=f"""
src AS (
  SELECT * FROM crash_reports WHERE app_name = '{APP}' AND created_at > {ts(days=30)}),
freq AS (
  SELECT 'platform' AS dimension, COALESCE(NULLIF(platform, ''), 'unknown') AS value, COUNT(*) AS n FROM src GROUP BY 2
  UNION ALL
  SELECT 'version', COALESCE(NULLIF(app_version, ''), 'unknown'), COUNT(*) FROM src GROUP BY 2
  UNION ALL
  SELECT 'error', COALESCE(NULLIF(error_message, ''), 'unknown'), COUNT(*) FROM src GROUP BY 2)""", body=f"""
SELECT 'total_crashes' AS dimension, CAST(NULL AS VARCHAR) AS value, COUNT(*) AS n FROM src
UNION ALL SELECT 'unique_users', NULL, COUNT(DISTINCT NULLIF(user_id, '')) FROM src
UNION ALL SELECT 'unique_sessions', NULL, COUNT(DISTINCT NULLIF(session_id, '')) FROM src
UNION ALL SELECT 'last_24h', NULL, COUNT(*) FILTER (WHERE crash_timestamp >= {ts(days=1)}) FROM src
UNION ALL SELECT 'last_7d', NULL, COUNT(*) FILTER (WHERE crash_timestamp >= {ts(days=7)}) FROM src
UNION ALL SELECT 'last_30d', NULL, COUNT(*) FILTER (WHERE crash_timestamp >= {ts(days=30)}) FROM src
UNION ALL SELECT dimension, value, n FROM freq WHERE dimension <> 'error'
UNION ALL SELECT dimension, value, n FROM (
  SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rk FROM freq WHERE dimension = 'error')
  WHERE rk <= 10""")


@register("c2_crash_stats", _STATS)
def _c2(spark, d):
    return P.crash_stats(_t(spark, d), as_of=AS_OF, app=APP, days=30, top=10)


@register("c3_recent_crashes", q(
    f"SELECT {COLS} FROM crash_reports WHERE app_name = '{APP}' AND created_at > {ts(hours=24)}"))
def _c3(spark, d):
    return P.recent_crashes(_t(spark, d), as_of=AS_OF, app=APP, hours=24)


@register("c4_crashes_by_error", q(
    f"SELECT {COLS} FROM crash_reports WHERE app_name = '{APP}' AND created_at > {ts(days=30)} "
    f"AND contains(lower(error_message), lower('{SEARCH}'))"))
def _c4(spark, d):
    return P.crashes_by_error(_t(spark, d), SEARCH, as_of=AS_OF, app=APP, days=30)


def queries() -> dict[str, Query]:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -------------------------------------------------- ingest and cleaning ----
# Raw signed envelopes are derived from the same events (sources.fixture);
# the oracle recomputes every admission decision from the table columns.


BURST_LIMIT = 2  # per client and minute; the fixture peaks at 7

_ADMIT_CTE = f"""
env AS (
  SELECT *, row_number() OVER (PARTITION BY client_ip, date_trunc('minute', created_at)
                               ORDER BY created_at, CAST(id AS VARCHAR)) AS rk,
         date_trunc('milliseconds', crash_timestamp) AS crash_ms,
         date_trunc('milliseconds', created_at) AS now_ms
  FROM crash_reports),
decided AS (
  SELECT *,
    CASE WHEN rk > {BURST_LIMIT} THEN 429
         WHEN crash_ms > now_ms OR now_ms - crash_ms > INTERVAL 24 HOUR THEN 400
         ELSE 200 END AS status,
    CASE WHEN rk > {BURST_LIMIT} THEN 'rate_limited'
         WHEN crash_ms > now_ms OR now_ms - crash_ms > INTERVAL 24 HOUR THEN 'invalid_crash_data'
         ELSE 'accepted' END AS reason
  FROM env)"""


def _admitted(spark, d):
    raw = raw_envelopes(spark, d)
    return admit(raw, secret=FIXTURE_SECRET, limit_per_minute=BURST_LIMIT)


@register("ingest_status", q(ctes=_ADMIT_CTE, body=
    "SELECT status, reason, COUNT(*) AS n FROM decided GROUP BY status, reason"))
def _ingest_status(spark, d):
    """G1-G4, V1-V12, C1-C6 over signed envelopes: rows per outcome."""
    return (_admitted(spark, d).groupBy("status", "reason")
            .agg(F.count(F.lit(1)).alias("n")).orderBy("status", "reason"))


@register("ingest_accepted", q(ctes=_ADMIT_CTE, body=f"""
SELECT CAST(id AS VARCHAR) AS id, app_name, app_version, crash_ms AS crash_timestamp, platform,
       error_message, stack_trace, user_id, session_id, created_at, ip_hash,
       {CORES} AS cpu_cores, {MEM} AS memory_total, {GPU} AS gpu_name
FROM decided WHERE status = 200"""))
def _ingest_accepted(spark, d):
    """Accepted, sanitised rows as they would be stored (S5 input)."""
    acc, _ = split(_admitted(spark, d))
    return acc.select(
        "id", "app_name", "app_version",
        F.col("crash_timestamp").cast("timestamp_ntz").alias("crash_timestamp"),
        "platform", "error_message", "stack_trace", "user_id", "session_id",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"), "ip_hash",
        F.col("hw.cpu.cores").try_cast("int").alias("cpu_cores"),
        F.col("hw.memory.total").try_cast("bigint").alias("memory_total"),
        F.col("hw.gpu.name").alias("gpu_name"))


@register("ingest_quarantine", q(ctes=_ADMIT_CTE, body=
    "SELECT CAST(id AS VARCHAR) AS request_id, client_ip, status, reason FROM decided WHERE status <> 200"))
def _ingest_quarantine(spark, d):
    """Refused envelopes with their status (quarantine table)."""
    _, quarantine = split(_admitted(spark, d))
    return quarantine.select("request_id", "client_ip", "status", "reason")


def _sql_sanitize(col: str) -> str:
    removed = REMOVED_CHARS.replace("\\\\", "\\")
    return (f"substring(trim(regexp_replace({col}, '{removed}', '', 'g'), "
            f"'{TRIM_CHARS}'), 1, 10000)")


@register("sanitize_documents", "SELECT doc_id, length(c) AS clean_chars, md5(c) AS clean_md5 "
          f"FROM (SELECT doc_id, {_sql_sanitize('text')} AS c FROM documents)")
def _sanitize_documents(spark, d):
    """Z1-Z4 over every document text (whole texts, real dirty input)."""
    docs = read_table(spark, d, "documents")
    c = sanitize(F.col("text"))
    return docs.select("doc_id", F.length(c).cast("bigint").alias("clean_chars"),
                       F.md5(c).alias("clean_md5"))


@register("sanitize_pages", "SELECT page_id, length(c) AS clean_chars, md5(c) AS clean_md5 "
          f"FROM (SELECT page_id, {_sql_sanitize('html')} AS c FROM pages)")
def _sanitize_pages(spark, d):
    """Z1-Z4 over every raw web page."""
    pages = read_table(spark, d, "pages")
    c = sanitize(F.col("html"))
    return pages.select("page_id", F.length(c).cast("bigint").alias("clean_chars"),
                        F.md5(c).alias("clean_md5"))


@register("crash_analytics_rollup", q("SELECT * FROM crash_analytics", rollup=True))
def _rollup(spark, d):
    """S3: the full hourly rollup."""
    return hourly_rollup(_t(spark, d))


_REPLAY_CTE = """
fb AS (
  SELECT id, app_name, app_version, crash_timestamp, error_message, stack_trace,
         created_at + INTERVAL 6 HOUR AS arrived,
         date_trunc('milliseconds', crash_timestamp) AS crash_ms,
         date_trunc('milliseconds', created_at + INTERVAL 6 HOUR) AS now_ms
  FROM crash_reports)"""


@register("replay_fallback", q(ctes=_REPLAY_CTE, body="""
SELECT CASE WHEN crash_ms > now_ms OR now_ms - crash_ms > INTERVAL 48 HOUR THEN 400 ELSE 200 END AS status,
       COUNT(*) AS n
FROM fb GROUP BY 1"""))
def _replay(spark, d):
    """Locally stored fallback records (no platform, hardware or
    signature) replayed six hours late with a 48-hour age bound."""
    rows = _t(spark, d)
    fallback = rows.select(
        F.col("id").alias("request_id"),
        F.concat(F.date_format("crash_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                 F.lit("Z")).alias("timestamp"),
        F.col("error_message").alias("error"), F.col("stack_trace").alias("stack"),
        "app_name", "app_version",
        F.to_timestamp(F.concat(F.date_format(
            F.col("created_at") + F.expr("INTERVAL 6 HOURS"),
            "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).alias("arrived_at"))
    raw = replay_fallback(fallback, platform="linux")
    adm = admit(raw, secret=None, check_signature=False, limit_per_minute=None,
                max_age_hours=48)
    return adm.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------- streaming ----
# The envelopes' landing folder is the stream source; a Structured Streaming
# run (availableNow, fresh checkpoint and output folders under the session's
# shared checkpoint dir) admits and rolls them up, and the query returns what
# the stream wrote; the oracle is the batch SQL, so these keys check
# batch = stream.


def _stream_run(spark, d, limiter="ledger"):
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    landing = landing_zone(spark, d)
    q1 = start_ingest(read_report_stream(spark, landing), f"{root}/tables",
                      f"{root}/ck-ingest", secret=FIXTURE_SECRET, limit_per_minute=BURST_LIMIT,
                      limiter=limiter)
    q1.awaitTermination()
    accepted, quarantine = read_ingested(spark, f"{root}/tables")
    return root, accepted, quarantine


@register("stream_ingest_status", q(ctes=_ADMIT_CTE, body=
    "SELECT status, reason, COUNT(*) AS n FROM decided GROUP BY status, reason"))
def _stream_ingest_status(spark, d):
    """X1-X3 + X6: streaming admission, ledger limiter per micro-batch."""
    return _stream_status(*_stream_run(spark, d)[1:])


def _stream_status(accepted, quarantine):
    counts = quarantine.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))
    ok = accepted.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(200).alias("status"), F.lit("accepted").alias("reason"), "n")
    return counts.unionByName(ok).where(F.col("n") > 0)


@register("stream_ingest_status_state_limiter", q(ctes=_ADMIT_CTE, body=
    "SELECT status, reason, COUNT(*) AS n FROM decided GROUP BY status, reason"))
def _stream_ingest_status_state(spark, d):
    """X6 as streaming state: the applyInPandasWithState limiter inside the stream."""
    return _stream_status(*_stream_run(spark, d, limiter="state")[1:])


@register("stream_hourly_rollup", q(ctes=_ADMIT_CTE, body="""
SELECT app_name, app_version, platform, date_trunc('hour', created_at) AS hour,
       COUNT(*) AS crash_count, COUNT(*) AS unique_users
FROM decided WHERE status = 200 GROUP BY 1, 2, 3, 4"""))
def _stream_hourly_rollup(spark, d):
    """Tumbling hourly rollup of the accepted stream (update mode)."""
    root, _, _ = _stream_run(spark, d)
    acc = spark.read.parquet(f"{root}/tables/crash_reports")
    stream = spark.readStream.schema(acc.schema).parquet(f"{root}/tables/crash_reports")
    q2 = start_rollup(hourly_rollup_stream(stream, watermark=None, sketch=False), f"{root}/rollup",
                      f"{root}/ck-rollup")
    q2.awaitTermination()
    return (read_rollup(spark, f"{root}/rollup")
            .withColumn("hour", F.col("hour").cast("timestamp_ntz")))


@register("stream_dedup_replays",
          "SELECT CAST(event_id AS VARCHAR) AS request_id FROM events")
def _stream_dedup(spark, d):
    """Every envelope arrives twice (a replayed fallback copy); the stream
    keeps one per request id within the 24-hour watermark."""
    replayed = materialized(spark, d, "landing-replayed",
                            lambda: raw_envelopes(spark, d).unionByName(raw_envelopes(spark, d)))
    root = f"{checkpoint_dir(spark).rstrip('/')}/dedup-{uuid.uuid4().hex}"
    q = (dedup_stream(read_report_stream(spark, replayed)).select("request_id")
         .writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema("request_id string").parquet(f"{root}/out")


@register("stream_spike_alerts", q(ctes=f"""
stats AS (
  SELECT app_name, AVG(crash_count) AS a, STDDEV_SAMP(crash_count) AS sd
  FROM crash_analytics WHERE hour > {ts(days=7)} GROUP BY app_name)""", rollup=True, body="""
SELECT c.app_name, c.app_version, c.platform, c.hour, c.crash_count AS recent_crashes,
       s.a AS avg_crashes, ROUND((c.crash_count - s.a) / NULLIF(s.sd, 0), 2) AS z_score
FROM crash_analytics c JOIN stats s ON c.app_name = s.app_name
WHERE c.crash_count > s.a + 2 * s.sd"""))
def _stream_spike_alerts(spark, d):
    """The fact table streamed through the hourly rollup; each micro-batch's
    cells are checked against the 7-day per-app baseline of the batch rollup."""
    facts = crash_table(spark, d)
    path = crash_table_path(spark, d)
    root = f"{checkpoint_dir(spark).rstrip('/')}/alerts-{uuid.uuid4().hex}"
    stream = (spark.readStream.schema(facts.schema).parquet(path)
              .withColumn("created_at", F.col("created_at").cast("timestamp")))
    callback = spike_alerts(hourly_rollup(facts), f"{root}/alerts", as_of=AS_OF, k=2.0)
    q1 = start_rollup(hourly_rollup_stream(stream, watermark=None, sketch=False), f"{root}/rollup",
                      f"{root}/ck", on_batch=callback)
    q1.awaitTermination()
    alerts = spark.read.parquet(f"{root}/alerts")
    key = ["app_name", "app_version", "platform", "hour"]
    newest = Window.partitionBy(*key).orderBy(F.desc("batch_id"))
    return (alerts.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") == 1)
                  .select("app_name", "app_version", "platform",
                          F.col("hour").cast("timestamp_ntz").alias("hour"),
                          "recent_crashes", "avg_crashes", "z_score"))


@register("stream_rollup_partials", q(ctes=_ADMIT_CTE, body="""
SELECT app_name, app_version, platform, date_trunc('hour', created_at) AS hour,
       COUNT(*) AS crash_count, COUNT(*) AS unique_users
FROM decided WHERE status = 200 GROUP BY 1, 2, 3, 4"""))
def _stream_rollup_partials(spark, d):
    """X4 without a state store: the ingest stream writes each micro-batch's
    partial rollup cells, which one grouped sum turns into the rollup."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/partials-{uuid.uuid4().hex}"
    # one micro-batch: the landing files are not in arrival order, and the
    # limiter admits in stream order, which the batch oracle does not model
    q1 = start_ingest(read_report_stream(spark, landing_zone(spark, d)),
                      f"{root}/tables", f"{root}/ck", secret=FIXTURE_SECRET,
                      limit_per_minute=BURST_LIMIT, rollup_path=f"{root}/rollup")
    q1.awaitTermination()
    return (read_rollup_sums(spark, f"{root}/rollup")
            .withColumn("hour", F.col("hour").cast("timestamp_ntz")))


# further keys, over tables kept by batches and over dirty envelopes, register themselves with ``register``
from crashlens import catalog_dirty, catalog_tables  # noqa: E402, F401
