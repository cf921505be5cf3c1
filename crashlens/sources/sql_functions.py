"""Analytics as SQL table functions over the two views.

After ``register_views`` a SQL user calls, say,
``SELECT * FROM hourly_trend(TIMESTAMP_NTZ '2024-01-30 23:30:00', 7)``.  Arguments that are literals are
folded into the scan: they push the arrival bound to Parquet and prune ``created_date`` partitions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, columns, body).  Look-backs compare ``created_at`` like ``functions.time.lookback``.
_SINCE = "created_at > as_of - make_dt_interval(days) AND created_date >= CAST(as_of - make_dt_interval(days) AS DATE)"
FUNCTIONS = {
    "recent_by_app": (
        "as_of TIMESTAMP_NTZ, days INT", "app_name STRING, crashes BIGINT",
        f"SELECT app_name, count(*) FROM crash_reports WHERE {_SINCE} GROUP BY app_name"),
    "hourly_trend": (
        "as_of TIMESTAMP_NTZ, days INT", "hour TIMESTAMP_NTZ, crashes BIGINT, unique_users BIGINT",
        "SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP_NTZ), count(*), count(DISTINCT ip_hash) "
        f"FROM crash_reports WHERE {_SINCE} GROUP BY 1"),
    "platform_daily": (
        "as_of TIMESTAMP_NTZ, days INT", "platform STRING, date DATE, daily_crashes BIGINT",
        f"SELECT platform, CAST(created_at AS DATE), count(*) FROM crash_reports WHERE {_SINCE} GROUP BY 1, 2"),
    "errors_for_app": (
        "app STRING, width INT", "app_name STRING, error_type STRING, occurrences BIGINT",
        "SELECT app_name, left(error_message, width), count(*) FROM crash_reports "
        "WHERE app_name = app AND error_message IS NOT NULL GROUP BY 1, 2"),
    "top_apps": (
        "as_of TIMESTAMP_NTZ, days INT", "app_name STRING, total_crashes BIGINT, total_users BIGINT",
        "SELECT app_name, sum(crash_count), sum(unique_users) FROM crash_analytics "
        "WHERE hour > as_of - make_dt_interval(days) GROUP BY app_name"),
    "platform_rates": (
        "as_of TIMESTAMP_NTZ, days INT", "platform STRING, avg_crashes_per_hour DOUBLE, peak_crashes_per_hour BIGINT",
        "SELECT platform, avg(crash_count), max(crash_count) FROM crash_analytics "
        "WHERE hour > as_of - make_dt_interval(days) GROUP BY platform"),
    "repeat_users": (
        "more_than INT", "ip_hash STRING, crash_count BIGINT, apps_affected BIGINT, app_list ARRAY<STRING>, "
        "first_crash TIMESTAMP_NTZ, latest_crash TIMESTAMP_NTZ",
        "SELECT ip_hash, count(*), count(DISTINCT app_name), array_sort(collect_set(app_name)), min(created_at), max(created_at) "
        "FROM crash_reports GROUP BY ip_hash HAVING count(*) > more_than"),
}


def register_functions(spark: SparkSession) -> None:
    """Create the session's table functions; ``register_views`` must have made ``crash_reports`` (stored layout,
    with ``created_date``) and ``crash_analytics``."""
    for name, (parameters, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
