"""DuckDB formulations of the registered queries (the correctness oracle).

Each string runs on the driver's pre-registered parquet views.  The
``crash_reports`` CTE is the fixture derivation of ``sources.fixture`` in
SQL; shapes follow the Spark side (arrays as comma-joined text, intervals
as seconds, ratios rounded HALF_UP with integer arithmetic).
"""

from __future__ import annotations

import datetime as dt

from crashlens.schema import IP_SALT
from crashlens.sources.fixture import AS_OF, BURST_AT, LAST_DAY

_NOW = dt.datetime.fromisoformat(AS_OF)


def ts(days: float = 0, hours: float = 0, base: dt.datetime = _NOW) -> str:
    t = base - dt.timedelta(days=days, hours=hours)
    return f"TIMESTAMP '{t.strftime('%Y-%m-%d %H:%M:%S')}'"


CRASH_REPORTS = f"""
base AS (
  SELECT
    event_id AS id,
    concat('app-', CAST(user_id % 5 AS VARCHAR)) AS app_name,
    concat('v', CAST(1 + user_id % 2 AS VARCHAR), '.', CAST(event_id % 3 AS VARCHAR), '.0') AS app_version,
    ts AS crash_timestamp,
    CASE CAST(FLOOR(user_id / 5) AS BIGINT) % 5 WHEN 0 THEN 'windows' WHEN 1 THEN 'linux'
      WHEN 2 THEN 'macos' WHEN 3 THEN 'android' ELSE 'ios' END AS platform,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat(event_type, ' failed: code ', CAST(event_id % 17 AS VARCHAR),
      CASE WHEN ts >= TIMESTAMP '{LAST_DAY}' AND event_id % 7 = 0 THEN ' NEW' ELSE '' END) END AS error_message,
    CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('at ', event_type, ' (main.js:', CAST(event_id % 97 AS VARCHAR), ')') END AS stack_trace,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat(
      '{{"cpu":{{"name":"cpu-', CAST(user_id % 7 AS VARCHAR), '","cores":', CAST((user_id % 8 + 1) * 2 AS VARCHAR),
      ',"freq":', CAST(2000 + 100 * (user_id % 9) AS VARCHAR),
      '}},"memory":{{"total":', CAST((user_id % 12) * 3000000000 + 2000000000 AS VARCHAR),
      ',"available":', CAST((user_id % 12) * 1000000000 + 500000000 AS VARCHAR),
      '}},"platform":{{"system":"os-', CAST(CAST(FLOOR(user_id / 5) AS BIGINT) % 5 AS VARCHAR),
      '","version":"', CAST(10 + user_id % 3 AS VARCHAR), '","release":"r', CAST(user_id % 4 AS VARCHAR), '"}}',
      CASE WHEN user_id % 4 = 0 THEN '' ELSE concat(',"gpu":{{"name":"gpu-', CAST(user_id % 6 AS VARCHAR),
        '","memory":', CAST((user_id % 6 + 1) * 2000000000 AS VARCHAR), '}}') END,
      '}}') END AS hardware_specs,
    CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('user-', CAST(user_id AS VARCHAR)) END AS user_id,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('s-', CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) END AS session_id,
    CASE WHEN ts >= TIMESTAMP '{LAST_DAY}' AND user_id % 5 = 3 THEN TIMESTAMP '{BURST_AT}' ELSE ts END AS created_at,
    concat('10.0.', CAST(CAST(FLOOR(user_id / 250) AS BIGINT) AS VARCHAR), '.', CAST(user_id % 250 AS VARCHAR)) AS client_ip
  FROM events
),
crash_reports AS (
  SELECT *, sha256(concat(client_ip, '{IP_SALT}')) AS ip_hash, CAST(hardware_specs AS JSON) AS hw
  FROM base
)"""

ROLLUP = """
crash_analytics AS (
  SELECT app_name, app_version, platform, date_trunc('hour', created_at) AS hour,
         COUNT(*) AS crash_count, COUNT(*) AS unique_users
  FROM crash_reports
  GROUP BY app_name, app_version, platform, date_trunc('hour', created_at)
)"""

SYS = "(hw->'platform'->>'system')"
CPU = "COALESCE(hw->'cpu'->>'name', hw->'cpu'->>'model')"
GPU = "(hw->'gpu'->>'name')"


def num(path: str, typ: str = "BIGINT") -> str:
    a, b = path.split(".")
    return f"CAST(TRUNC(CAST(hw->'{a}'->>'{b}' AS DOUBLE)) AS {typ})"


CORES = num("cpu.cores", "INTEGER")
MEM = num("memory.total")


def ratio(n: str, d: str, digits: int, scale: int = 1) -> str:
    p = 10 ** digits
    whole = f"((2 * {p * scale} * CAST({n} AS HUGEINT) + ({d})) // (2 * CAST({d} AS HUGEINT)))"
    # written out as decimal text, so that reading it as a double is the only rounding
    text = f"concat(CAST({whole} // {p} AS VARCHAR), '.', lpad(CAST({whole} % {p} AS VARCHAR), {max(digits, 1)}, '0'))"
    return f"(CASE WHEN ({d}) <> 0 THEN CAST({text} AS DOUBLE) END)"


def avg_gb(x: str) -> str:
    return ratio(f"SUM({x})", f"COUNT({x}) * CAST(1000000000 AS HUGEINT)", 1)


def tier(x: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {x} < {e} THEN '{lab}'" for e, lab in zip(edges, labels))
    return f"CASE {parts} ELSE '{labels[-1]}' END"


def joined(x: str) -> str:
    return f"array_to_string(list_sort(list(DISTINCT {x})), ',')"


def q(body: str, rollup: bool = False, ctes: str = "") -> str:
    """``WITH crash_reports [, crash_analytics] [, ctes] body``."""
    parts = [CRASH_REPORTS] + ([ROLLUP] if rollup else []) + ([ctes] if ctes else [])
    return "WITH " + ",".join(parts) + "\n" + body
