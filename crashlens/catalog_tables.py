"""Registered queries over stored tables that batches keep up to date: user bitmaps, error sketches, the hourly
rollup, and the rollup of a stream of several micro-batches.

Most keys return the rows of an analytics key from derived tables instead of the fact table, so they have
that key's DuckDB formulation.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens import plans as P
from crashlens.catalog import APP, COLS, _SQL, _stream_run, _stream_status, register
from crashlens.operators import read_rollup_table, refresh_rollup
from crashlens.operators.error_days import advance_error_days, build_error_days, new_errors_of_day
from crashlens.operators.error_sketch import read_error_sketches, top_errors_from_sketches, update_error_sketches
from crashlens.operators.moments import hour_moments, spikes_by_hour, trailing_baseline
from crashlens.operators.user_cube import UserCube, update_user_cube
from crashlens.oracle import q, ratio, ts
from crashlens.plans import from_cube as C
from crashlens.plans.paging import page_at, refresh_page_index
from crashlens.session import checkpoint_dir
from crashlens.sources.fixture import AS_OF, crash_table, derived_root
from crashlens.sources.reports import register_views
from crashlens.sources.sql_functions import register_functions
from crashlens.streaming import use_rocksdb
from crashlens.streaming.late import hourly_alerts, read_exact_rollup, start_exact_rollup, users_by

_BUILT: dict[tuple, object] = {}


def cube(spark: SparkSession, sf_dir: str) -> UserCube:
    """The fixture's user cube, built once a session in two batches: the dates up to the 20th, then the rest."""
    root = derived_root(spark, sf_dir, "user-cube")
    if root not in _BUILT:
        facts = crash_table(spark, sf_dir)
        dates = [str(r[0]) for r in facts.select("created_date").distinct().orderBy("created_date").collect()]  # one row a date
        for part in ([d for d in dates if d <= "2024-01-20"], [d for d in dates if d > "2024-01-20"]):
            if part:
                update_user_cube(facts, root, part)
        _BUILT[root] = UserCube(spark, root)
    return _BUILT[root]


def _from_cube(key: str, make) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(cube(spark, sf_dir))
    run.__doc__ = f"Rows of ``{key}`` from daily user bitmaps."
    register(f"cube_{key}", _SQL[key])(run)


_from_cube("q03_hourly_trend", lambda c: C.hourly_trend(c, as_of=AS_OF, days=7))
_from_cube("q04_version_health", C.version_health)
_from_cube("q10_by_os", C.by_os)
_from_cube("q11_by_memory_class", C.by_memory_class)
_from_cube("q12_by_cpu_cores", C.by_cpu_cores)
_from_cube("q13_by_gpu", lambda c: C.by_gpu(c, as_of=AS_OF))
_from_cube("q14_by_cpu_model", lambda c: C.by_cpu_model(c, as_of=AS_OF))
_from_cube("q15_by_memory_range", lambda c: C.by_memory_range(c, as_of=AS_OF))
_from_cube("q16_by_os_version", lambda c: C.by_os_version(c, as_of=AS_OF))
_from_cube("q17_hardware_combos", lambda c: C.hardware_combos(c, as_of=AS_OF, more_than=1, strict=True))
_from_cube("q18_hardware_daily", lambda c: C.hardware_daily(c, as_of=AS_OF))
_from_cube("r08_hardware_combos_loose", lambda c: C.hardware_combos(c, as_of=AS_OF, more_than=1, strict=False))
_from_cube("r10_version_ratio", lambda c: C.version_ratio(c, APP))


# ------------------------------------------------------------ top errors ----


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = derived_root(spark, sf_dir, "error-sketches")
    if root not in _BUILT:
        update_error_sketches(crash_table(spark, sf_dir), root)
        _BUILT[root] = root
    return read_error_sketches(spark, root)


@register("sketch_q08_top_errors", _SQL["q08_top_errors"])
def _sketch_q08(spark, d):
    """Q08 from daily frequent-items sketches, candidates counted exactly."""
    return top_errors_from_sketches(crash_table(spark, d), _sketches(spark, d), n=20, width=100).rows


# --------------------------------------------------------- stored rollup ----


def _rollup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hourly rollup, refreshed date by date as batches arrive (here in two batches)."""
    root = derived_root(spark, sf_dir, "rollup")
    if root not in _BUILT:
        facts = crash_table(spark, sf_dir)
        dates = [r[0] for r in facts.select("created_date").distinct().collect()]  # one row a date
        for part in ([x for x in dates if x.day <= 20], [x for x in dates if x.day > 20]):
            if part:
                refresh_rollup(facts, root, part)
        _BUILT[root] = root
    return read_rollup_table(spark, root)


def _from_rollup(key: str, make) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(_rollup_table(spark, sf_dir))
    run.__doc__ = f"Rows of ``{key}`` from the stored rollup (no scan of the fact table)."
    register(f"rollup_{key}", _SQL[key])(run)


_from_rollup("q25_dashboard", lambda r: P.dashboard(r, as_of=AS_OF, hours=24).drop("hour_date"))
_from_rollup("q26_top_apps", lambda r: P.top_apps(r, as_of=AS_OF, days=7))
_from_rollup("q27_platform_rates", lambda r: P.platform_rates(r, as_of=AS_OF, days=30))
_from_rollup("q28_spikes", lambda r: P.spikes(r, as_of=AS_OF, k=2.0))
_from_rollup("r02_dashboard", lambda r: P.dashboard(r, as_of=AS_OF, hours=24).drop("hour_date"))
_from_rollup("r03_top_apps_crashes", lambda r: P.top_apps(r, as_of=AS_OF, days=7, with_users=False))


def _every_hour(upto: str) -> str:
    """Q28 asked at the end of every hour up to ``upto``, from per-hour sums."""
    return q(ctes=f"""
hours AS (
  SELECT app_name, hour, COUNT(*) AS n, SUM(crash_count) AS s, SUM(crash_count * crash_count) AS s2
  FROM crash_analytics GROUP BY app_name, hour),
window_sums AS (
  SELECT a.app_name, a.hour, SUM(b.n) AS n, SUM(b.s) AS s, SUM(b.s2)::DOUBLE AS s2
  FROM hours a JOIN hours b ON b.app_name = a.app_name AND b.hour < a.hour
    AND b.hour > a.hour + INTERVAL 1 HOUR - INTERVAL 7 DAY
  GROUP BY a.app_name, a.hour),
rated AS (
  SELECT app_name, hour, n, s, s::DOUBLE / n AS mean,
         CASE WHEN n > 1 THEN sqrt(greatest(n::DOUBLE * s2 - s::DOUBLE * s::DOUBLE, 0.0) / (n::DOUBLE * (n::DOUBLE - 1))) END AS sd
  FROM window_sums)""", rollup=True, body=f"""
SELECT c.app_name, c.app_version, c.platform, c.hour, c.crash_count AS recent_crashes, {ratio('r.s', 'r.n', 6)} AS avg_crashes,
       ROUND((c.crash_count - r.mean) / NULLIF(r.sd, 0), 2) AS z_score
FROM crash_analytics c JOIN rated r ON r.app_name = c.app_name AND r.hour = c.hour
WHERE c.crash_count > r.mean + 2 * r.sd AND c.hour <= {upto}""")


@register("spikes_every_hour", _every_hour("(SELECT MAX(hour) FROM crash_analytics)"))
def _spikes_every_hour(spark, d):
    """Q28 at the end of every hour, by prefix moments over the stored rollup."""
    cells = _rollup_table(spark, d).drop("hour_date")
    return spikes_by_hour(cells, trailing_baseline(hour_moments(cells)), k=2.0)


# --------------------------------------- streams of several micro-batches ----
# Four parts land one after the other, each in as many files as the tasks that write it, and a run of the stream takes
# what is new as one micro-batch.  In "late" order the oldest reports come last, so that they all are behind the
# watermark; in "arrival" order none is.


def _in_batches(spark: SparkSession, sf_dir: str, order: str) -> list[DataFrame]:
    """The fact rows in the four parts that a stream finds one by one."""
    facts = crash_table(spark, sf_dir).select("id", "app_name", "app_version", "platform", "ip_hash", "created_at")
    cuts = ["2024-01-08", "2024-01-16", "2024-01-24"]
    parts = [F.col("created_at") < cuts[0], *[(F.col("created_at") >= a) & (F.col("created_at") < b) for a, b in pairwise(cuts)],
             F.col("created_at") >= cuts[-1]]
    if order == "late":
        parts = [parts[1], parts[2], parts[3], parts[0]]
    return [facts.where(part) for part in parts]


def _exact_rollup(spark: SparkSession, sf_dir: str, order: str, alerts: bool = False) -> str:
    root = f"{checkpoint_dir(spark).rstrip('/')}/exact-rollup-{uuid.uuid4().hex}"
    for part in _in_batches(spark, sf_dir, order):
        part.write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(part.schema).parquet(f"{root}/landing")
        start_exact_rollup(stream, root, f"{root}/ck", on_close=hourly_alerts(root) if alerts else None).awaitTermination()
    return root


@register("stream_late_rows", q("SELECT * FROM crash_analytics", rollup=True))
def _stream_late_rows(spark, d):
    """X4 / S3 over four micro-batches, the oldest rows last: nothing is lost, closed hours stay closed."""
    return read_exact_rollup(spark, _exact_rollup(spark, d, "late")).drop("users_sketch")


@register("stream_daily_users", q(
    "SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS crashes, COUNT(DISTINCT ip_hash) AS users, TRUE AS within_error "
    "FROM crash_reports GROUP BY 1"))
def _stream_daily_users(spark, d):
    """Day-level users from the hourly cells' sketches of four micro-batches, held against the exact count:
    within three standard errors (5 %)."""
    rollup = read_exact_rollup(spark, _exact_rollup(spark, d, "late"))
    daily = users_by(rollup, F.to_date("hour").alias("day"))
    exact = crash_table(spark, d).groupBy(F.to_date("created_at").alias("day")).agg(F.count_distinct("ip_hash").alias("users"))
    near = F.abs(F.col("users_estimate") - F.col("users")) <= 0.05 * F.col("users")
    return daily.join(exact, "day").select("day", "crashes", "users", near.alias("within_error"))


@register("stream_hourly_spikes", _every_hour(
    "(SELECT date_trunc('hour', MAX(created_at) - INTERVAL 10 MINUTE) - INTERVAL 1 HOUR FROM crash_reports)"))
def _stream_hourly_spikes(spark, d):
    """X8 over four micro-batches: each hour is judged when it closes, by the rule of Q28 at that hour."""
    root = _exact_rollup(spark, d, "arrival", alerts=True)
    return spark.read.parquet(f"{root}/alerts").drop("batch_id")


@register("stream_ingest_status_minute_state", _SQL["stream_ingest_status"])
def _stream_ingest_status_minutes(spark, d):
    """X6 as expiring state per client and minute, behind each task's own first requests."""
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")
    before = {n: spark.conf.get(n, None) for n in names}
    use_rocksdb(spark)
    try:
        return _stream_status(*_stream_run(spark, d, limiter="minutes")[1:])
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


# ------------------------------------------------------------------ pages ----


def _page_index(spark: SparkSession, sf_dir: str) -> str:
    root = derived_root(spark, sf_dir, "page-index")
    if root not in _BUILT:
        refresh_page_index(crash_table(spark, sf_dir), root)
        _BUILT[root] = root
    return root


_PAGE = (f"FROM crash_reports WHERE app_name = '{APP}' AND created_at > {ts(days=30)}")


@register("paged_c1_read_page", _SQL["c1_read_page"])
def _paged_c1(spark, d):
    """C-1 by the count index: only the page's dates are read."""
    return page_at(crash_table(spark, d), _page_index(spark, d), app=APP, as_of=AS_OF, days=30, limit=25, offset=10).rows


@register("paged_deep_page", q(f"SELECT {COLS} {_PAGE} ORDER BY created_at DESC, id LIMIT 100 OFFSET 1500"))
def _paged_deep(spark, d):
    """A deep page reads as few dates as the first one."""
    return page_at(crash_table(spark, d), _page_index(spark, d), app=APP, as_of=AS_OF, days=30, limit=100, offset=1500).rows


@register("paged_totals", q(f"SELECT o AS offset, COUNT(*) AS total, o + 100 < COUNT(*) AS has_more {_PAGE.replace(' WHERE', ', range(0, 4000, 500) t(o) WHERE')} GROUP BY o"))
def _paged_totals(spark, d):
    """Exact total and ``has_more`` of pages at several depths."""
    facts, index = crash_table(spark, d), _page_index(spark, d)
    pages = {o: page_at(facts, index, app=APP, as_of=AS_OF, days=30, limit=100, offset=o) for o in range(0, 4000, 500)}
    return spark.createDataFrame([(o, p.total, p.has_more) for o, p in pages.items()], "offset long, total long, has_more boolean")


# ------------------------------------------------------------- new errors ----


def _error_days(spark: SparkSession, sf_dir: str) -> str:
    """Snapshots of the 25th, built from its 31 days, and of the days after, each from the one before."""
    root = derived_root(spark, sf_dir, "error-days")
    if root not in _BUILT:
        facts = crash_table(spark, sf_dir)
        build_error_days(facts, root, "2024-01-25")
        for day in range(26, 31):
            advance_error_days(facts, root, f"2024-01-{day}")
        _BUILT[root] = root
    return root


@register("daily_new_errors", q(ctes="""
seen AS (
  SELECT DISTINCT LEFT(error_message, 100) AS prefix, CAST(created_at AS DATE) AS day FROM crash_reports WHERE error_message IS NOT NULL),
fresh AS (
  SELECT prefix, day FROM (
    SELECT prefix, day, LAG(day) OVER (PARTITION BY prefix ORDER BY day) AS last_seen FROM seen)
  WHERE day >= DATE '2024-01-25' AND (last_seen IS NULL OR last_seen < day - 30))""", body="""
SELECT f.day, f.prefix AS new_error, COUNT(*) AS occurrences
FROM fresh f JOIN crash_reports r ON LEFT(r.error_message, 100) = f.prefix AND CAST(r.created_at AS DATE) = f.day
GROUP BY f.day, f.prefix"""))
def _daily_new_errors(spark, d):
    """Q29 for each of the last days as reference day, from day masks and one day of facts each."""
    facts, path = crash_table(spark, d), _error_days(spark, d)
    days = [f"2024-01-{day}" for day in range(25, 31)]
    parts = [new_errors_of_day(facts, path, x).withColumn("day", F.lit(x).cast("date")) for x in days]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------- SQL table functions ----


def _from_sql(key: str, call: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, crash_table(spark, sf_dir), _rollup_table(spark, sf_dir))
        register_functions(spark)
        return spark.sql(f"SELECT * FROM {call}")
    run.__doc__ = f"Rows of ``{key}`` by a SQL table function over the views."
    register(f"sql_{key}", _SQL[key])(run)


_NOW = f"TIMESTAMP_NTZ '{AS_OF}'"
_from_sql("r01_recent_by_app_7d", f"recent_by_app({_NOW}, 7)")
_from_sql("q03_hourly_trend", f"hourly_trend({_NOW}, 7)")
_from_sql("q07_platform_daily", f"platform_daily({_NOW}, 30)")
_from_sql("q09_errors_for_app", f"errors_for_app('{APP}', 80)")
_from_sql("q26_top_apps", f"top_apps({_NOW}, 7)")
_from_sql("q27_platform_rates", f"platform_rates({_NOW}, 30)")
_from_sql("q23_repeat_users", "repeat_users(5)")
