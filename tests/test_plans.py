"""Reader bounds, plan shapes and invariants of the analytics."""

import pytest
from pyspark.sql import functions as F

from crashlens import plans as P
from crashlens.operators import hourly_rollup
from crashlens.sources import AS_OF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_read_page_bounds(reports):
    for kw in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"days": 0}, {"days": 366}):
        with pytest.raises(ValueError):
            P.read_page(reports, app="app-1", as_of=AS_OF, **kw)
    info = P.page_info(reports, app="app-1", as_of=AS_OF, days=30, limit=10, offset=0)
    assert info["total"] > 10 and info["has_more"]
    page = P.read_page(reports, app="app-1", as_of=AS_OF, limit=10, offset=5).collect()
    full = P.read_page(reports, app="app-1", as_of=AS_OF, limit=15).collect()
    assert [r.id for r in page] == [r.id for r in full[5:]]


def test_new_errors_anti_join_and_aggregate_agree(reports):
    a = P.new_errors(reports, as_of=AS_OF)
    b = P.new_errors(reports, as_of=AS_OF, method="anti_join")
    assert "LeftAnti" in plan(b)
    assert sorted(a.collect()) == sorted(b.collect())
    assert "Join" not in plan(a)


def test_platform_share_sums_to_100(reports):
    total = P.platform_share(reports).agg(F.sum("percentage")).first()[0]
    assert abs(total - 100.0) <= 0.05


def test_rollup_total_equals_rows(reports):
    assert hourly_rollup(reports).agg(F.sum("crash_count")).first()[0] == reports.count()


def test_lookback_pushes_bound_to_rollup_source(reports):
    p = plan(P.top_apps(reports, as_of=AS_OF, days=7))
    assert "2024-01-23 23:30:00" in p


def test_spikes_options(reports):
    base = P.spikes(reports, as_of=AS_OF).collect()
    assert base and all(r.recent_crashes > r.avg_crashes for r in base)
    P.spikes(reports, as_of=AS_OF, exclude_current=True).collect()
    zf = P.spikes(reports, as_of=AS_OF, zero_fill=True).collect()
    assert all(r.recent_crashes > r.avg_crashes for r in zf)


def test_crash_stats_top_errors_bounded(reports):
    rows = P.crash_stats(reports, as_of=AS_OF, app="app-1", top=3).collect()
    assert sum(1 for r in rows if r.dimension == "error") <= 3
    total = [r.n for r in rows if r.dimension == "total_crashes"][0]
    assert sum(r.n for r in rows if r.dimension == "platform") == total


def test_keyset_page_matches_offset_page(reports):
    first = P.read_page(reports, app="app-1", as_of=AS_OF, limit=7).collect()
    last = first[-1]
    nxt = P.read_page_after(reports, app="app-1", as_of=AS_OF, limit=7,
                            after_created_at=last.created_at, after_id=last.id).collect()
    by_offset = P.read_page(reports, app="app-1", as_of=AS_OF, limit=7, offset=7).collect()
    assert [r.id for r in nxt] == [r.id for r in by_offset]


def test_hardware_daily_approx_close(reports):
    exact = {(r.crash_date, r.os): r.daily_users for r in
             P.hardware_daily(reports, as_of=AS_OF).collect()}
    approx = {(r.crash_date, r.os): r.daily_users for r in
              P.hardware_daily(reports, as_of=AS_OF, approx=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(approx[k] - v) <= max(1, 0.05 * v) for k, v in exact.items())


def test_refresh_rollup_partitions(spark, reports, tmp_path):
    from crashlens.operators import read_rollup_table, refresh_rollup
    path = str(tmp_path / "rollup")
    refresh_rollup(reports, path)
    full = read_rollup_table(spark, path)
    assert full.agg(F.sum("crash_count")).first()[0] == reports.count()
    before = sorted(full.drop("hour_date").collect())
    refresh_rollup(reports, path, dates=["2024-01-30"])
    again = read_rollup_table(spark, path)
    assert sorted(again.drop("hour_date").collect()) == before


def test_approx_options_close_to_exact(reports):
    for fn, key in ((P.by_gpu, "gpu_name"), (P.by_os_version, "os")):
        exact = {r[key]: r.unique_users_7d for r in fn(reports, as_of=AS_OF).collect()}
        approx = {r[key]: r.unique_users_7d for r in fn(reports, as_of=AS_OF, approx=True).collect()}
        assert exact.keys() == approx.keys()
        assert all(abs(approx[k] - v) <= max(1, 0.05 * v) for k, v in exact.items())
