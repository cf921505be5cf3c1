"""Rows come in the documented order (L1-L3, L7, F9); the oracle comparison does not look at it."""

import pytest

from crashlens import catalog

SF = "/root/testdata/sf0.01"
# key -> columns, a leading "-" for descending; names that follow break ties
ORDER = {
    "q01_app_totals": ["-total_crashes", "app_name"], "q02_recent_by_app": ["-crashes_today", "app_name"],
    "q03_hourly_trend": ["hour"], "q04_version_health": ["app_name", "-crashes", "app_version"],
    "q05_version_compare": ["-version_first_seen", "app_version"], "q06_platform_share": ["-crashes", "platform"],
    "q07_platform_daily": ["-date", "-daily_crashes", "platform"], "q08_top_errors": ["-frequency", "error_preview"],
    "q09_errors_for_app": ["-occurrences", "error_type"], "q12_by_cpu_cores": ["cpu_cores"],
    "q18_hardware_daily": ["-crash_date", "-daily_crashes", "os"], "q22_by_hour_of_day": ["hour"],
    "q23_repeat_users": ["-crash_count"], "q25_dashboard": ["-hour", "app_name", "app_version", "platform"],
    "q26_top_apps": ["-total_crashes", "app_name"], "q28_spikes": ["-z_score", "app_name", "recent_crashes"],
    "q29_new_errors": ["-occurrences", "new_error"], "c1_read_page": ["-created_at", "id"],
    "rollup_q25_dashboard": ["-hour", "app_name", "app_version", "platform"], "sketch_q08_top_errors": ["-frequency", "error_preview"],
    "cube_q04_version_health": ["app_name", "-crashes", "app_version"], "paged_deep_page": ["-created_at", "id"],
}
WEEK = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


@pytest.mark.parametrize("name", ORDER)
def test_rows_are_in_order(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    want = list(rows)
    for c in reversed(ORDER[name]):  # stable sorts, least significant first
        want.sort(key=lambda r, c=c.lstrip("-"): r[c], reverse=c.startswith("-"))
    assert len(rows) > 1 and rows == want


def test_days_of_the_week_are_in_order(spark):
    days = [r.day_of_week for r in catalog.queries()["q21_by_day_of_week"](spark, SF).collect()]
    assert days == [d for d in WEEK if d in days]
