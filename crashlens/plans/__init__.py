"""Analytics plans: the named queries over the fact table and the rollup."""

from crashlens.plans.alerts import new_errors, spikes
from crashlens.plans.basic import (
    app_totals, errors_for_app, hourly_trend, platform_daily, platform_share,
    recent_by_app, top_errors, version_compare, version_health, version_ratio,
)
from crashlens.plans.behaviour import (
    by_day_of_week, by_hour_of_day, repeat_users, session_crashes,
)
from crashlens.plans.hardware import (
    by_cpu_cores, by_cpu_model, by_gpu, by_memory_class, by_memory_range,
    by_os, by_os_version, hardware_combos, hardware_daily, high_end,
    low_resource,
)
from crashlens.plans.reader import (
    crash_stats, crashes_by_error, page_info, read_page, read_page_after,
    recent_crashes,
)
from crashlens.plans.rollup_views import dashboard, platform_rates, top_apps

__all__ = [
    "new_errors", "spikes", "app_totals", "errors_for_app", "hourly_trend",
    "platform_daily", "platform_share", "recent_by_app", "top_errors",
    "version_compare", "version_health", "version_ratio", "by_day_of_week",
    "by_hour_of_day", "repeat_users", "session_crashes", "by_cpu_cores",
    "by_cpu_model", "by_gpu", "by_memory_class", "by_memory_range", "by_os",
    "by_os_version", "hardware_combos", "hardware_daily", "high_end",
    "low_resource", "crash_stats", "crashes_by_error", "page_info",
    "read_page", "read_page_after", "recent_crashes", "dashboard", "platform_rates", "top_apps",
]
