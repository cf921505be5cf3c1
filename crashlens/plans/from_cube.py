"""Distinct-user analytics read from daily bitmaps (``operators.user_cube``) instead of the fact table.

Same rows as the functions of the same names in ``basic`` and ``hardware`` (Q03, Q04, Q10-Q18, R04-R06,
R08, R10).  Whole days are ORs of stored bitmaps; only the window's first day is read as encoded rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.functions.numeric import avg_scaled_half_up, round_ratio
from crashlens.functions.time import as_timestamp
from crashlens.operators.user_cube import UserCube
from crashlens.schema import GPU_FALLBACK, GPU_FALLBACK_SHORT

GB = 1_000_000_000


def _since(as_of, days):
    return as_timestamp(as_of) - dt.timedelta(days=days)


def _gb(name: str):
    return avg_scaled_half_up(F.col(f"{name}_sum"), F.col(f"{name}_n"), GB, 1)


def hourly_trend(cube: UserCube, *, as_of, days: float = 7) -> DataFrame:
    """Q03."""
    return cube.merge("hour", ["hour"], _since(as_of, days), users="unique_users").orderBy("hour")


def version_health(cube: UserCube) -> DataFrame:
    """Q04."""
    rows = cube.merge("version", ["app_name", "app_version"], users="affected_users")
    return (rows.withColumn("crashes_per_user", round_ratio(F.col("crashes"), F.col("affected_users"), 2))
                .orderBy("app_name", F.desc("crashes"), "app_version"))


def version_ratio(cube: UserCube, app: str) -> DataFrame:
    """R10."""
    rows = cube.merge("version", ["app_version"], where=F.col("app_name") == app, users="unique_users")
    return (rows.withColumnRenamed("crashes", "total_crashes")
                .withColumn("crashes_per_user", round_ratio(F.col("total_crashes"), F.col("unique_users"), 2))
                .orderBy(F.desc("total_crashes"), "app_version"))


def by_os(cube: UserCube) -> DataFrame:
    """Q10."""
    return (cube.merge("os", ["os"], users="unique_users").withColumnRenamed("os", "operating_system")
                .orderBy(F.desc("crashes"), "operating_system"))


def by_memory_class(cube: UserCube) -> DataFrame:
    """Q11."""
    rows = cube.merge("memory", ["tier4"])
    return (rows.select(F.col("tier4").alias("memory_category"), "crashes", "users")
                .orderBy(F.desc("crashes"), "memory_category"))


def by_cpu_cores(cube: UserCube) -> DataFrame:
    """Q12."""
    return cube.merge("cores", ["cores"]).withColumnRenamed("cores", "cpu_cores").orderBy("cpu_cores")


def by_gpu(cube: UserCube, *, as_of, days: float = 7, with_memory: bool = True) -> DataFrame:
    """Q13 (``with_memory``) / R04."""
    rows = cube.merge("gpu", ["gpu_name"], _since(as_of, days), sets={"app_name": "_apps"}, users="unique_users_7d")
    extra = [_gb("gpu_memory").alias("avg_gpu_memory_gb")] if with_memory else []
    return (rows.select("gpu_name", F.col("crashes").alias("crashes_7d"), "unique_users_7d",
                        F.size("_apps").cast("long").alias("affected_apps"), *extra)
                .orderBy(F.desc("crashes_7d"), "gpu_name"))


def by_cpu_model(cube: UserCube, *, as_of, days: float = 7, detailed: bool = True) -> DataFrame:
    """Q14 (``detailed``) / R06."""
    keys = ["cpu_model", "cores", *(["frequency_mhz"] if detailed else [])]
    rows = cube.merge("cpu", keys, _since(as_of, days), sets={"app_name": "affected_apps"}, users="unique_users_7d")
    extra = ["affected_apps"] if detailed else []
    return (rows.select(*keys, F.col("crashes").alias("crashes_7d"), "unique_users_7d", *extra)
                .orderBy(F.desc("crashes_7d"), "cpu_model", "cores"))


def by_memory_range(cube: UserCube, *, as_of, days: float = 7, with_averages: bool = True) -> DataFrame:
    """Q15 (``with_averages``) / R05."""
    rows = cube.merge("memory", ["tier5"], _since(as_of, days), users="unique_users_7d")
    extra = [_gb("memory_total").alias("avg_memory_gb"), _gb("memory_available").alias("avg_available_gb")] if with_averages else []
    return (rows.select(F.col("tier5").alias("memory_range"), F.col("crashes").alias("crashes_7d"), "unique_users_7d", *extra)
                .orderBy(F.desc("crashes_7d"), "memory_range"))


def by_os_version(cube: UserCube, *, as_of, days: float = 7) -> DataFrame:
    """Q16."""
    keys = ["os", "os_version", "os_release"]
    rows = cube.merge("os_version", keys, _since(as_of, days), sets={"app_name": "_apps"}, users="unique_users_7d")
    return (rows.select(*keys, F.col("crashes").alias("crashes_7d"), "unique_users_7d",
                        F.size("_apps").cast("long").alias("affected_apps"))
                .orderBy(F.desc("crashes_7d"), *keys))


def hardware_combos(cube: UserCube, *, as_of, days: float = 7, more_than: int = 1, strict: bool = True) -> DataFrame:
    """Q17 (``strict``) / R08.  A missing GPU is a group of its own, as is a GPU of the fallback's name; both
    count together."""
    rows = cube.partials("combo", _since(as_of, days))
    where = F.col("has_cores") & F.col("has_memory") if strict else F.lit(True)
    gpu = F.coalesce("gpu_name", F.lit(GPU_FALLBACK if strict else GPU_FALLBACK_SHORT))
    rows = rows.where(where).select("os", F.col("cores").alias("cpu_cores"), F.col("tier3").alias("memory_tier"),
                                    gpu.alias("gpu_type"), "bucket", "users", "crashes")
    keys = ["os", "cpu_cores", "memory_tier", "gpu_type"]
    merged = rows.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("users").alias("_bits"), F.sum("crashes").alias("_n"))
    return (merged.groupBy(*keys).agg(F.sum("_n").cast("long").alias("crashes_7d"),
                                      F.sum(F.bitmap_count("_bits")).cast("long").alias("unique_users_7d"))
                  .where(F.col("crashes_7d") > more_than).orderBy(F.desc("crashes_7d"), *keys))


def hardware_daily(cube: UserCube, *, as_of, days: float = 7) -> DataFrame:
    """Q18: users from the bitmaps, distinct GPUs and CPUs from the much smaller table of daily combinations."""
    since = _since(as_of, days)
    users = cube.merge("os", ["created_date", "os"], since, users="daily_users")
    parts = cube.partials("os_parts", since).groupBy(F.col("created_date").alias("_date"), F.col("os").alias("_os")).agg(
        F.size(F.collect_set("gpu_name")).cast("long").alias("unique_gpus"),
        F.size(F.collect_set("cpu_model")).cast("long").alias("unique_cpus"))
    return (users.join(parts, [F.col("created_date") == F.col("_date"), F.col("os") == F.col("_os")])
                 .select(F.col("created_date").alias("crash_date"), "os", F.col("crashes").alias("daily_crashes"), "daily_users",
                         "unique_gpus", "unique_cpus")
                 .orderBy(F.desc("crash_date"), F.desc("daily_crashes"), "os"))
