"""Hardware breakdowns over the parsed ``hw`` struct.

The JSON is parsed once (``with_hardware``); each query touches a few
leaves, and Catalyst prunes the parsed schema (or, on stored tables, the
nested Parquet columns) to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.functions.hardware import (
    cpu_name, hw_bigint, hw_int, memory_tier, with_hardware,
)
from crashlens.functions.numeric import avg_scaled_half_up
from crashlens.functions.text import left
from crashlens.functions.time import lookback
from crashlens.schema import (
    GPU_FALLBACK, GPU_FALLBACK_SHORT, MEMORY_TIERS_3, MEMORY_TIERS_4,
    MEMORY_TIERS_5,
)

def _n():
    return F.count(F.lit(1))
GB = 1_000_000_000


def _distinct(col, approx: bool = False):
    """Exact distinct count, or a HyperLogLog++ estimate (about 1% error)
    that aggregates map-side without expanding rows per distinct column."""
    col = F.col(col) if isinstance(col, str) else col
    return F.approx_count_distinct(col) if approx else F.count_distinct(col)


def _users(approx: bool = False):
    return _distinct("ip_hash", approx)


def _avg_gb(col):
    """``round(avg(col) / 1e9, 1)`` for an integer byte column (a decimal sum: bytes pass 2^63)."""
    col = F.col(col) if isinstance(col, str) else col
    return avg_scaled_half_up(F.sum(col.cast("decimal(20,0)")), F.count(col), GB, 1)


def _system():
    return F.col("hw.platform.system")


def _mem_total():
    return hw_bigint("memory.total")


def _week(df, as_of, days):
    return lookback(with_hardware(df), as_of, days=days)


def by_os(df: DataFrame) -> DataFrame:
    """Q10: crashes and users per operating system."""
    df = with_hardware(df)
    return (df.where(_system().isNotNull())
              .groupBy(_system().alias("operating_system"))
              .agg(_n().alias("crashes"), _users().alias("unique_users"))
              .orderBy(F.desc("crashes"), "operating_system"))


def by_memory_class(df: DataFrame) -> DataFrame:
    """Q11: four memory classes."""
    df = with_hardware(df)
    edges, labels = MEMORY_TIERS_4
    return (df.where(F.col("hw.memory.total").isNotNull())
              .groupBy(memory_tier(_mem_total(), edges, labels).alias("memory_category"))
              .agg(_n().alias("crashes"), _users().alias("users"))
              .orderBy(F.desc("crashes"), "memory_category"))


def by_cpu_cores(df: DataFrame) -> DataFrame:
    """Q12: crashes and users per core count."""
    df = with_hardware(df)
    return (df.where(F.col("hw.cpu.cores").isNotNull())
              .groupBy(hw_int("cpu.cores").alias("cpu_cores"))
              .agg(_n().alias("crashes"), _users().alias("users"))
              .orderBy("cpu_cores"))


def by_gpu(df: DataFrame, *, as_of, days: float = 7,
           with_memory: bool = True, approx: bool = False) -> DataFrame:
    """Q13 (``with_memory``) / R04: crashes, users and apps per GPU."""
    aggs = [_n().alias("crashes_7d"), _users(approx).alias("unique_users_7d"),
            _distinct("app_name", approx).alias("affected_apps")]
    if with_memory:
        aggs.append(_avg_gb(hw_bigint("gpu.memory")).alias("avg_gpu_memory_gb"))
    return (_week(df, as_of, days)
            .where(F.col("hw.gpu.name").isNotNull())
            .groupBy(F.col("hw.gpu.name").alias("gpu_name"))
            .agg(*aggs)
            .orderBy(F.desc("crashes_7d"), "gpu_name"))


def by_cpu_model(df: DataFrame, *, as_of, days: float = 7,
                 detailed: bool = True) -> DataFrame:
    """Q14 (``detailed``: MHz and app list) / R06 (model and cores only)."""
    keys = [cpu_name().alias("cpu_model"), hw_int("cpu.cores").alias("cores")]
    aggs = [_n().alias("crashes_7d"), _users().alias("unique_users_7d")]
    if detailed:
        keys.append(hw_int("cpu.freq").alias("frequency_mhz"))
        aggs.append(F.array_sort(F.collect_set("app_name")).alias("affected_apps"))
    return (_week(df, as_of, days)
            .where(cpu_name().isNotNull())
            .groupBy(*keys).agg(*aggs)
            .orderBy(F.desc("crashes_7d"), "cpu_model", "cores"))


def by_memory_range(df: DataFrame, *, as_of, days: float = 7,
                    with_averages: bool = True) -> DataFrame:
    """Q15 (``with_averages``) / R05: five memory ranges."""
    edges, labels = MEMORY_TIERS_5
    aggs = [_n().alias("crashes_7d"), _users().alias("unique_users_7d")]
    if with_averages:
        aggs += [_avg_gb(_mem_total()).alias("avg_memory_gb"),
                 _avg_gb(hw_bigint("memory.available")).alias("avg_available_gb")]
    return (_week(df, as_of, days)
            .where(F.col("hw.memory.total").isNotNull())
            .groupBy(memory_tier(_mem_total(), edges, labels).alias("memory_range"))
            .agg(*aggs)
            .orderBy(F.desc("crashes_7d"), "memory_range"))


def by_os_version(df: DataFrame, *, as_of, days: float = 7,
                  approx: bool = False) -> DataFrame:
    """Q16: system, version and release; a NULL part is its own group."""
    return (_week(df, as_of, days)
            .where(_system().isNotNull())
            .groupBy(_system().alias("os"),
                     F.col("hw.platform.version").alias("os_version"),
                     F.col("hw.platform.release").alias("os_release"))
            .agg(_n().alias("crashes_7d"), _users(approx).alias("unique_users_7d"),
                 _distinct("app_name", approx).alias("affected_apps"))
            .orderBy(F.desc("crashes_7d"), "os", "os_version", "os_release"))


def hardware_combos(df: DataFrame, *, as_of, days: float = 7,
                    more_than: int = 1, strict: bool = True) -> DataFrame:
    """Q17 (``strict``) / R08: OS x cores x memory tier x GPU.

    Strict (Q17) needs system, cores and memory present and names a missing
    GPU ``Integrated/Unknown``; the loose form (R08) only needs the system,
    lets a missing memory fall in the top tier and says ``Integrated``.
    Groups with at most ``more_than`` crashes are dropped (HAVING).
    """
    edges, labels = MEMORY_TIERS_3
    src = _week(df, as_of, days).where(_system().isNotNull())
    if strict:
        src = src.where(F.col("hw.cpu.cores").isNotNull()
                        & F.col("hw.memory.total").isNotNull())
    fallback = GPU_FALLBACK if strict else GPU_FALLBACK_SHORT
    return (src.groupBy(_system().alias("os"),
                        hw_int("cpu.cores").alias("cpu_cores"),
                        memory_tier(_mem_total(), edges, labels).alias("memory_tier"),
                        F.coalesce(F.col("hw.gpu.name"), F.lit(fallback)).alias("gpu_type"))
               .agg(_n().alias("crashes_7d"), _users().alias("unique_users_7d"))
               .where(F.col("crashes_7d") > more_than)
               .orderBy(F.desc("crashes_7d"), "os", "cpu_cores", "memory_tier", "gpu_type"))


def hardware_daily(df: DataFrame, *, as_of, days: float = 7,
                   approx: bool = False) -> DataFrame:
    """Q18: per day and OS: crashes, users, distinct GPUs and CPUs.

    Three exact distinct counts make Spark expand every row three times
    before the first shuffle; ``approx=True`` uses HyperLogLog++ sketches
    (``approx_count_distinct``, about 1% error) that aggregate map-side in
    one pass.
    """
    def distinct(c):
        return _distinct(c, approx)
    return (_week(df, as_of, days)
            .where(_system().isNotNull())
            .groupBy(F.to_date("created_at").alias("crash_date"), _system().alias("os"))
            .agg(_n().alias("daily_crashes"), distinct(F.col("ip_hash")).alias("daily_users"),
                 distinct(F.col("hw.gpu.name")).alias("unique_gpus"),
                 distinct(cpu_name()).alias("unique_cpus"))
            .orderBy(F.desc("crash_date"), F.desc("daily_crashes"), "os"))


def low_resource(df: DataFrame, *, as_of, days: float = 7,
                 with_errors: bool = True) -> DataFrame:
    """Q19 (``with_errors``) / R07: devices with <= 4 cores or < 8 GB.

    The distinct error prefixes per app are deduplicated on (app, prefix)
    first, so a hot app's list is built from distinct values only, not from
    one set per map task; the list is the output itself.
    """
    src = _week(df, as_of, days).where(
        (hw_int("cpu.cores") <= 4) | (_mem_total() < 8 * GB))
    stats = (src.groupBy("app_name")
                .agg(_n().alias("crashes_7d"), _users().alias("affected_users"),
                     F.avg(hw_int("cpu.cores")).alias("avg_cpu_cores"),
                     _avg_gb(_mem_total()).alias("avg_memory_gb")))
    if with_errors:
        errors = (src.where(F.col("error_message").isNotNull())
                     .select("app_name", left(F.col("error_message"), 50).alias("e"))
                     .distinct()
                     .groupBy("app_name")
                     .agg(F.array_sort(F.collect_list("e")).alias("common_errors")))
        stats = stats.join(errors, "app_name", "left")
    return stats.orderBy(F.desc("crashes_7d"), "app_name")


def high_end(df: DataFrame, *, as_of, days: float = 7,
             more_than: int = 2, approx: bool = False) -> DataFrame:
    """Q20: >= 12 cores and >= 32 GB, apps with more than ``more_than``."""
    return (_week(df, as_of, days)
            .where((hw_int("cpu.cores") >= 12) & (_mem_total() >= 32 * GB))
            .groupBy("app_name")
            .agg(_n().alias("crashes_7d"), _users(approx).alias("affected_users"),
                 F.avg(hw_int("cpu.cores")).alias("avg_cpu_cores"),
                 _avg_gb(_mem_total()).alias("avg_memory_gb"),
                 _distinct(F.col("hw.gpu.name"), approx).alias("unique_gpus"))
            .where(F.col("crashes_7d") > more_than)
            .orderBy(F.desc("crashes_7d"), "app_name"))
