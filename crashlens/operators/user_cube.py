"""Exact distinct users over any window from daily bitmaps.

``COUNT(DISTINCT ip_hash)`` cannot be added up over days, so every look-back rescans the fact table.
Here each user hash gets a dense number once (the dictionary), and every arrival date stores, for each
value of a grouping, a bitmap of the user numbers seen, next to its additive counts.  A 7- or 30-day
distinct is then the OR of daily bitmaps.  Bitmaps are cut in buckets of 32,768 users
(``bitmap_bucket_number``), which are part of the key: a group with a third of all users spreads over its
buckets, and no row outgrows 4 KB.

Tables below ``root``:

* ``dictionary/batch=n``: ip_hash, user_no (dense from 1, never changed once given)
* ``encoded/created_date=d``: the few columns that groupings read, with user_no instead of the hash; only a
  window's first, partial day is read from it
* ``daily/<grouping>/created_date=d``: keys, bucket, users (bitmap), crashes and other sums
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.functions.hardware import cpu_name, hw_bigint, hw_int, memory_tier, with_hardware
from crashlens.functions.time import as_timestamp, trunc_like, ts_literal
from crashlens.schema import MEMORY_TIERS_3, MEMORY_TIERS_4, MEMORY_TIERS_5
from crashlens.session import by_partition, overwrite_partitions, path_exists

Make = Callable[[], Column]


@dataclass(frozen=True)
class Grouping:
    """Keys, row filter and additive sums of one daily table (callables: columns need a session)."""

    keys: dict[str, Make]
    where: Make | None = None
    sums: dict[str, Make] = field(default_factory=dict)
    users: bool = True


def _col(path: str) -> Make:
    return lambda: F.col(path)


def _known(path: str) -> Make:
    return lambda: F.col(path).isNotNull()


def _bytes(path: str) -> dict[str, Make]:
    name = path.replace(".", "_")
    return {f"{name}_sum": lambda: F.sum(hw_bigint(path).cast("decimal(20,0)")), f"{name}_n": lambda: F.count(hw_bigint(path))}


_APP, _OS, _GPU = {"app_name": _col("app_name")}, {"os": _col("hw.platform.system")}, {"gpu_name": _col("hw.gpu.name")}
_CORES = {"cores": lambda: hw_int("cpu.cores")}


def _tier(tiers) -> Make:
    return lambda: memory_tier(hw_bigint("memory.total"), *tiers)


GROUPINGS = {
    "hour": Grouping({"hour": _col("_hour")}),
    "version": Grouping({**_APP, "app_version": _col("app_version")}),
    "os": Grouping(_OS, _known("hw.platform.system")),
    "memory": Grouping({"tier4": _tier(MEMORY_TIERS_4), "tier5": _tier(MEMORY_TIERS_5)}, _known("hw.memory.total"),
                       {**_bytes("memory.total"), **_bytes("memory.available")}),
    "cores": Grouping(_CORES, _known("hw.cpu.cores")),
    "gpu": Grouping({**_GPU, **_APP}, _known("hw.gpu.name"), _bytes("gpu.memory")),
    "cpu": Grouping({"cpu_model": cpu_name, **_CORES, "frequency_mhz": lambda: hw_int("cpu.freq"), **_APP},
                    lambda: cpu_name().isNotNull()),
    "os_version": Grouping({**_OS, "os_version": _col("hw.platform.version"), "os_release": _col("hw.platform.release"), **_APP},
                           _known("hw.platform.system")),
    "combo": Grouping({**_OS, **_CORES, "tier3": _tier(MEMORY_TIERS_3), **_GPU, "has_cores": _known("hw.cpu.cores"),
                       "has_memory": _known("hw.memory.total")}, _known("hw.platform.system")),
    "os_parts": Grouping({**_OS, **_GPU, "cpu_model": cpu_name}, _known("hw.platform.system"), users=False),
}

_DICTIONARY = "ip_hash string, user_no long, batch long"
_ENCODED = ["created_at", "app_name", "app_version", "hw", "created_date"]


@dataclass(frozen=True)
class UserCube:
    """Reader of the tables below ``root``."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def partials(self, grouping: str, since=None) -> DataFrame:
        """Daily rows of a grouping with ``created_at > since``: whole dates as stored, the first date, if
        the window cuts it, built from its encoded rows."""
        daily = self.table(f"daily/{grouping}")
        if since is None:
            return daily
        since = as_timestamp(since)
        encoded = self.table("encoded")
        edge = encoded.where((F.col("created_date") == F.lit(since.date()))
                             & (F.col("created_at") > ts_literal(since, encoded.schema["created_at"].dataType)))
        return daily.where(F.col("created_date") > F.lit(since.date())).unionByName(day_partials(edge, grouping))

    def merge(self, grouping: str, by: list[str], since=None, where: Column | None = None, sets: dict[str, str] | None = None,
              users: str = "users") -> DataFrame:
        """``by``, ``crashes``, ``users`` (exact distinct), the grouping's sums and, for each ``sets`` entry
        {key: name}, the sorted distinct values of a key, of one row a value of ``by`` (part of the keys).

        Bitmaps are combined map-side by (by, bucket); counts and sets, which need no bitmap, are
        aggregated from the other columns and met by key (NULL keys are a group).
        """
        rows = self.partials(grouping, since)
        if where is not None:
            rows = rows.where(where)
        spec = GROUPINGS[grouping]
        totals = rows.groupBy(*by).agg(
            F.sum("crashes").cast("long").alias("crashes"), *[F.sum(s).alias(s) for s in spec.sums],
            *[F.array_sort(F.collect_set(k)).alias(name) for k, name in (sets or {}).items()])
        if not spec.users:
            return totals
        merged = rows.groupBy(*by, "bucket").agg(F.bitmap_or_agg("users").alias("_bits"))
        counted = merged.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(
            F.sum(F.bitmap_count("_bits")).cast("long").alias(users))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        return totals.join(counted, same).drop(*[f"_{c}" for c in by])


def day_partials(encoded: DataFrame, grouping: str) -> DataFrame:
    """One row per date, key and user bucket of encoded rows; map-side combined."""
    spec = GROUPINGS[grouping]
    rows = encoded.withColumn("_hour", trunc_like("hour", encoded, "created_at"))
    if spec.where is not None:
        rows = rows.where(spec.where())
    keys = [make().alias(name) for name, make in spec.keys.items()]
    if spec.users:
        keys.append(F.bitmap_bucket_number("user_no").alias("bucket"))
    aggs = [F.count(F.lit(1)).alias("crashes"), *[make().alias(name) for name, make in spec.sums.items()]]
    if spec.users:
        aggs.append(F.bitmap_construct_agg(F.bitmap_bit_position("user_no")).alias("users"))
    return rows.groupBy("created_date", *keys).agg(*aggs)


def number_new_users(facts: DataFrame, root: str) -> None:
    """Give every user hash that the dictionary lacks the next dense number.

    New hashes are dealt by ranges and stored with their place in the write task; counts per range turn
    places into numbers, so that no task or driver sees all hashes.  A batch is staged first and
    appended as one folder; a repeated call finds nothing new.
    """
    spark = facts.sparkSession
    path, first = f"{root}/dictionary", 1
    new = facts.select("ip_hash").where(F.col("ip_hash").isNotNull()).distinct()
    if path_exists(spark, path):
        known = spark.read.schema(_DICTIONARY).parquet(path)
        new = new.join(known, "ip_hash", "left_anti")
        first += known.count()
    staged = f"{root}/_staged/{uuid.uuid4().hex}"
    (new.repartitionByRange("ip_hash").sortWithinPartitions("ip_hash")
        .select("ip_hash", F.monotonically_increasing_id().alias("_at")).write.parquet(staged))
    rows = spark.read.schema("ip_hash string, _at long").parquet(staged)
    run, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts = rows.groupBy(run.alias("_run")).agg(F.count(F.lit(1)).alias("_n")).select(  # one row a range
        "_run", F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = rows.join(starts, run == F.col("_run")).select(
        "ip_hash", (F.lit(first) + F.col("_before") + place).alias("user_no"), F.lit(first).alias("batch"))
    overwrite_partitions(numbered, "batch").parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def update_user_cube(facts: DataFrame, root: str, dates=None, groupings=tuple(GROUPINGS)) -> UserCube:
    """Bring the cube up to date for the arrival ``dates`` that received reports (None: all dates of ``facts``).

    Only these dates are read and their partitions replaced (dynamic overwrite), so a batch may be repeated,
    and late rows of an old date rebuild that date alone.  NULL hashes count as crashes, not as users.
    """
    spark, root = facts.sparkSession, root.rstrip("/")
    if dates is not None:
        facts = facts.where(F.col("created_date").isin(*[F.lit(d).cast("date") for d in dates]))
    number_new_users(facts, root)
    rows = with_hardware(facts).select("ip_hash", *_ENCODED)
    encoded = rows.join(spark.read.schema(_DICTIONARY).parquet(f"{root}/dictionary").drop("batch"), "ip_hash", "left").drop("ip_hash")
    overwrite_partitions(by_partition(encoded, "created_date"), "created_date").parquet(f"{root}/encoded")
    stored = spark.read.parquet(f"{root}/encoded")
    if dates is not None:
        stored = stored.where(F.col("created_date").isin(*[F.lit(d).cast("date") for d in dates]))
    for name in groupings:
        overwrite_partitions(by_partition(day_partials(stored, name), "created_date"), "created_date").parquet(
            f"{root}/daily/{name}")
    return UserCube(spark, root)
