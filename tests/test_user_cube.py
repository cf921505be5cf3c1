"""Distinct users from daily bitmaps equal the counts over the fact table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crashlens import plans as P
from crashlens.operators.user_cube import UserCube, update_user_cube
from crashlens.plans import from_cube as C
from crashlens.sources.fixture import crash_table
from tests.conftest import SF_SMALL

MID_DAY = "2024-01-19 09:41:07"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def facts(spark):
    """Reports with NULL hashes, and one hash that stands for many rows."""
    df = crash_table(spark, SF_SMALL)
    return df.withColumn("ip_hash", F.when(F.col("id") % 17 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.col("ip_hash")))


@pytest.fixture(scope="module")
def cube(facts, tmp_path_factory):
    return update_user_cube(facts, str(tmp_path_factory.mktemp("cube")))


@pytest.mark.parametrize("days", [0.5, 3, 40])
def test_windows_that_cut_a_day(facts, cube, days):
    assert rows(C.hourly_trend(cube, as_of=MID_DAY, days=days)) == rows(P.hourly_trend(facts, as_of=MID_DAY, days=days))
    for name in ("by_gpu", "by_os_version", "hardware_daily"):
        assert rows(getattr(C, name)(cube, as_of=MID_DAY, days=days)) == rows(getattr(P, name)(facts, as_of=MID_DAY, days=days)), name


def test_null_hashes_are_crashes_but_not_users(facts, cube):
    assert rows(C.version_health(cube)) == rows(P.version_health(facts))
    assert rows(C.by_cpu_model(cube, as_of=MID_DAY, days=9)) == rows(P.by_cpu_model(facts, as_of=MID_DAY, days=9))


def test_numbers_are_dense_and_kept(facts, cube, spark):
    numbers = [r.user_no for r in cube.table("dictionary").collect()]
    assert sorted(numbers) == list(range(1, facts.select("ip_hash").where("ip_hash is not null").distinct().count() + 1))


def test_batches_late_rows_and_repeats(facts, spark, tmp_path):
    """Dates in two batches, one repeated, then late rows for an old date: the same as one build; numbers stay."""
    root = str(tmp_path / "cube")
    dates = sorted(r[0] for r in facts.select("created_date").distinct().collect())
    early, late_date = dates[:6], dates[2]
    window = facts.where(F.col("created_date") <= F.lit(dates[8]))
    held_back = (F.col("created_date") == F.lit(late_date)) & (F.col("id") % 2 == 0)
    first = window.where(~held_back)
    some = ("version", "os")
    update_user_cube(first, root, early, some)
    before = {r.ip_hash: r.user_no for r in UserCube(spark, root).table("dictionary").collect()}
    update_user_cube(first, root, early, some)
    update_user_cube(first, root, dates[6:9], some)
    cube = update_user_cube(window, root, [late_date], some)
    after = {r.ip_hash: r.user_no for r in cube.table("dictionary").collect()}
    assert before.items() <= after.items() and sorted(after.values()) == list(range(1, len(after) + 1))
    assert rows(C.version_health(cube)) == rows(P.version_health(window))
    assert rows(C.by_os(cube)) == rows(P.by_os(window))


def test_more_users_than_one_bucket(spark, tmp_path):
    n = 70_000
    facts = spark.range(n * 2).select(
        F.col("id"), F.concat(F.lit("h"), F.col("id") % n).alias("ip_hash"), F.lit("a").alias("app_name"),
        F.lit("v").alias("app_version"), F.lit("{}").alias("hardware_specs"),
        F.lit(dt.datetime(2024, 1, 2, 3)).cast("timestamp_ntz").alias("created_at"),
        F.lit(dt.date(2024, 1, 2)).alias("created_date"))
    cube = update_user_cube(facts, str(tmp_path / "cube"), groupings=("version",))
    assert cube.table("daily/version").count() == 3  # buckets of 32,768
    got = C.version_health(cube).first()
    assert (got.crashes, got.affected_users) == (n * 2, n)


def test_no_scan_reads_the_hash(cube):
    df = C.by_gpu(cube, as_of=MID_DAY, days=7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ip_hash" not in plan and "PartitionFilters: [isnotnull(created_date" in plan
