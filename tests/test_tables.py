"""Stored tables that batches keep up to date: error sketches, prefix moments, the exact stream rollup."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from crashlens import plans as P
from crashlens.catalog_tables import _exact_rollup
from crashlens.operators import hourly_rollup
from crashlens.operators.error_sketch import map_size, read_error_sketches, top_errors_from_sketches, update_error_sketches
from crashlens.operators.moments import hour_moments, spikes_by_hour, trailing_baseline
from crashlens.sources.fixture import files_per_date
from crashlens.streaming.late import (
    batch_cells, exact_rollup_parts, hourly_alerts, read_exact_rollup, start_exact_rollup, users_by,
)

DAY = dt.date(2024, 1, 2)


def rows(df):
    return sorted(map(str, df.collect()))


def messages(spark, counts):
    """One report per (prefix, copies) and copy, over two days."""
    df = spark.createDataFrame([(m, n) for m, n in counts], "error_message string, n int")
    df = df.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    return df.select("error_message", F.concat(F.lit("u"), F.col("i") % 7).alias("ip_hash"),
                     F.concat(F.lit("app-"), F.col("i") % 3).alias("app_name"),
                     F.date_add(F.lit(DAY), (F.col("i") % 2).cast("int")).alias("created_date"))


def found(spark, facts, path, tracked, **kw):
    update_error_sketches(facts, path, tracked=tracked)
    return top_errors_from_sketches(facts, read_error_sketches(spark, path), n=5, tracked=tracked, **kw)


def test_heavy_prefixes_are_proven_from_few_candidates(spark, tmp_path):
    counts = [(f"heavy {k}", 400 - k) for k in range(8)] + [(f"rare {k}", 1) for k in range(900)] + [(None, 50)]
    facts = messages(spark, counts)
    top = found(spark, facts, str(tmp_path / "s"), tracked=96)
    assert top.proven and top.candidates <= 96 and top.bound == pytest.approx(3.5 * (3172 + 900) / map_size(96))
    assert rows(top.rows) == rows(P.top_errors(facts, n=5))


def test_flat_prefixes_force_the_full_count(spark, tmp_path):
    facts = messages(spark, [(f"error {k:04d}", 3) for k in range(600)])
    top = found(spark, facts, str(tmp_path / "s"), tracked=8)
    assert not top.proven and rows(top.rows) == rows(P.top_errors(facts, n=5))


def test_few_prefixes_are_complete(spark, tmp_path):
    facts = messages(spark, [("a", 3), ("b", 3), ("", 1)])
    top = found(spark, facts, str(tmp_path / "s"), tracked=8)
    assert top.proven and rows(top.rows) == rows(P.top_errors(facts, n=5))
    none = found(spark, messages(spark, [(None, 4)]), str(tmp_path / "t"), tracked=8)
    assert none.proven and none.rows.count() == 0


def test_sketches_of_a_window_and_of_one_changed_date(spark, tmp_path):
    facts, path = messages(spark, [("a", 9), ("b", 4)]), str(tmp_path / "s")
    update_error_sketches(facts.where("error_message = 'a'"), path, tracked=8)
    update_error_sketches(facts, path, dates=["2024-01-03"], tracked=8)
    later = facts.where(F.col("created_date") >= F.lit("2024-01-03").cast("date"))
    top = top_errors_from_sketches(facts, read_error_sketches(spark, path), n=5, tracked=8, since_date="2024-01-03")
    assert top.proven and rows(top.rows) == rows(P.top_errors(later, n=5))


def test_every_hour_equals_q28_asked_at_its_end(reports):
    cells = hourly_rollup(reports).persist()
    every = spikes_by_hour(cells, trailing_baseline(hour_moments(cells))).persist()
    hours = [r.hour for r in every.select("hour").distinct().orderBy("hour").collect()]
    assert len(hours) > 4
    for hour in hours[::max(1, len(hours) // 6)] + [hours[-1]]:
        want = P.spikes(cells, as_of=hour + dt.timedelta(hours=1))
        got = every.where(F.col("hour") == F.lit(hour)).select("app_name", "recent_crashes", "avg_crashes", "z_score")
        assert rows(got) == rows(want), hour


def stream_rows(spark, order):
    """Reports of four days, six hours apart and at the hour's edges, in files of the given order."""
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * k, seconds=s) for k in range(16) for s in (0, 1799, 3599)]
    data = [(f"app-{i % 2}", "v1", "linux", f"u{i % 5}", t) for i, t in enumerate(at)]
    files = [data[:12], data[12:24], data[24:36], data[36:]]
    return [spark.createDataFrame(files[i], "app_name string, app_version string, platform string, ip_hash string, "
                                  "created_at timestamp_ntz") for i in order]


def run_stream(spark, tmp_path, order, **kw):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    parts = stream_rows(spark, order)
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    start_exact_rollup(stream, root, f"{root}/ck", **kw).awaitTermination()
    return spark.read.parquet(folder), root, stream


CELLS = ["app_name", "app_version", "platform", "hour", "crash_count", "unique_users"]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 2, 3, 0), (3, 2, 1, 0)])
def test_stream_rollup_loses_nothing(spark, tmp_path, order):
    facts, root, _ = run_stream(spark, tmp_path, order)
    assert rows(read_exact_rollup(spark, root).select(CELLS)) == rows(hourly_rollup(facts).select(CELLS))
    parts = exact_rollup_parts(spark, root)
    late = parts["late"].agg(F.sum("crash_count")).first()[0] or 0
    assert late == {(0, 1, 2, 3): 0, (1, 2, 3, 0): 12, (3, 2, 1, 0): 36}[order]
    last_hour = parts["open"].select("hour").distinct().collect()
    assert [r.hour for r in last_hour] == [dt.datetime(2024, 1, 4, 18)]  # the state holds open hours only
    assert len([x for x in os.listdir(f"{root}/open") if x.startswith("batch_id")]) <= 2


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    facts, root, stream = run_stream(spark, tmp_path, (1, 2, 3, 0), on_close=hourly_alerts(str(tmp_path / "out")))
    before = rows(read_exact_rollup(spark, root).select(CELLS))
    last = max(int(x) for x in os.listdir(f"{root}/ck/commits") if x.isdigit())
    for x in os.listdir(f"{root}/ck/commits"):
        if str(last) in x:
            os.remove(f"{root}/ck/commits/{x}")  # as if the driver had died before the commit
    start_exact_rollup(stream, root, f"{root}/ck", on_close=hourly_alerts(root)).awaitTermination()
    assert rows(read_exact_rollup(spark, root).select(CELLS)) == before == rows(hourly_rollup(facts).select(CELLS))


def test_uncommitted_output_is_not_read(spark, tmp_path):
    facts, root, _ = run_stream(spark, tmp_path, (0, 1, 2, 3))
    want = rows(read_exact_rollup(spark, root).select(CELLS))
    for kind in ("late", "closed", "open"):
        batch_cells(facts).write.parquet(f"{root}/{kind}/batch_id=99")
    assert rows(read_exact_rollup(spark, root).select(CELLS)) == want
    shutil.rmtree(f"{root}/marks")
    assert read_exact_rollup(spark, root).count() == 0


def test_sketches_merge_to_coarser_grains(spark, tmp_path):
    facts, root, _ = run_stream(spark, tmp_path, (1, 2, 3, 0))
    got = users_by(read_exact_rollup(spark, root), "app_name")
    want = facts.groupBy("app_name").agg(F.count_distinct("ip_hash").alias("users_estimate"), F.count(F.lit(1)).alias("crashes"))
    assert rows(got) == rows(want)


def test_stream_parts_are_not_landed_by_one_task(spark, tmp_path):
    """Four micro-batches, each of the files that several tasks wrote."""
    events = spark.range(0, 6000, 1, 4).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id") * 7)).alias("ts"),
        (F.col("id") % 90).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    root = _exact_rollup(spark, str(tmp_path), "late")
    landed = [x for x in os.listdir(f"{root}/landing") if x.endswith(".parquet")]
    assert len(landed) > 4
    assert sorted(x for x in os.listdir(f"{root}/marks") if x.startswith("batch_id")) == [f"batch_id={i}" for i in range(4)]
    late = exact_rollup_parts(spark, root)["late"].agg(F.sum("crash_count")).first()[0]
    assert late == events.where("ts < '2024-01-08'").count()
    assert read_exact_rollup(spark, root).agg(F.sum("crash_count")).first()[0] == 6000


def test_longer_tables_have_more_writers_a_date():
    assert [files_per_date(n) for n in (0, 100_000, 6_000_000, 36_000_000)] == [2, 2, 3, 18]
