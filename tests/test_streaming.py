"""Streaming twins: rollup = batch rollup (X4), sketch (X5), dedup (X7), alerts."""

from pyspark.sql import functions as F

from crashlens.operators import admit, hourly_rollup, split
from crashlens.sources import AS_OF, FIXTURE_SECRET, raw_envelopes
from crashlens.streaming import (
    dedup_stream, hourly_rollup_stream, read_rollup, spike_alerts, start_rollup,
)
from tests.conftest import SF_SMALL


def test_rollup_stream_equals_batch_with_sketch_and_alerts(spark, tmp_path):
    acc, _ = split(admit(raw_envelopes(spark, SF_SMALL), secret=FIXTURE_SECRET))
    src = str(tmp_path / "acc")
    acc.drop("hw").write.parquet(src)
    static = spark.read.parquet(src)
    stream = spark.readStream.schema(static.schema).parquet(src)
    alerts_path = str(tmp_path / "alerts")
    baseline = hourly_rollup(static)
    cb = spike_alerts(baseline, alerts_path, as_of=AS_OF, k=2.0)
    q = start_rollup(hourly_rollup_stream(stream), str(tmp_path / "rollup"),
                     str(tmp_path / "ck"), on_batch=cb)
    q.awaitTermination()
    got = read_rollup(spark, str(tmp_path / "rollup"))
    want = hourly_rollup(static)
    key = ["app_name", "app_version", "platform", "hour", "crash_count"]
    assert sorted(got.select(*key).collect()) == sorted(want.select(*key).collect())
    est = (got.groupBy("app_name").agg(F.hll_union_agg("users_sketch").alias("s"))
              .select("app_name", F.hll_sketch_estimate("s").alias("users")))
    exact = static.groupBy("app_name").agg(F.count_distinct("ip_hash").alias("users"))
    assert sorted(est.collect()) == sorted(exact.collect())
    alerts = spark.read.parquet(alerts_path)
    assert alerts.where(F.col("recent_crashes") <= F.col("avg_crashes")).count() == 0


def test_dedup_stream_drops_replays(spark, tmp_path):
    raw = raw_envelopes(spark, SF_SMALL)
    src = str(tmp_path / "landing")
    raw.unionByName(raw.limit(50)).write.parquet(src)
    stream = spark.readStream.schema(raw.schema).parquet(src)
    q = (dedup_stream(stream).writeStream.format("memory").queryName("dedup_out")
         .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck"))
         .start())
    q.awaitTermination()
    assert spark.sql("SELECT count(*) AS n FROM dedup_out").first().n == raw.count()


def test_rollup_append_mode_emits_closed_hours_only(spark, tmp_path):
    acc, _ = split(admit(raw_envelopes(spark, SF_SMALL), secret=FIXTURE_SECRET))
    src = str(tmp_path / "acc")
    acc.drop("hw").write.parquet(src)
    static = spark.read.parquet(src)
    stream = spark.readStream.schema(static.schema).parquet(src)
    q = start_rollup(hourly_rollup_stream(stream, watermark="10 minutes", sketch=False), str(tmp_path / "rollup"),
                     str(tmp_path / "ck"), output_mode="append")
    q.awaitTermination()
    got = read_rollup(spark, str(tmp_path / "rollup"))
    want = hourly_rollup(static)
    key = ["app_name", "app_version", "platform", "hour", "crash_count"]
    got_rows = set(got.select(*key).collect())
    assert got_rows and got_rows <= set(want.select(*key).collect())
    # the newest hour is still open (no later data moved the watermark past it)
    newest = want.agg(F.max("hour")).first()[0]
    assert got.where(F.col("hour") == newest).count() == 0


def test_ingest_stream_partial_rollup_equals_batch(spark, tmp_path):
    from crashlens.sources import landing_zone
    from crashlens.streaming import read_ingested, read_report_stream, read_rollup_sums, start_ingest
    land = landing_zone(spark, SF_SMALL)
    q = start_ingest(read_report_stream(spark, land, max_files_per_trigger=2),
                     str(tmp_path / "out"), str(tmp_path / "ck"), secret=FIXTURE_SECRET,
                     limit_per_minute=2, rollup_path=str(tmp_path / "rollup"))
    q.awaitTermination()
    assert len(q.recentProgress) >= 2
    accepted, _ = read_ingested(spark, str(tmp_path / "out"))
    key = ["app_name", "app_version", "platform", "hour", "crash_count"]
    got = read_rollup_sums(spark, str(tmp_path / "rollup")).select(*key).collect()
    want = hourly_rollup(accepted).select(*key).collect()
    assert sorted(got) == sorted(want)
