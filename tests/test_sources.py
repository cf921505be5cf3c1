"""Sources and sinks: JSON read, append + partition pruning, export, replay, views."""

import json

from pyspark.sql import functions as F

from crashlens.operators import admit, hourly_rollup, split
from crashlens.plans import app_totals, recent_by_app
from crashlens.sources import (
    AS_OF, FIXTURE_SECRET, append_reports, crash_reports, export, raw_envelopes,
    read_reports, register_views, replay_fallback,
)
from tests.conftest import SF_SMALL


def test_json_envelopes_roundtrip_and_append(spark, tmp_path):
    raw = raw_envelopes(spark, SF_SMALL)
    path = str(tmp_path / "raw")
    raw.write.json(path)
    back = read_reports(spark, path, "json")
    assert back.count() == raw.count()
    acc, quarantine = split(admit(back, secret=FIXTURE_SECRET))
    table = str(tmp_path / "table")
    append_reports(acc, table)
    stored = crash_reports(spark, table)
    assert stored.count() == acc.count()
    assert quarantine.count() + stored.count() == raw.count()
    # S2 + lookback: created_at bound pushed to the scan, partitions pruned
    q = recent_by_app(stored, as_of=AS_OF, hours=24)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
    assert "PushedFilters: [IsNotNull(created_at), GreaterThan(created_at" in plan
    # S5 append only: a second append adds rows, never replaces
    append_reports(acc.limit(3), table)
    assert crash_reports(spark, table).count() == acc.count() + 3


def test_export_csv_and_json(spark, tmp_path, reports):
    out = app_totals(reports)
    export(out, str(tmp_path / "csv"), "csv")
    export(out, str(tmp_path / "json"), "json")
    csv = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert csv.count() == out.count()
    assert spark.read.json(str(tmp_path / "json")).count() == out.count()


def test_register_views(spark, reports):
    register_views(spark, reports)
    n = spark.sql("SELECT sum(crash_count) AS n FROM crash_analytics").first().n
    assert n == reports.count()
    assert hourly_rollup(reports).count() == spark.table("crash_analytics").count()


def test_replay_fallback_shape(spark):
    rows = [("2024-01-30T20:00:00.000Z", "boom", "at x", "demo", "v1.0.0"),
            ("2024-01-30T20:00:00.000Z", "boom", "at x", "demo", "v1.0")]
    fb = spark.createDataFrame(rows, "timestamp string, error string, stack string, "
                                     "app_name string, app_version string")
    raw = replay_fallback(fb, platform="darwin", arrived_at="2024-01-30T21:00:00Z")
    body = json.loads(raw.first().body)
    assert body["platform"] == "macos" and body["error_message"] == "boom"
    adm = admit(raw, secret=None, check_signature=False, limit_per_minute=None)
    assert sorted(r.status for r in adm.collect()) == [200, 400]  # v1.0 fails V6
    # no platform at all: rule V3 quarantines every replayed row
    raw2 = replay_fallback(fb, arrived_at="2024-01-30T21:00:00Z")
    adm2 = admit(raw2, secret=None, check_signature=False, limit_per_minute=None)
    assert sorted(r.status for r in adm2.collect()) == [400, 400]


def test_batch_write_is_idempotent(spark, tmp_path):
    from crashlens.operators import ingest_batch
    from crashlens.streaming import read_ingested
    raw = raw_envelopes(spark, SF_SMALL)
    root = str(tmp_path / "out")
    ingest_batch(raw, root, 7, secret=FIXTURE_SECRET, limit_per_minute=2)
    ingest_batch(raw, root, 7, secret=FIXTURE_SECRET, limit_per_minute=2)  # retried batch
    acc, quarantine = read_ingested(spark, root)
    assert acc.count() + quarantine.count() == raw.count()
    ingest_batch(raw.limit(10), root, 8, secret=FIXTURE_SECRET)
    acc2, _ = read_ingested(spark, root)
    assert acc2.count() == acc.count() + 10


def test_read_plain_bodies(spark, tmp_path):
    import os
    good = json.dumps({"app_name": "demo", "app_version": "v1.0.0", "platform": "ios",
                       "crash_timestamp": "2020-01-01T00:00:00Z"})
    path = tmp_path / "bodies"
    path.mkdir()
    (path / "a.jsonl").write_text(good + "\n" + '{"app_name": \n')
    os.utime(path / "a.jsonl", (1577840400, 1577840400))  # 2020-01-01T01:00:00Z
    raw = read_reports(spark, str(path), "bodies")
    assert raw.count() == 2
    # accepted only because arrival (file time, 01:00) is within 24 h of the crash
    out = {r.reason for r in admit(raw, secret=None, check_signature=False).collect()}
    assert out == {"accepted", "invalid_json"}
