"""Cases from review: late rows, equal and missing keys at the rate limit, sums past 2^63, pruning."""

import datetime as dt

from pyspark.sql import functions as F

from crashlens.operators.guards import rate_limit
from crashlens.operators.rollup import hour_window
from crashlens.plans.hardware import _avg_gb
from crashlens.sources.reports import read_reports, replay_fallback
from crashlens.streaming.ingest import dedup_stream

NOW = dt.datetime(2024, 1, 30, 12, 0, 5)
RAW = "request_id string, body string, signature string, client_ip string, arrived_at timestamp"


def _admitted(df, **kw):
    return df.transform(rate_limit, limit=2, **kw).where("not rate_limited").count()


def test_rate_limit_counts_equal_and_missing_keys(spark):
    cases = {"null id": (None, NOW), "same id": ("a", NOW), "null time": ("a", None)}
    for rid, at in cases.values():
        df = spark.createDataFrame([(rid, "{}", None, "1.1.1.1", at)] * 10, RAW)
        assert _admitted(df) == 2
        prior = df.groupBy(F.col("client_ip").alias("client_key"), F.date_trunc("minute", "arrived_at").alias("minute")).agg(F.lit(1).alias("admitted"))
        assert _admitted(df, prior=prior) == 1
        assert _admitted(df, prior=prior.withColumn("admitted", F.lit(5))) == 0


def test_bodies_have_ids_of_their_own(spark, tmp_path):
    (tmp_path / "x.txt").write_text("{}\n" * 10)
    df = read_reports(spark, str(tmp_path / "x.txt"), "bodies")
    assert df.select("request_id").distinct().count() == 10 and _admitted(df) == 2


def test_malformed_line_keeps_its_text(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"request_id":"1","body":"{}"}\n{"request_id": broken\n')
    rows = {r.request_id: r.body for r in read_reports(spark, str(tmp_path / "x.json")).collect()}
    assert rows == {"1": "{}", None: '{"request_id": broken'}


def test_replay_ids_tell_clients_apart(spark):
    rows = [("t", "e", None, "app", "v", c) for c in ("1.1.1.1", "2.2.2.2")] + [("t", None, "e", "app", "v", "1.1.1.1")]
    df = spark.createDataFrame(rows, "timestamp string, error string, stack string, app_name string, app_version string, client_ip string")
    assert replay_fallback(df, platform="linux").select("request_id").distinct().count() == 3


def test_byte_sum_past_2_63(spark):
    df = spark.createDataFrame([(2**62,)] * 8, "x long")
    assert df.agg(_avg_gb("x").alias("g")).first().g == round(2**62 / 1e9, 1)


def test_stored_rollup_is_pruned(spark, tmp_path):
    rows = spark.range(240).select(F.expr("timestamp'2024-01-20' + make_interval(0,0,0,0,cast(id as int),0,0)").alias("hour"))
    rows.withColumn("hour_date", F.to_date("hour")).write.partitionBy("hour_date").parquet(str(tmp_path / "r"))
    out = hour_window(spark.read.parquet(str(tmp_path / "r")), "2024-01-29T12:00:00Z", hours=24)
    assert out.count() == 35
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour_date" in plan


def test_late_unique_ids_pass_dedup(spark, tmp_path):
    for batch in range(4):  # old rows last
        rows = [(f"{batch}-{i % 20}", "{}", None, "1.1.1.1", NOW - dt.timedelta(days=40 * (batch == 3))) for i in range(25)]
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (dedup_stream(stream).select("request_id").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80


def test_hardware_numbers_sent_as_text(spark):
    from crashlens.functions.hardware import hw_bigint, hw_int, with_hardware

    texts = ['{"cpu":{"cores":"8","name":"x"},"memory":{"total":"16000000000"}}', '{"cpu":{"cores":8.9},"memory":{"total":1.6e10}}',
             '{"cpu":{"cores":"many"},"memory":{"total":true}}', "{}", None, "not json"]
    df = with_hardware(spark.createDataFrame([(t,) for t in texts], "hardware_specs string"))
    got = [tuple(r) for r in df.select(hw_int("cpu.cores"), hw_bigint("memory.total"), "hw.cpu.name", F.col("hw.gpu").isNull()).collect()]
    assert got == [(8, 16_000_000_000, "x", True), (8, 16_000_000_000, None, True), *[(None, None, None, True)] * 4]


def test_dates_in_the_form_of_headers(spark):
    from crashlens.operators.validate import parse_body, parsed_crash_time

    forms = {"Tue, 02 Jan 2024 10:00:00 GMT": True, "2 Jan 2024 10:00:00 UTC": True, "Tuesday, 02 Jan 2024 10:00:00 GMT": True,
             "2024-01-02T10:00:00Z": True, "Tue, 02 Foo 2024 10:00:00 GMT": False, "Tue": False, "10:00:00": False}
    rows = [(f'{{"crash_timestamp":"{f}"}}',) for f in forms]
    df = parse_body(spark.createDataFrame(rows, "body string")).select("in_crash_timestamp", parsed_crash_time().alias("t"))
    got = {r.in_crash_timestamp: r.t for r in df.collect()}
    assert got == {f: dt.datetime(2024, 1, 2, 10) if ok else None for f, ok in forms.items()}
