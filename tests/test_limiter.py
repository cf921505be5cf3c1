"""Exact limiter under a hot client, batch and stream, vs brute force."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crashlens.operators import rate_limit
from crashlens.schema import RAW_SCHEMA
from crashlens.streaming import rate_limit_stream

LIMIT = 5


def skewed_rows(n_hot=400, n_cold=300, seed=11):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = []
    for i in range(n_hot):  # one client holds most rows, spread over 3 minutes
        ts = t0 + dt.timedelta(seconds=rnd.randrange(0, 180), microseconds=rnd.randrange(0, 3))
        rows.append((f"h{i:04d}", "{}", None, "6.6.6.6", ts))
    for i in range(n_cold):
        ts = t0 + dt.timedelta(seconds=rnd.randrange(0, 600))
        rows.append((f"c{i:04d}", "{}", None, f"10.0.0.{rnd.randrange(40)}", ts))
    return rows


def brute_force(rows):
    pdf = pd.DataFrame(rows, columns=["request_id", "body", "signature", "client_ip", "arrived_at"])
    pdf["minute"] = pdf["arrived_at"].dt.floor("min")
    pdf = pdf.sort_values(["arrived_at", "request_id"])
    pdf["rank"] = pdf.groupby(["client_ip", "minute"]).cumcount()
    return set(pdf.loc[pdf["rank"] >= LIMIT, "request_id"])


def test_batch_limiter_exact_under_skew(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, RAW_SCHEMA).repartition(7)
    out = rate_limit(df, limit=LIMIT)
    got = {r.request_id for r in out.where("rate_limited").select("request_id").collect()}
    assert got == brute_force(rows)
    retry = out.where("rate_limited").select(
        (F.col("retry_after") + F.second("arrived_at")).alias("s")).distinct().collect()
    assert {r.s for r in retry} == {60}


def test_batch_limiter_plan_has_partial_topk(spark):
    df = spark.createDataFrame(skewed_rows(10, 10), RAW_SCHEMA)
    plan = rate_limit(df, limit=LIMIT)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_stream_limiter_equals_batch(spark, tmp_path):
    rows = skewed_rows()
    src = str(tmp_path / "landing")
    spark.createDataFrame(rows, RAW_SCHEMA).write.parquet(src)
    stream = spark.readStream.schema(RAW_SCHEMA).parquet(src)
    q = (rate_limit_stream(stream, limit=LIMIT).writeStream.format("memory")
         .queryName("limiter_out").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.awaitTermination()
    got = {r.request_id for r in spark.sql(
        "SELECT request_id FROM limiter_out WHERE rate_limited").collect()}
    assert spark.sql("SELECT count(*) AS n FROM limiter_out").first().n == len(rows)
    assert got == brute_force(rows)


@pytest.mark.parametrize("limiter", ["ledger", "state"])
def test_stream_limiter_across_micro_batches(spark, tmp_path, limiter):
    """Groups span micro-batches: counts must carry over from batch to batch."""
    from crashlens.operators import admit
    from crashlens.streaming import read_ingested, read_report_stream, start_ingest

    rows = sorted(skewed_rows(300, 200, seed=5), key=lambda r: (r[4], r[0]))
    land = tmp_path / "landing"
    for i in range(4):  # four files in time order, one micro-batch each
        part = rows[i * len(rows) // 4:(i + 1) * len(rows) // 4]
        spark.createDataFrame(part, RAW_SCHEMA).coalesce(1).write.mode("append").parquet(
            str(land))
    stream = read_report_stream(spark, str(land), max_files_per_trigger=1)
    q = start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), secret=None,
                     check_signature=False, limit_per_minute=LIMIT, limiter=limiter)
    q.awaitTermination()
    assert len(q.recentProgress) >= 4
    _, quarantine = read_ingested(spark, str(tmp_path / "out"))
    got = {r.request_id for r in quarantine.where(F.col("status") == 429).collect()}
    assert got == brute_force(rows)
    batch = admit(spark.createDataFrame(rows, RAW_SCHEMA), secret=None,
                  check_signature=False, limit_per_minute=LIMIT)
    assert got == {r.request_id for r in batch.where("status = 429").collect()}
