"""X6 with expiring state per client and minute: late rows, hot clients, shrinking state."""

import datetime as dt
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crashlens.operators import rate_limit
from crashlens.schema import RAW_SCHEMA
from crashlens.streaming import rate_limit_minutes, use_rocksdb
from crashlens.streaming.minute_limiter import BUCKETS, POOL_ROWS, partial_top

T0 = dt.datetime(2024, 1, 1, 12)
NAMES = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.shuffle.partitions")


@pytest.fixture
def store(spark):
    before = {n: spark.conf.get(n, None) for n in NAMES}
    use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def run(spark, folder, out, **kw):
    stream = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = (rate_limit_minutes(stream, **kw).writeStream.format("parquet").option("path", f"{out}/rows")
         .option("checkpointLocation", f"{out}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]


def put(spark, folder, rows):
    spark.createDataFrame(rows, RAW_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_counts_carry_over_and_late_rows_are_decided(spark, store, tmp_path):
    """A hot client over several files, the first minute's rows again in the last file."""
    hot = [(f"h{i:03d}", "{}", None, "6.6.6.6", T0 + dt.timedelta(seconds=i)) for i in range(120)]
    odd = [(None, "{}", None, None, T0), (None, "{}", None, None, T0), ("n", "{}", None, "c", None)]
    late = [(f"l{i}", "{}", None, "6.6.6.6", T0 + dt.timedelta(seconds=30)) for i in range(8)]
    late += [(f"m{i}", "{}", None, "c2", T0 - dt.timedelta(days=400)) for i in range(8)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (hot[:60] + odd, hot[60:], late):
        put(spark, folder, part)
    run(spark, folder, out, limit=5)
    got = spark.read.parquet(f"{out}/rows")
    assert got.count() == len(hot + odd + late)
    passed = {r.request_id for r in got.where("not rate_limited").collect()}
    assert passed == {f"h{i:03d}" for i in (*range(5), *range(60, 65))} | {None, "n"} | {f"m{i}" for i in range(5)}
    batch = rate_limit(spark.createDataFrame(hot + odd, RAW_SCHEMA), limit=5).where("not rate_limited")
    assert {r.request_id for r in batch.collect()} == passed - {f"m{i}" for i in range(5)}
    retry = got.where("rate_limited").select((F.col("retry_after") + F.second("arrived_at")).alias("s")).distinct().collect()
    assert [r.s for r in retry] == [60]


def test_state_expires(spark, store, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for step in range(3):
        put(spark, folder, [(f"{step}-{i}", "{}", None, f"c{step}-{i}", T0) for i in range(40)])
        rows = run(spark, folder, out, limit=5, lifetime_minutes=1 / 60)
        time.sleep(2)
    put(spark, folder, [("last", "{}", None, "c", T0)])
    rows = run(spark, folder, out, limit=5, lifetime_minutes=1 / 60)
    assert rows[-1] < 40  # of 121 clients and minutes


def test_a_task_sends_at_most_its_first_requests_on():
    """Rows of one partition in many batches: ``limit`` per client and minute keep the state's key."""
    rows = pd.DataFrame({"request_id": [f"r{i:04d}" for i in range(3000)], "body": "b", "signature": None, "client_ip": "c",
                         "arrived_at": [T0 + dt.timedelta(milliseconds=40 * (2999 - i)) for i in range(3000)]})
    out = pd.concat(list(partial_top(7)(rows.iloc[i:i + 100] for i in range(0, 3000, 100))))
    assert len(out) == 3000 and set(out.request_id) == set(rows.request_id)
    kept = out[out._salt == 0]
    assert kept.groupby("_minute").size().tolist() == [7, 7]
    assert out[out._salt > 0].groupby(["_minute", "_salt"]).size().max() <= 60


def test_many_clients_and_minutes_share_a_state_row(spark, store, tmp_path):
    """A state row holds a bucket of clients and minutes; each of them still has its own places."""
    first = [(f"a{c}-{m}-{i}", "{}", None, f"c{c}", T0 + dt.timedelta(minutes=m, seconds=i)) for c in range(100) for m in range(3) for i in range(2)]
    second = [(f"b{c}-{m}-{i}", "{}", None, f"c{c}", T0 + dt.timedelta(minutes=m, seconds=9 + i)) for c in range(100) for m in range(4) for i in range(2)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (first, second):
        put(spark, folder, part)
    states = run(spark, folder, out, limit=3)
    got = spark.read.parquet(f"{out}/rows")
    assert got.count() == len(first + second)
    limited = {r.request_id for r in got.where("rate_limited").collect()}
    assert limited == {f"b{c}-{m}-1" for c in range(100) for m in range(3)}
    assert max(states) <= BUCKETS  # for 400 clients and minutes


def test_a_task_ranks_a_bounded_number_of_rows_at_once():
    taken = 0

    def batches():
        nonlocal taken
        for i in range(0, 3 * POOL_ROWS, 10_000):
            taken += 10_000
            yield pd.DataFrame({"request_id": [f"r{k}" for k in range(i, i + 10_000)], "body": "b", "signature": None,
                                "client_ip": "c", "arrived_at": [T0] * 10_000})

    parts = partial_top(7)(batches())
    next(parts)
    assert taken <= POOL_ROWS + 10_000
    list(parts)
