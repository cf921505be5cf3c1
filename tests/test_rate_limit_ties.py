"""The rate limit decides alike however its input is laid out, and counts equal rows one by one."""

import random

import pytest
from pyspark.sql import functions as F

from crashlens.operators import rate_limit

SCHEMA = "request_id string, body string, client_ip string, arrived_at timestamp"
AT = "2024-01-02 10:00:05"


def frame(spark, rows):
    return spark.createDataFrame(rows, "request_id string, body string, client_ip string, at string").select(
        "request_id", "body", "client_ip", F.to_timestamp("at").alias("arrived_at"))


def admitted(df, **options):
    out = rate_limit(df, **options)
    assert out.columns == [*df.columns, "rate_limited", "retry_after"]
    return out.where(~F.col("rate_limited")).count(), out.count()


@pytest.mark.parametrize("ids", ["null", "equal", "unique"])
@pytest.mark.parametrize("bodies", ["equal", "different"])
@pytest.mark.parametrize("limit", [1, 20, 199, 200, 201])
def test_one_instant_behind_a_join(spark, ids, bodies, limit):
    name = {"null": lambda i: None, "equal": lambda i: "r", "unique": str}[ids]
    rows = [(name(i), str(i) if bodies == "different" else "b", "10.0.0.1", AT) for i in range(200)]
    known = spark.createDataFrame([("10.0.0.1",)], "client_ip string")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256")
    try:
        df = frame(spark, rows).repartition(13, "body", "request_id").join(known.hint("merge"), "client_ip")
        assert admitted(df, limit=limit) == (min(limit, 200), 200)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.mark.parametrize("seed", range(4))
def test_any_layout_equals_counting(spark, seed):
    """Random ties over clients, minutes, NULLs and earlier admissions: admitted = min(places left, requests)."""
    r = random.Random(seed)
    rows = [(r.choice([None, "a", "b", str(r.random())]), r.choice("xyz"), r.choice(["c1", "c2", None]),
             f"2024-01-02 10:0{r.randrange(2)}:0{r.randrange(3)}") for _ in range(160)]
    prior = [("c1", "2024-01-02 10:00:00", 3), ("c2", "2024-01-02 10:01:00", 9), ("unknown", "2024-01-02 10:01:00", 2)]
    used = {(c, m): n for c, m, n in prior}
    limit, want = 9, {}
    for _, _, c, at in rows:
        k = (c or "unknown", at[:16] + ":00")
        want[k] = want.get(k, 0) + 1
    want = {k: min(n, limit - used.get(k, 0)) for k, n in want.items()}
    table = spark.createDataFrame(prior, "client_key string, minute string, admitted long").withColumn(
        "minute", F.to_timestamp("minute"))
    df = frame(spark, rows).repartition(1 + 3 * seed)
    out = rate_limit(df, limit=limit, prior=table)
    got = {(c or "unknown", str(m)): n for c, m, n in out.where(~F.col("rate_limited")).groupBy(
        "client_ip", F.date_trunc("minute", "arrived_at")).count().collect()}
    assert got == {k: n for k, n in want.items() if n}
    assert out.select(df.columns).exceptAll(df).count() == 0 and out.count() == len(rows)
    # an earlier request is never limited while a later one of its group passes
    span = out.groupBy("client_ip", F.date_trunc("minute", "arrived_at")).agg(
        F.max(F.when(~F.col("rate_limited"), F.col("arrived_at"))).alias("last"),
        F.min(F.when(F.col("rate_limited"), F.col("arrived_at"))).alias("first"))
    assert span.where("last > first").count() == 0


def test_no_ties_plan_reads_ordering_columns_only_for_the_cut(spark):
    df = frame(spark, [(str(i), "b", "c", AT) for i in range(9)])
    plan = rate_limit(df, limit=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "monotonically" not in plan
