"""Property tests against brute force (hypothesis): sanitiser, rate limiter,
exact HALF_UP rounding."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crashlens.functions.numeric import avg_scaled_half_up, round_ratio
from crashlens.functions.text import sanitize
from crashlens.operators import rate_limit
from crashlens.schema import RAW_SCHEMA
from tests.test_rules import js_sanitize

# control characters, brackets, JS white space and U+200B / U+0085, which JS does not trim
ALPHABET = st.sampled_from(list("ab <>\t\n\x00\x1f\x7f\u00e9\u0085\u00a0\u1680\u2000\u200a"
                                "\u2028\u2029\u202f\u205f\u3000\ufeff\u200b"))
SETTINGS = settings(max_examples=25, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=30)), min_size=1, max_size=40))
def test_sanitize_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(sanitize(F.col("t")).alias("s")).collect()]
    assert got == [js_sanitize(t) for t in texts]


T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 150), st.integers(0, 2)),
                min_size=1, max_size=80),
       st.integers(1, 4))
def test_rate_limit_property(spark, reqs, limit):
    rows = [(f"r{i:03d}", "{}", None, f"ip{c}", T0 + dt.timedelta(seconds=s, microseconds=u))
            for i, (c, s, u) in enumerate(reqs)]
    got = {r.request_id for r in rate_limit(spark.createDataFrame(rows, RAW_SCHEMA), limit=limit)
           .where("rate_limited").collect()}
    pdf = pd.DataFrame(rows, columns=["request_id", "body", "signature", "client_ip", "arrived_at"])
    pdf = pdf.sort_values(["arrived_at", "request_id"])
    rank = pdf.groupby(["client_ip", pdf["arrived_at"].dt.floor("min")]).cumcount()
    assert got == set(pdf.loc[rank >= limit, "request_id"])


def half_up(num, den, digits, scale=1):
    if den == 0:
        return None
    q = Decimal(num) * scale / Decimal(den)
    return float(q.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10**15), st.integers(0, 10**6)), min_size=1, max_size=60),
       st.integers(0, 6))
def test_round_ratio_is_exact_half_up(spark, pairs, digits):
    # include exact ties (x.5 at the last digit) on purpose
    pairs = pairs + [(2 * 10**digits + 1, 2 * 10**digits), (5, 2 * 10**(digits + 1))]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r.r for r in df.select(round_ratio(F.col("n"), F.col("d"), digits).alias("r")).collect()]
    assert got == [half_up(n, d, digits) for n, d in pairs]
    pct = [r.r for r in df.select(round_ratio(F.col("n"), F.col("d"), 2, scale=100).alias("r")).collect()]
    assert pct == [half_up(n, d, 2, 100) for n, d in pairs]


@SETTINGS
@given(st.lists(st.integers(0, 64 * 10**9), min_size=1, max_size=50))
def test_avg_gb_matches_decimal(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    got = df.agg(avg_scaled_half_up(F.sum("x"), F.count("x"), 10**9, 1).alias("g")).first().g
    assert got == half_up(sum(values), len(values) * 10**9, 1)
