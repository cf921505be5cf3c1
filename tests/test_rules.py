"""Admission edge rows: both sides of every bound, guard order, sanitiser."""

import datetime as dt
import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from crashlens.functions.crypto import hmac_sha256_hex, signature_ok
from crashlens.functions.text import sanitize
from crashlens.operators import admit, split
from crashlens.schema import RAW_SCHEMA

SECRET = "s3cret"
NOW = dt.datetime(2024, 1, 30, 12, 0, 0)


def sign(body: str, prefix: bool = True) -> str:
    h = hmac.new(SECRET.encode(), body.encode(), hashlib.sha256).hexdigest()
    return f"sha256={h}" if prefix else h


def report(**over):
    base = {"app_name": "demo", "app_version": "v1.0.0", "platform": "linux",
            "crash_timestamp": (NOW - dt.timedelta(hours=1)).isoformat() + "Z",
            "error_message": "TypeError: boom", "stack_trace": "at main.js:1",
            "hardware_specs": {"cpu": {"cores": 8}, "memory": {"total": 8e9}},
            "user_id": "u1", "session_id": "s1"}
    for k, v in over.items():
        if v is ...:
            base.pop(k, None)
        else:
            base[k] = v
    return base


CASES = {
    # name: (body or dict, signature override, expected status, expected reason)
    "valid": (report(), None, 200, "accepted"),
    "name_99": (report(app_name="a" * 99), None, 200, "accepted"),
    "name_100": (report(app_name="a" * 100), None, 500, "insert_rejected"),
    "name_101": (report(app_name="a" * 101), None, 400, "invalid_crash_data"),
    "err_4999": (report(error_message="e" * 4999), None, 200, "accepted"),
    "err_5000": (report(error_message="e" * 5000), None, 500, "insert_rejected"),
    "err_5001": (report(error_message="e" * 5001), None, 400, "invalid_crash_data"),
    "stack_19999": (report(stack_trace="s" * 19999), None, 200, "accepted"),
    # validated at 20000, then cut to 10000 before the table's < 20000 check
    "stack_20000": (report(stack_trace="s" * 20000), None, 200, "accepted"),
    "stack_20001": (report(stack_trace="s" * 20001), None, 400, "invalid_crash_data"),
    "age_24h": (report(crash_timestamp=(NOW - dt.timedelta(hours=24)).isoformat() + "Z"),
                None, 200, "accepted"),
    "age_24h_1ms": (report(crash_timestamp=(NOW - dt.timedelta(hours=24, milliseconds=1))
                           .isoformat() + "Z"), None, 400, "invalid_crash_data"),
    "future": (report(crash_timestamp=(NOW + dt.timedelta(seconds=1)).isoformat() + "Z"),
               None, 400, "invalid_crash_data"),
    "bad_time": (report(crash_timestamp="yesterday"), None, 400, "invalid_crash_data"),
    "upper_platform": (report(platform="Linux"), None, 200, "accepted"),
    "bad_platform": (report(platform="beos"), None, 400, "invalid_crash_data"),
    "short_version": (report(app_version="v1.2"), None, 400, "invalid_crash_data"),
    "beta_version": (report(app_version="v1.2.3-beta"), None, 200, "accepted"),
    "number_version": (report(app_version=123), None, 400, "invalid_crash_data"),
    "empty_name": (report(app_name=""), None, 400, "invalid_crash_data"),
    "missing_time": (report(crash_timestamp=...), None, 400, "invalid_crash_data"),
    "missing_name": (report(app_name=...), None, 400, "invalid_crash_data"),
    "missing_version": (report(app_version=...), None, 400, "invalid_crash_data"),
    "missing_platform": (report(platform=...), None, 400, "invalid_crash_data"),
    "null_platform": (report(platform=None), None, 400, "invalid_crash_data"),
    "number_error": (report(error_message=42), None, 400, "invalid_crash_data"),
    "zero_error": (report(error_message=0), None, 200, "accepted"),
    "empty_error": (report(error_message=""), None, 200, "accepted"),
    "no_hardware": (report(hardware_specs=...), None, 200, "accepted"),
    "bad_json": ('{"app_name": "demo",', None, 400, "invalid_json"),
    "bad_signature": (report(), "sha256=" + "0" * 64, 401, "invalid_signature"),
    "no_signature": (report(), "", 401, "invalid_signature"),
    "bare_hex_upper": (report(), "UPPER", 200, "accepted"),
    "too_large": (report(stack_trace="x" * 50_001), None, 413, "payload_too_large"),
    "dirty_text": (report(error_message="  <b>bad</b>\x00\tthing  ",
                          user_id="　user "), None, 200, "accepted"),
}


@pytest.fixture(scope="module")
def admitted(spark):
    rows = []
    for i, (name, (payload, sig, _, _)) in enumerate(CASES.items()):
        body = payload if isinstance(payload, str) else json.dumps(payload)
        if sig is None:
            signature = sign(body)
        elif sig == "UPPER":
            signature = sign(body, prefix=False).upper()
        else:
            signature = sig or None
        rows.append((name, body, signature, f"10.0.0.{i}", NOW))
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    return admit(raw, secret=SECRET).cache()


@pytest.mark.parametrize("name", list(CASES))
def test_admission_outcome(admitted, name):
    row = admitted.where(F.col("request_id") == name).select("status", "reason").first()
    _, _, status, reason = CASES[name]
    assert (row.status, row.reason) == (status, reason)


def test_errors_list_all_violations(spark):
    body = json.dumps(report(app_name="", app_version="1.0", platform="beos"))
    raw = spark.createDataFrame([("x", body, sign(body), "1.1.1.1", NOW)], RAW_SCHEMA)
    errs = admit(raw, secret=SECRET).first().errors
    assert len(errs) == 3 and any("app_name" in e for e in errs)


def test_sanitised_columns(admitted):
    acc, quarantine = split(admitted)
    dirty = acc.where(F.col("id") == "dirty_text").first()
    assert dirty.error_message == "bbad/bthing"
    assert dirty.user_id == "user"
    assert acc.where(F.col("id") == "empty_error").first().error_message is None
    assert acc.where(F.col("id") == "no_hardware").first().hardware_specs == "{}"
    assert acc.where(F.col("id") == "upper_platform").first().platform == "linux"
    assert quarantine.count() + acc.count() == len(CASES)


def test_hmac_matches_python(spark):
    rnd = random.Random(7)
    bodies = ["", "a", "é ünïcødé 🚀", "x" * 1000] + [
        "".join(chr(rnd.randrange(32, 0x2FFF)) for _ in range(rnd.randrange(1, 300)))
        for _ in range(20)]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [r.h for r in df.select(hmac_sha256_hex(F.col("body"), SECRET).alias("h")).collect()]
    assert got == [sign(b, prefix=False) for b in bodies]
    long_key = "k" * 100
    want = hmac.new(long_key.encode(), b"abc", hashlib.sha256).hexdigest()
    row = spark.range(1).select(
        hmac_sha256_hex(F.lit("abc"), long_key).alias("h"),
        signature_ok(F.lit("abc"), F.lit("sha256=" + want), long_key).alias("ok")).first()
    assert row.h == want and row.ok


# white space a JavaScript String.trim() removes (after control characters are gone)
JS_SPACE = (" \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
            + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_sanitize(s):
    if s is None:
        return None
    s = re.sub(r"[\x00-\x1f\x7f]", "", s)
    s = re.sub(r"[<>]", "", s)
    s = s.strip(JS_SPACE)
    return s[:10000]


def test_sanitize_matches_brute_force(spark):
    rnd = random.Random(3)
    alphabet = list("ab <>\t\n\r\x00\x1f\x7f") + list(JS_SPACE) + ["é", "\u0085"]
    texts = [None, "", "  ", "x" * 12000] + [
        "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(sanitize(F.col("t")).alias("s")).collect()]
    assert got == [js_sanitize(t) for t in texts]


def test_insert_policy_window(spark):
    """The policy window (now-24h, now] is exclusive below, unlike V10."""
    cases = {"exact_24h": (NOW - dt.timedelta(hours=24), 500),
             "inside": (NOW - dt.timedelta(hours=23, minutes=59), 200)}
    rows = []
    for name, (t, _) in cases.items():
        body = json.dumps(report(crash_timestamp=t.isoformat() + "Z"))
        rows.append((name, body, sign(body), "10.1.1.1", NOW))
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    got = {r.request_id: r.status for r in admit(raw, secret=SECRET, policy=True).collect()}
    assert got == {k: v for k, (_, v) in cases.items()}
    plain = {r.request_id: r.status for r in admit(raw, secret=SECRET).collect()}
    assert plain == {"exact_24h": 200, "inside": 200}


def test_retry_after_and_order_of_stages(spark):
    """A rate-limited request reports 429 even when its body is also bad."""
    body = '{"broken": '
    rows = [(f"r{i}", body, "sha256=00", "9.9.9.9", NOW + dt.timedelta(seconds=i))
            for i in range(3)]
    out = admit(spark.createDataFrame(rows, RAW_SCHEMA), secret=SECRET,
                limit_per_minute=2).orderBy("request_id").collect()
    assert [r.status for r in out] == [401, 401, 429]
    assert out[2].retry_after == 60 - 2 and out[2].errors == []
