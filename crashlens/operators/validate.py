"""Body parsing (G4), content rules V1–V12 and table checks C1–C8.

The body is parsed once into a VARIANT; each field is read with its JSON
type so type errors (a number where text is required) are rule violations,
as they are for the service, instead of silent casts.  All rules are
column expressions evaluated in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.functions.time import as_timestamp, ts_literal
from crashlens.schema import (
    APP_NAME_MAX, ERROR_MESSAGE_MAX, MAX_AGE_HOURS, PLATFORMS, RULE_MESSAGES,
    STACK_TRACE_MAX, VERSION_PATTERN,
)

FIELDS = ["app_name", "app_version", "platform", "crash_timestamp",
          "error_message", "stack_trace", "hardware_specs", "user_id", "session_id"]
NUMERIC = ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"]
BODY_VARIANTS = "struct<" + ", ".join(f"{f}: variant" for f in FIELDS) + ">"


def _v(f: str) -> Column:
    """Parsed text value of body field ``f``."""
    return F.col(f"in_{f}")


def _t(f: str) -> Column:
    """JSON type name of body field ``f`` (NULL when absent)."""
    return F.col(f"in_{f}__t")


def parse_body(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``doc`` (VARIANT, NULL when the body is not JSON) and, per field,
    ``in_<f>`` (text value) and ``in_<f>__t`` (JSON type name).

    The object is read once into a struct of nine VARIANT fields (one key
    lookup pass instead of one per field and use); a body that is JSON but
    not an object gives NULL fields, so the presence rules reject it.
    """
    out = df.withColumn("doc", F.try_parse_json(F.col(body)))
    out = out.withColumn("_body", F.try_variant_get(F.col("doc"), "$", BODY_VARIANTS))
    cols = []
    for f in FIELDS:
        v = F.col(f"_body.{f}")
        cols.append(F.schema_of_variant(v).alias(f"in_{f}__t"))
        if f == "hardware_specs":
            cols.append(F.to_json(v).alias(f"in_{f}__json"))
        cols.append(v.try_cast("string").alias(f"in_{f}"))
    return out.select(*[c for c in out.columns if c != "_body"], *cols)


def _is_str(f: str) -> Column:
    """Field present and a JSON string (never NULL: a missing field is False)."""
    return F.coalesce(_t(f) == "STRING", F.lit(False))


def truthy(f: str) -> Column:
    """JavaScript truthiness of a parsed JSON field."""
    t, v = _t(f), _v(f)
    return (F.when(t.isNull() | (t == "VOID"), False)
             .when(t == "STRING", v != "")
             .when(t == "BOOLEAN", v == "true")
             .when(t.startswith("DECIMAL") | t.isin(*NUMERIC), v.cast("double") != 0)
             .otherwise(True))


def parsed_crash_time(f: str = "crash_timestamp") -> Column:
    """Crash time as a UTC instant at millisecond precision (text: ISO-8601, or
    ``Tue, 02 Jan 2024 10:00:00 GMT`` with or without the weekday; number: epoch milliseconds), NULL when it does not parse."""
    t, v = _t(f), _v(f)
    bare = F.regexp_replace(v, r"^\s*[A-Za-z]{3,9},?\s+(?=\d)", "")
    named = F.when(bare.rlike(r"^\s*\d{1,2} [A-Za-z]{3} \d{4} "), F.try_to_timestamp(F.trim(bare), F.lit("d MMM yyyy HH:mm:ss z")))
    text = F.when(v.rlike(r"^\s*\d{4}"), F.try_to_timestamp(v)).otherwise(named)  # a time of day alone has no date
    millis = F.timestamp_millis(F.floor(v.cast("double")).cast("bigint"))
    out = (F.when(t == "STRING", text)
            .when(t.startswith("DECIMAL") | t.isin(*NUMERIC), millis))
    return F.date_trunc("MILLISECOND", out)


def _now(as_of) -> Column:
    if as_of is None:
        return F.date_trunc("MILLISECOND", F.col("arrived_at"))
    return ts_literal(as_timestamp(as_of), T.TimestampType())


def rule_violations(as_of=None, max_age_hours: float = MAX_AGE_HOURS) -> Column:
    """Array of V1–V12 messages for a parsed row (empty when valid).

    ``as_of=None`` judges each row against its own ``arrived_at``, which is
    what the service's clock was when the request came in.
    """
    m = RULE_MESSAGES
    now = _now(as_of)
    crash = parsed_crash_time()
    age_us = F.unix_micros(now) - F.unix_micros(crash)
    max_us = F.lit(int(max_age_hours * 3600 * 1_000_000))
    checks = [
        ("V1", ~(_is_str("app_name") & (_v("app_name") != ""))),
        ("V2", ~(_is_str("app_version") & (_v("app_version") != ""))),
        ("V3", ~(_is_str("platform") & (_v("platform") != ""))),
        ("V4", ~truthy("crash_timestamp")),
        ("V5", _is_str("app_name") & (F.length(_v("app_name")) > APP_NAME_MAX)),
        ("V6", _is_str("app_version") & (_v("app_version") != "")
               & ~_v("app_version").rlike(VERSION_PATTERN)),
        ("V7", _is_str("platform") & (_v("platform") != "")
               & ~F.lower(_v("platform")).isin(*PLATFORMS)),
        ("V8", truthy("crash_timestamp") & crash.isNull()),
        ("V9", truthy("crash_timestamp") & (crash > now)),
        ("V10", truthy("crash_timestamp") & (crash <= now) & (age_us > max_us)),
        ("V11", truthy("error_message") & ~(_is_str("error_message")
                & (F.length(_v("error_message")) <= ERROR_MESSAGE_MAX))),
        ("V12", truthy("stack_trace") & ~(_is_str("stack_trace")
                & (F.length(_v("stack_trace")) <= STACK_TRACE_MAX))),
    ]
    return F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.lit(m[rule])) for rule, cond in checks]))


def validate_reports(df: DataFrame, as_of=None,
                     max_age_hours: float = MAX_AGE_HOURS) -> DataFrame:
    """Parse bodies and add ``json_ok`` (G4) and ``errors``."""
    parsed = df if "doc" in df.columns else parse_body(df)
    return (parsed.withColumn("json_ok", F.col("doc").isNotNull())
                  .withColumn("errors", rule_violations(as_of, max_age_hours)))


def table_ok(policy: bool = False, as_of=None) -> Column:
    """C1–C6 (and with ``policy`` C7/C8) on sanitised columns.

    A CHECK passes when its predicate is TRUE or NULL; NOT NULL columns and
    the insert policy need TRUE.  Bounds are strict: the table refuses the
    100 / 5000 / 20000-character values that the validator lets through.
    """
    name, ver = F.col("app_name"), F.col("app_version")
    err, stack, plat = F.col("error_message"), F.col("stack_trace"), F.col("platform")

    def check(p):
        return F.coalesce(p, F.lit(True))

    ok = (check((F.length(name) > 0) & (F.length(name) < APP_NAME_MAX))
          & check(ver.rlike(VERSION_PATTERN))
          & check(F.length(err) < ERROR_MESSAGE_MAX)
          & check(F.length(stack) < STACK_TRACE_MAX)
          & check(plat.isin(*PLATFORMS))
          & name.isNotNull() & ver.isNotNull() & plat.isNotNull()
          & F.col("crash_timestamp").isNotNull())
    if policy:
        now = _now(as_of)
        ct = F.col("crash_timestamp")
        pol = ((ct > now - F.expr("INTERVAL 24 HOURS")) & (ct <= now)
               & (F.length(name) > 0) & ver.rlike(VERSION_PATTERN) & plat.isin(*PLATFORMS)
               & (err.isNull() | (F.length(err) < ERROR_MESSAGE_MAX))
               & (stack.isNull() | (F.length(stack) < STACK_TRACE_MAX)))
        ok = ok & F.coalesce(pol, F.lit(False))
    return F.coalesce(ok, F.lit(False))


def check_table(df: DataFrame, policy: bool = False, as_of=None) -> DataFrame:
    """Add ``table_ok``: would the row be stored (C1–C6, C7/C8 policy)?"""
    return df.withColumn("table_ok", table_ok(policy, as_of))

