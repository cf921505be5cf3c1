"""Dirty envelopes derived from ``events``: every refusal path of admission, on both sides of its bound.

Of each 400 consecutive event ids the first 40 are mutated, each in its own way (``KINDS``); the rest stay
clean.  Reports arrive an hour after the crash unless the kind is about their age.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.functions.crypto import hmac_sha256_hex
from crashlens.schema import (
    APP_NAME_MAX, ERROR_MESSAGE_MAX, MAX_PAYLOAD_CHARS, RULE_MESSAGES, STACK_TRACE_MAX,
)
from crashlens.session import prepare
from crashlens.sources.fixture import FIXTURE_SECRET, derive_crash_reports, materialized, read_events

PERIOD = 400
ACCEPTED = (200, "accepted", ())
REJECTED = (500, "insert_rejected", ())


def _invalid(*rules: str):
    return 400, "invalid_crash_data", rules


#: kind -> (status, reason, broken rules); what each kind changes is in ``derive_dirty_envelopes``.
KINDS = {
    0: ACCEPTED,                                       # clean
    1: ACCEPTED, 2: (413, "payload_too_large", ()),    # body of the greatest length, one more
    3: (401, "invalid_signature", ()),                 # signed with another secret
    4: (401, "invalid_signature", ()),                 # not signed
    5: ACCEPTED,                                       # signature without its prefix
    6: (400, "invalid_json", ()),                      # cut off
    7: _invalid("V1", "V2", "V3", "V4"),               # JSON, but an array
    8: _invalid("V1"), 9: _invalid("V1"), 10: _invalid("V1"),  # app_name missing, a number, empty
    11: _invalid("V2"), 12: _invalid("V3"), 13: _invalid("V4"),  # version, platform, time missing
    14: REJECTED, 15: _invalid("V5"), 16: ACCEPTED,    # app_name of 100, 101 and 99 characters
    17: _invalid("V6"), 18: ACCEPTED,                  # v1.2, v1.2.3-beta
    19: _invalid("V7"), 20: ACCEPTED,                  # unknown platform, upper-case platform
    21: _invalid("V8"),                                # not a date
    22: _invalid("V9"), 23: ACCEPTED,                  # 1 ms ahead, at the instant of arrival
    24: ACCEPTED, 25: _invalid("V10"),                 # 24 hours old, 1 ms more
    26: REJECTED, 27: _invalid("V11"), 28: ACCEPTED,   # error_message of 5000, 5001 and 4999 characters
    29: _invalid("V11"),                               # error_message a number
    30: ACCEPTED, 31: _invalid("V12"),                 # stack_trace of 20000 (cut to 10000) and 20001 characters
    32: REJECTED,                                      # app_name empty after cleaning
    33: ACCEPTED,                                      # error_message with characters to clean
    34: ACCEPTED,                                      # empty optional fields
    35: ACCEPTED, 36: ACCEPTED,                        # hardware missing, false
    37: _invalid("V1", "V6", "V7"),                    # several rules at once
    38: (401, "invalid_signature", ()),                # no body
    39: ACCEPTED,                                      # no client address
}
#: ``error_message`` of kind 33 as JSON text, and as it is stored.
UNCLEAN, CLEANED = "\\u00a0 \\u0001<b>bad</b>\\ttext\\u007f \\u3000", "bbad/btext"


def kind_of(event_id: Column) -> Column:
    place = event_id % PERIOD
    return F.when(place < len(KINDS), place).otherwise(0).cast("int")


def derive_dirty_envelopes(events: DataFrame, secret: str = FIXTURE_SECRET) -> DataFrame:
    """``request_id, body, signature, client_ip, arrived_at`` (lazy, no shuffle)."""
    rows = derive_crash_reports(events).withColumn("kind", kind_of(F.col("id")))
    kind = F.col("kind")

    def text(value) -> Column:
        return F.concat(F.lit('"'), F.lit(value) if isinstance(value, str) else value, F.lit('"'))

    def field(name: str, default: Column, missing: tuple[int, ...] = (), **changed) -> Column:
        """``"name":value``, or NULL if the field is left out."""
        value = text(default)
        for k, v in changed.items():
            value = F.when(kind == int(k[1:]), v if isinstance(v, Column) else F.lit(v)).otherwise(value)
        value = F.when(~kind.isin(*missing), value) if missing else value
        return F.concat(F.lit(f'"{name}":'), value)

    crash = F.date_trunc("MILLISECOND", F.col("crash_timestamp"))
    iso = F.concat(F.date_format("crash_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    hardware = F.when(kind == 36, "false").when(kind != 35, F.col("hardware_specs"))
    fields = F.array_compact(F.array(
        field("app_name", F.col("app_name"), (8, 37), k9="5", k10='""', k14=text("a" * APP_NAME_MAX),
              k15=text("a" * (APP_NAME_MAX + 1)), k16=text("a" * (APP_NAME_MAX - 1)), k32='"<>"'),
        field("app_version", F.col("app_version"), (11,), k17='"v1.2"', k37='"v1.2"', k18='"v1.2.3-beta"'),
        field("platform", F.col("platform"), (12,), k19='"solaris"', k37='"solaris"', k20=text(F.upper("platform"))),
        field("crash_timestamp", iso, (13,), k21='"not a date"'),
        field("error_message", F.col("error_message"), (), k26=text("e" * ERROR_MESSAGE_MAX),
              k27=text("e" * (ERROR_MESSAGE_MAX + 1)), k28=text("e" * (ERROR_MESSAGE_MAX - 1)), k29="7",
              k33=text(UNCLEAN), k34='""'),
        field("stack_trace", F.col("stack_trace"), (), k30=text("s" * STACK_TRACE_MAX), k31=text("s" * (STACK_TRACE_MAX + 1))),
        F.concat(F.lit('"hardware_specs":'), hardware),
        field("user_id", F.col("user_id"), (), k34='""'),
        field("session_id", F.col("session_id"))))
    body = F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))
    longest = F.when(kind == 1, MAX_PAYLOAD_CHARS).otherwise(MAX_PAYLOAD_CHARS + 1)
    body = (F.when(kind.isin(1, 2), F.concat(F.rpad(F.expr("''"), longest - F.length(body), " "), body))
             .when(kind == 6, F.substring(body, 1, 20)).when(kind == 7, "[1]").when(kind != 38, body))
    late = F.when(kind == 22, -1).when(kind == 23, 0).when(kind == 24, 86_400_000).when(kind == 25, 86_400_001).otherwise(3_600_000)
    out = rows.select(
        F.col("id").cast("string").alias("request_id"), body.alias("body"), "kind",
        F.when(kind != 39, F.col("client_ip")).alias("client_ip"),
        F.timestamp_millis(F.unix_millis(crash.cast("timestamp")) + late).alias("arrived_at"))
    right = hmac_sha256_hex(F.col("body"), secret)
    signature = (F.when(kind == 3, F.concat(F.lit("sha256="), hmac_sha256_hex(F.col("body"), f"not {secret}")))
                  .when(kind == 5, right).when(kind != 4, F.concat(F.lit("sha256="), right)))
    return out.select("request_id", "body", signature.alias("signature"), "client_ip", "arrived_at")


def dirty_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty envelopes, read from the folder in which they were landed once, as JSON lines."""
    from crashlens.sources.reports import read_reports

    prepare(spark)
    path = materialized(spark, sf_dir, "landing-dirty-json", lambda: derive_dirty_envelopes(read_events(spark, sf_dir)), fmt="json")
    return read_reports(spark, path, "json")


def rule_messages(rules: tuple[str, ...]) -> str:
    return "|".join(RULE_MESSAGES[r] for r in rules)
