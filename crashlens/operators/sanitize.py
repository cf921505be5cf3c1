"""Sanitised projection of a validated report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.functions.crypto import ip_hash
from crashlens.functions.hardware import parse_hardware
from crashlens.functions.text import sanitize
from crashlens.operators.validate import parsed_crash_time, truthy
from crashlens.schema import IP_SALT


def _optional(f: str) -> Column:
    # A falsy optional field ('' or missing) is stored as NULL
    return F.when(truthy(f), sanitize(F.col(f"in_{f}")))


def sanitized_columns(salt: str = IP_SALT) -> list[Column]:
    """Stored-report columns of a parsed, valid row."""
    created = F.col("arrived_at")
    rid = F.coalesce(F.col("request_id"), F.sha2(F.concat_ws(
        ",", F.col("body"), F.col("client_ip"), F.col("arrived_at").cast("string")), 256))
    hw_json = F.when(truthy("hardware_specs"), F.col("in_hardware_specs__json")) \
               .otherwise(F.lit("{}"))                                    # Z10
    return [
        rid.alias("id"),
        sanitize(F.col("in_app_name")).alias("app_name"),                     # Z1-Z5
        sanitize(F.col("in_app_version")).alias("app_version"),
        parsed_crash_time().alias("crash_timestamp"),                      # Z8
        F.lower(F.col("in_platform")).alias("platform"),                      # Z7
        _optional("error_message").alias("error_message"),
        _optional("stack_trace").alias("stack_trace"),
        hw_json.alias("hardware_specs"),
        _optional("user_id").alias("user_id"),
        _optional("session_id").alias("session_id"),
        created.alias("created_at"),
        ip_hash(F.coalesce(F.col("client_ip"), F.lit("unknown")), salt).alias("ip_hash"),  # Z9
    ]


def sanitize_reports(df: DataFrame, salt: str = IP_SALT) -> DataFrame:
    """Project parsed rows to the stored schema, plus ``created_date`` and the
    parsed ``hw`` struct kept next to the raw JSON."""
    out = df.select(*sanitized_columns(salt))
    return (out.withColumn("created_date", F.to_date("created_at"))
               .withColumn("hw", parse_hardware(F.col("hardware_specs"))))
