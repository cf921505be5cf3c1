"""Schemas, enumerations and bounds of the crash-report data model.

Everything in the block marked FIXED VALUES must equal the service whose
behaviour this library reproduces; change them only together with it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original service for identical results)
# ---------------------------------------------------------------------------
PLATFORMS = ("windows", "linux", "macos", "android", "ios")
# OS identifier -> report platform: the union of both client libraries' maps
# (one maps win32/darwin/linux/android/ios, the other also lower-case windows)
PLATFORM_ALIASES = {
    "win32": "windows",
    "darwin": "macos",
    "linux": "linux",
    "android": "android",
    "ios": "ios",
    "windows": "windows",
}
VERSION_PATTERN = r"^v[0-9]+\.[0-9]+\.[0-9]+"
IP_SALT = "crash-analytics-salt"
MAX_PAYLOAD_CHARS = 50_000
RATE_LIMIT_PER_MINUTE = 60
APP_NAME_MAX = 100            # validator: 1..100 inclusive; table CHECK: < 100
ERROR_MESSAGE_MAX = 5_000     # validator: <= 5000; table CHECK: < 5000
STACK_TRACE_MAX = 20_000      # validator: <= 20000; table CHECK: < 20000
SANITIZED_MAX = 10_000        # every sanitised string is cut to this length
MAX_AGE_HOURS = 24            # reports older than this are refused
READ_LIMIT_RANGE = (1, 100)
READ_LIMIT_DEFAULT = 50
READ_DAYS_RANGE = (1, 365)
READ_DAYS_DEFAULT = 30
UNKNOWN = "unknown"
GPU_FALLBACK = "Integrated/Unknown"
GPU_FALLBACK_SHORT = "Integrated"
# validation messages, in rule order V1..V12 (one message per rule;
# V8-V10 exclude each other, checked in that order)
RULE_MESSAGES = {
    "V1": "app_name is required and must be a string",
    "V2": "app_version is required and must be a string",
    "V3": "platform is required and must be a string",
    "V4": "crash_timestamp is required",
    "V5": "app_name must be 1-100 characters",
    "V6": "app_version must follow semantic versioning (v1.2.3)",
    "V7": "platform must be one of: windows, linux, macos, android, ios",
    "V8": "crash_timestamp must be a valid ISO date",
    "V9": "crash_timestamp cannot be in the future",
    "V10": "crash_timestamp must be within the last 24 hours",
    "V11": "error_message must be a string under 5000 characters",
    "V12": "stack_trace must be a string under 20000 characters",
}
# HTTP-style status of each admission stage, in the order the stages run
STATUS_RATE_LIMITED = 429
STATUS_TOO_LARGE = 413
STATUS_BAD_SIGNATURE = 401
STATUS_BAD_REQUEST = 400
STATUS_INSERT_FAILED = 500
STATUS_ACCEPTED = 200
# memory tier edges in bytes and their labels, one list per report
MEMORY_TIERS_4 = ([4_000_000_000, 8_000_000_000, 16_000_000_000],
                  ["Low (< 4GB)", "Medium (4-8GB)", "High (8-16GB)", "Very High (16GB+)"])
MEMORY_TIERS_5 = ([4_000_000_000, 8_000_000_000, 16_000_000_000, 32_000_000_000],
                  ["< 4GB", "4-8GB", "8-16GB", "16-32GB", "32GB+"])
MEMORY_TIERS_3 = ([8_000_000_000, 16_000_000_000],
                  ["< 8GB", "8-16GB", "16GB+"])
# ---------------------------------------------------------------------------

# Raw request envelope: one row per POSTed report.
RAW_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("client_ip", T.StringType()),
    T.StructField("arrived_at", T.TimestampType()),
])

# Union of every hardware_specs shape written or queried.  Numbers are read
# as double: a bigint field refuses "8000000000.0" and clients send floats.
HARDWARE_SCHEMA = T.StructType([
    T.StructField("cpu", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("cores", T.DoubleType()),
        T.StructField("freq", T.DoubleType()),
        T.StructField("arch", T.StringType()),
    ])),
    T.StructField("memory", T.StructType([
        T.StructField("total", T.DoubleType()),
        T.StructField("available", T.DoubleType()),
        T.StructField("used", T.DoubleType()),
        T.StructField("free", T.DoubleType()),
    ])),
    T.StructField("platform", T.StructType([
        T.StructField("system", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("release", T.StringType()),
        T.StructField("arch", T.StringType()),
        T.StructField("node_version", T.StringType()),
        T.StructField("python_version", T.StringType()),
    ])),
    T.StructField("gpu", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("memory", T.DoubleType()),
    ])),
])

# Stored fact table (partitioned by created_date).
REPORT_COLUMNS = [
    "id", "app_name", "app_version", "crash_timestamp", "platform",
    "error_message", "stack_trace", "hardware_specs", "user_id",
    "session_id", "created_at", "ip_hash",
]

# Stored fact table as written by ingestion (partition columns last).
FACT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["id", "app_name", "app_version"]]
    + [T.StructField("crash_timestamp", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in
       ["platform", "error_message", "stack_trace", "hardware_specs", "user_id", "session_id"]]
    + [T.StructField("created_at", T.TimestampType()),
       T.StructField("ip_hash", T.StringType()),
       T.StructField("hw", HARDWARE_SCHEMA),
       T.StructField("batch_id", T.StringType()),
       T.StructField("created_date", T.DateType())])

# Quarantine table: the raw envelope and why it was refused.
QUARANTINE_SCHEMA = T.StructType(RAW_SCHEMA.fields + [
    T.StructField("status", T.IntegerType()),
    T.StructField("reason", T.StringType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("retry_after", T.IntegerType()),
    T.StructField("batch_id", T.StringType()),
])
