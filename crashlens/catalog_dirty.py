"""Registered queries over dirty envelopes: every refusal and cleaning rule of admission, against SQL.

The envelopes are read as JSON lines (S1).  The oracle knows each kind's outcome from the rules' texts and
bounds (``sources.dirty.KINDS``) and rebuilds the stored values from ``events``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crashlens.catalog import register
from crashlens.operators import admit, split
from crashlens.oracle import q
from crashlens.schema import APP_NAME_MAX, ERROR_MESSAGE_MAX, IP_SALT, SANITIZED_MAX
from crashlens.sources.dirty import CLEANED, KINDS, PERIOD, dirty_envelopes, kind_of, rule_messages
from crashlens.sources.fixture import FIXTURE_SECRET

_KIND = f"CASE WHEN id % {PERIOD} < {len(KINDS)} THEN id % {PERIOD} ELSE 0 END"
_OUTCOMES = ", ".join(f"({k}, {status}, '{reason}', '{rule_messages(rules)}')" for k, (status, reason, rules) in KINDS.items())
_DIRTY = f"""
dirty AS (
  SELECT r.*, o.kind, o.status, o.reason, o.errors
  FROM crash_reports r JOIN (VALUES {_OUTCOMES}) o(kind, status, reason, errors) ON o.kind = {_KIND})"""


def _admitted(spark, d):
    return admit(dirty_envelopes(spark, d), secret=FIXTURE_SECRET, limit_per_minute=None)


def _kind():
    return kind_of(F.col("request_id").cast("long"))


@register("ingest_dirty_status", q(ctes=_DIRTY, body="""
SELECT CAST(kind AS INTEGER) AS kind, status, reason, COUNT(*) AS n FROM dirty GROUP BY kind, status, reason"""))
def _dirty_status(spark, d):
    """G2-G4, V1-V12, C1-C6 on both sides of their bounds: outcome per kind of envelope."""
    return (_admitted(spark, d).groupBy(_kind().alias("kind"), "status", "reason")
            .agg(F.count(F.lit(1)).alias("n")).orderBy("kind"))


@register("ingest_dirty_errors", q(ctes=_DIRTY, body="""
SELECT CAST(id AS VARCHAR) AS request_id, status, reason, errors FROM dirty WHERE status <> 200"""))
def _dirty_errors(spark, d):
    """The quarantine: every message of every broken rule, in rule order."""
    _, quarantine = split(_admitted(spark, d))
    return quarantine.select("request_id", "status", "reason", F.array_join("errors", "|").alias("errors"))


@register("ingest_dirty_stored", q(ctes=_DIRTY, body=f"""
SELECT CAST(id AS VARCHAR) AS id,
       CASE kind WHEN 16 THEN repeat('a', {APP_NAME_MAX - 1}) ELSE app_name END AS app_name,
       CASE kind WHEN 18 THEN 'v1.2.3-beta' ELSE app_version END AS app_version, platform,
       date_trunc('milliseconds', crash_timestamp) AS crash_timestamp,
       CASE kind WHEN 28 THEN repeat('e', {ERROR_MESSAGE_MAX - 1}) WHEN 33 THEN '{CLEANED}' WHEN 34 THEN NULL ELSE error_message END
         AS error_message,
       CASE kind WHEN 30 THEN repeat('s', {SANITIZED_MAX}) ELSE stack_trace END AS stack_trace,
       CASE kind WHEN 34 THEN NULL ELSE user_id END AS user_id, session_id,
       hardware_specs IS NULL OR kind IN (35, 36) AS no_hardware,
       sha256(concat(CASE kind WHEN 39 THEN 'unknown' ELSE client_ip END, '{IP_SALT}')) AS ip_hash
FROM dirty WHERE status = 200"""))
def _dirty_stored(spark, d):
    """The cleaned rows that dirty but acceptable envelopes become."""
    accepted, _ = split(_admitted(spark, d))
    return accepted.select("id", "app_name", "app_version", "platform",
                           F.col("crash_timestamp").cast("timestamp_ntz").alias("crash_timestamp"), "error_message", "stack_trace",
                           "user_id", "session_id", (F.col("hardware_specs") == "{}").alias("no_hardware"), "ip_hash")
