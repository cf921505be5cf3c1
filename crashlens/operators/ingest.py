"""Admission: raw envelopes -> accepted fact rows + quarantine rows.

Stage order is the service's: rate limit (429) -> payload size (413) ->
signature (401) -> JSON (400) -> content rules (400) -> table checks
(insert failure, 500) -> stored (200).  The first failing stage decides the
status; the content rules report every violation.  The whole admission is
one lazy plan whose only shuffles belong to the rate limit; the accepted
and quarantined sides are two filters of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.functions.hardware import parse_hardware
from crashlens.operators.guards import payload_ok, rate_limit, signature_valid
from crashlens.operators.sanitize import sanitized_columns
from crashlens.operators.validate import table_ok, validate_reports
from crashlens.schema import (
    IP_SALT, MAX_AGE_HOURS, MAX_PAYLOAD_CHARS, RATE_LIMIT_PER_MINUTE, REPORT_COLUMNS,
    STATUS_ACCEPTED, STATUS_BAD_REQUEST, STATUS_BAD_SIGNATURE, STATUS_INSERT_FAILED,
    STATUS_RATE_LIMITED, STATUS_TOO_LARGE,
)
from crashlens.session import by_partition, overwrite_partitions

RAW_COLUMNS = ["request_id", "body", "signature", "client_ip", "arrived_at"]
QUARANTINE_COLUMNS = RAW_COLUMNS + ["status", "reason", "errors", "retry_after"]


def admit(raw: DataFrame, *, secret: str | None, as_of=None,
          limit_per_minute: int | None = RATE_LIMIT_PER_MINUTE,
          max_payload: int = MAX_PAYLOAD_CHARS, check_signature: bool = True,
          max_age_hours: float = MAX_AGE_HOURS, policy: bool = False,
          salt: str = IP_SALT, precomputed_limit: bool = False) -> DataFrame:
    """Every input row with ``status``, ``reason``, ``errors``,
    ``retry_after`` and the sanitised report columns (meaningful for status 200).

    ``as_of=None`` judges recency against each row's ``arrived_at``.
    ``limit_per_minute=None`` disables the rate limit (replays);
    ``check_signature=False`` skips G3 (fallback replays carry none).
    ``precomputed_limit=True`` takes ``rate_limited`` / ``retry_after`` from
    the input (the streaming limiter computes them with state).
    """
    df = raw
    if not precomputed_limit:
        if limit_per_minute is not None:
            df = rate_limit(df, limit=limit_per_minute)
        else:
            df = (df.withColumn("rate_limited", F.lit(False))
                    .withColumn("retry_after", F.lit(None).cast("int")))
    df = validate_reports(df, as_of=as_of, max_age_hours=max_age_hours)
    sig_ok = (signature_valid(F.col("body"), F.col("signature"), secret)
              if check_signature else F.lit(True))
    # sanitised report columns, computed once per row below the decision
    df = df.select(*RAW_COLUMNS, "rate_limited", "retry_after", "json_ok", "errors",
                   sig_ok.alias("_sig_ok"), *sanitized_columns(salt))
    refused = [
        (F.col("rate_limited"), STATUS_RATE_LIMITED, "rate_limited"),
        (~payload_ok(F.col("body"), max_payload), STATUS_TOO_LARGE, "payload_too_large"),
        (~F.col("_sig_ok"), STATUS_BAD_SIGNATURE, "invalid_signature"),
        (~F.col("json_ok"), STATUS_BAD_REQUEST, "invalid_json"),
        (F.size("errors") > 0, STATUS_BAD_REQUEST, "invalid_crash_data"),
        # C1-C6 (and C7/C8): a row the table refuses is an insert failure
        (~table_ok(policy=policy, as_of=as_of), STATUS_INSERT_FAILED, "insert_rejected"),
    ]
    decision = None
    for cond, code, why in refused:
        out = F.struct(F.lit(code).alias("status"), F.lit(why).alias("reason"))
        decision = F.when(cond, out) if decision is None else decision.when(cond, out)
    decision = decision.otherwise(F.struct(F.lit(STATUS_ACCEPTED).alias("status"),
                                           F.lit("accepted").alias("reason")))
    # The decision is emitted by a one-row generator: a later filter on
    # ``status`` stops at the Generate instead of being pushed into (and
    # re-evaluating) the parse, rule and sanitiser expressions.
    df = df.select(*RAW_COLUMNS, "retry_after", "errors", *REPORT_COLUMNS,
                   F.inline(F.array(decision)))
    # later stages never ran for a refused request: their findings are cleared
    errors = F.when(F.col("reason") == "invalid_crash_data", F.col("errors")) \
              .otherwise(F.array().cast("array<string>"))
    return df.select(*RAW_COLUMNS, "status", "reason", errors.alias("errors"),
                     "retry_after", *REPORT_COLUMNS)


def split(admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted fact rows, quarantine rows)`` of an ``admit`` result."""
    accepted = (admitted.where(F.col("status") == STATUS_ACCEPTED)
                        .select(*REPORT_COLUMNS)
                        .withColumn("created_date", F.to_date("created_at"))
                        .withColumn("hw", parse_hardware(F.col("hardware_specs"))))
    quarantine = admitted.where(F.col("status") != STATUS_ACCEPTED).select(*QUARANTINE_COLUMNS)
    return accepted, quarantine


def write_batch(accepted: DataFrame, quarantine: DataFrame, root: str,
                batch_id: int | str, files_per_date: int | None = None) -> None:
    """Write one admitted batch idempotently.

    Both tables are partitioned by ``batch_id`` (and the fact table also by
    ``created_date``) and written with dynamic partition overwrite, so a
    retried batch replaces its own files instead of appending twice.
    """
    bid = F.lit(str(batch_id))
    rows = by_partition(accepted.withColumn("batch_id", bid), "created_date", files_per_date)
    overwrite_partitions(rows, "batch_id", "created_date").parquet(
        f"{root.rstrip('/')}/crash_reports")
    overwrite_partitions(quarantine.withColumn("batch_id", bid),
                         "batch_id").parquet(f"{root.rstrip('/')}/quarantine")


def write_admitted(admitted: DataFrame, root: str, batch_id: int | str,
                   files_per_date: int | None = None, rollup_path: str | None = None) -> None:
    """Split an admitted batch and write both sides, computing it once.

    The batch is persisted (memory and disk) for the two writes and released
    afterwards; a lost block is recomputed from lineage.
    """
    from pyspark import StorageLevel

    admitted = admitted.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        accepted, quarantine = split(admitted)
        write_batch(accepted, quarantine, root, batch_id, files_per_date)
        if rollup_path is not None:
            from crashlens.streaming.rollup import write_rollup_partial
            write_rollup_partial(accepted, rollup_path, batch_id)
    finally:
        admitted.unpersist()


def ingest_batch(raw: DataFrame, root: str, batch_id: int | str, *,
                 secret: str | None, **kw) -> None:
    """Batch ingestion of one landing folder: admit, then write accepted and
    quarantine rows idempotently under ``root`` for ``batch_id``."""
    write_admitted(admit(raw, secret=secret, **kw), root, batch_id)
