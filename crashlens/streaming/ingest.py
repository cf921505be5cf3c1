"""Streaming admission with the batch column logic.

The stream runs the same expressions as ``operators.admit``; only the rate
limit differs (stateful, ``limiter.rate_limit_stream``).  Each micro-batch
is split and written by ``foreachBatch`` with ``operators.write_batch``:
partitioned by batch id with dynamic overwrite, so a replayed batch
replaces its own output (exactly-once files without a transactional sink).
Recency (V9/V10) is judged against each row's ``arrived_at``, never the
wall clock, so reruns give the same answer.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.operators.guards import rate_limit
from crashlens.operators.ingest import admit, split, write_admitted, write_batch
from crashlens.schema import (
    FACT_SCHEMA, QUARANTINE_SCHEMA, RAW_SCHEMA, RATE_LIMIT_PER_MINUTE, STATUS_RATE_LIMITED,
)
from crashlens.session import prepare
from crashlens.streaming.limiter import ledger_prior, rate_limit_stream, record_admitted
from crashlens.streaming.minute_limiter import rate_limit_minutes
from crashlens.streaming.rollup import write_rollup_partial


def read_report_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw envelopes arriving as files in ``path`` (JSON lines or Parquet)."""
    prepare(spark)
    reader = spark.readStream.schema(RAW_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.format(fmt).load(path)


def admit_stream(stream: DataFrame, *, secret: str | None,
                 limit_per_minute: int | None = RATE_LIMIT_PER_MINUTE, limiter: str = "state", **kw) -> DataFrame:
    """Streaming admission (stateful limiter, then the batch rules).  ``limiter="minutes"`` keeps one expiring
    state row per client and minute (``minute_limiter``), ``"state"`` one per client."""
    if limit_per_minute is None:
        return admit(stream, secret=secret, limit_per_minute=None, **kw)
    limited = (rate_limit_minutes if limiter == "minutes" else rate_limit_stream)(stream, limit=limit_per_minute)
    return admit(limited, secret=secret, limit_per_minute=None,
                 precomputed_limit=True, **kw)


def start_ingest(stream: DataFrame, root: str, checkpoint: str, *, secret: str | None,
                 limit_per_minute: int | None = RATE_LIMIT_PER_MINUTE,
                 available_now: bool = True, limiter: str = "ledger",
                 files_per_date: int | None = None, rollup_path: str | None = None, **kw):
    """Admit a stream and write accepted / quarantine per micro-batch.

    ``limiter="ledger"`` (default) rate-limits each micro-batch with the
    skew-safe batch operator and a ledger of earlier batches' counts
    (``ledger_prior`` / ``record_admitted``, no Python); ``limiter="minutes"`` uses state with a
    lifetime per client and minute (call ``use_rocksdb`` first), ``limiter="state"`` the stateful
    ``applyInPandasWithState`` limiter, one group a client.
    ``files_per_date`` spreads each arrival date of a batch over that many
    writer tasks (for backfills whose batches span many days); by default a
    task writes one file per date it holds.  With ``rollup_path`` each
    batch also writes its partial hourly rollup cells there
    (``read_rollup_sums`` adds them up).
    """
    if limiter in ("state", "minutes") or limit_per_minute is None:
        admitted = admit_stream(stream, secret=secret, limit_per_minute=limit_per_minute, limiter=limiter, **kw)

        def write(batch: DataFrame, batch_id: int) -> None:
            write_admitted(batch, root, batch_id, files_per_date, rollup_path)
    elif limiter == "ledger":
        admitted = stream
        ledger = f"{root.rstrip('/')}/_limiter_ledger"

        def write(batch: DataFrame, batch_id: int) -> None:
            # one persisted batch feeds: ledger lookup, both outputs, ledger update;
            # every write is idempotent per batch id, so any retry is safe
            batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                prior = ledger_prior(batch, ledger, batch_id)
                limited = rate_limit(batch, limit=limit_per_minute, prior=prior)
                admitted = admit(limited, secret=secret, precomputed_limit=True, **kw)
                admitted = admitted.persist(StorageLevel.MEMORY_AND_DISK)
                accepted, quarantine = split(admitted)
                write_batch(accepted, quarantine, root, batch_id, files_per_date)
                if rollup_path is not None:
                    write_rollup_partial(accepted, rollup_path, batch_id)
                record_admitted(admitted.where(F.col("status") != STATUS_RATE_LIMITED),
                                ledger, batch_id)
                admitted.unpersist()
            finally:
                batch.unpersist()
    else:
        raise ValueError(f"unknown limiter: {limiter}")

    writer = admitted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def dedup_stream(stream: DataFrame, key: str = "request_id",
                 watermark_col: str = "arrived_at", delay: str | None = None) -> DataFrame:
    """One row per request id.

    Replays are late by nature, so by default every id is remembered (state grows with
    the ids; keep it in RocksDB) and no late row is lost.  A ``delay`` bounds the state, and
    then drops rows that are later than it, unique ones included.
    """
    if delay is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(watermark_col, delay).dropDuplicatesWithinWatermark([key])


def read_ingested(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantine tables written by ``start_ingest``."""
    acc = spark.read.schema(FACT_SCHEMA).parquet(f"{root.rstrip('/')}/crash_reports")
    qua = spark.read.schema(QUARANTINE_SCHEMA).parquet(f"{root.rstrip('/')}/quarantine")
    return acc, qua.drop("batch_id")


__all__ = ["read_report_stream", "admit_stream", "start_ingest", "dedup_stream",
           "read_ingested"]
