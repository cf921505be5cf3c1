"""Per-(client, minute) rate limiter as streaming state.

``row_number`` is refused on streams, so the limiter keeps state per
client: how many requests each still-open minute has admitted.  Grouping by
client (not by client and minute) keeps the Python calls to one per client
and micro-batch.  The group's rows arrive as an iterator of Arrow batches;
per minute the handler keeps only the ``quota`` earliest rows seen so far,
so memory is bounded by ``limit`` rows per open minute plus one batch,
however hot the client.  Rows pushed out of a kept set are emitted as
limited at once, the kept rows as admitted at the end.  Minutes behind the
watermark are dropped from the state, and an idle client's state expires
with an event-time timeout (the original service's map never evicts).
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from crashlens.schema import RATE_LIMIT_PER_MINUTE

OUTPUT_SCHEMA = ("request_id string, body string, signature string, client_ip string, "
                 "arrived_at timestamp, rate_limited boolean, retry_after int")
STATE_SCHEMA = "minutes array<long>, admitted array<long>"
LEDGER_SCHEMA = "client_key string, minute timestamp, admitted long, batch_id int"
_COLS = ["request_id", "body", "signature", "client_ip", "arrived_at"]
_MINUTE_US = 60_000_000


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy(dtype="datetime64[us]").astype("int64")


def _emit(rows: pd.DataFrame, limited: bool) -> pd.DataFrame:
    out = rows[_COLS].reset_index(drop=True)
    out["rate_limited"] = limited
    if limited:
        secs = _micros(out["arrived_at"]) // 1_000_000
        out["retry_after"] = (60 - secs % 60).astype("int32")
    else:
        out["retry_after"] = pd.array([None] * len(out), dtype="Int32")
    return out


def _rank_in_minute(minutes: np.ndarray, ts: np.ndarray, ids: np.ndarray):
    """Sort order by (minute, ts, id) and each sorted row's rank in its minute."""
    order = np.lexsort((ids, ts, minutes))
    m = minutes[order]
    starts = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    run = np.repeat(starts, np.diff(np.r_[starts, len(m)]))
    return order, np.arange(len(m)) - run, m


def make_limiter(limit: int):
    def handle(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        used = {}
        if state.exists:
            minutes, admitted = state.get
            used = dict(zip(minutes, admitted))
        kept = None
        for pdf in batches:
            if pdf.empty:
                continue
            pool = pdf[_COLS] if kept is None else pd.concat([kept, pdf[_COLS]],
                                                             ignore_index=True)
            ts = _micros(pool["arrived_at"])
            minutes = ts // _MINUTE_US
            ids = pool["request_id"].fillna("").to_numpy(dtype=object).astype(str)
            order, rank, m = _rank_in_minute(minutes, ts, ids)
            quota = np.array([max(limit - used.get(int(x), 0), 0) for x in m]) \
                if used else np.full(len(m), limit)
            keep = rank < quota
            kept = pool.iloc[order[keep]]
            if (~keep).any():
                yield _emit(pool.iloc[order[~keep]], True)
        if kept is not None and len(kept):
            yield _emit(kept, False)
            for m_, n in zip(*np.unique(_micros(kept["arrived_at"]) // _MINUTE_US,
                                        return_counts=True)):
                used[int(m_)] = used.get(int(m_), 0) + int(n)
        watermark_min = state.getCurrentWatermarkMs() * 1000 // _MINUTE_US
        used = {m_: n for m_, n in used.items() if m_ >= watermark_min - 1}
        if used:
            state.update((list(used), list(used.values())))
            state.setTimeoutTimestamp((max(used) + 2) * _MINUTE_US // 1000)
        elif state.exists:
            state.remove()
    return handle


# The state handler is shipped by value, so Python workers need not have
# this package installed (executors only get the pickled function).
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rate_limit_stream(stream: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE,
                      watermark: str = "3650 days") -> DataFrame:
    """Streaming twin of ``operators.rate_limit`` (append mode).

    A shorter ``watermark`` evicts closed minutes earlier, but rows later than it get no
    decision at all.  The ledger limiter has no such bound and is the default of
    ``start_ingest``."""
    keyed = (stream.withWatermark("arrived_at", watermark)
                   .withColumn("_key", F.coalesce(F.col("client_ip"), F.lit("unknown"))))
    return (keyed.groupBy("_key")
                 .applyInPandasWithState(make_limiter(limit), OUTPUT_SCHEMA, STATE_SCHEMA,
                                         "append", GroupStateTimeout.EventTimeTimeout))


def ledger_prior(batch: DataFrame, ledger: str, batch_id: int) -> DataFrame | None:
    """Requests admitted by earlier micro-batches for the minutes this batch
    touches (``client_key, minute, admitted``), or None before the first."""
    from crashlens.session import path_exists

    spark = batch.sparkSession
    if not path_exists(spark, ledger):
        return None
    first = batch.agg(F.min(F.date_trunc("minute", "arrived_at")).alias("m")).first().m
    if first is None:
        return None
    return (spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
                 .where((F.col("batch_id") < batch_id) & (F.col("minute") >= F.lit(first)))
                 .groupBy("client_key", "minute")
                 .agg(F.sum("admitted").alias("admitted")))


def record_admitted(passed: DataFrame, ledger: str, batch_id: int) -> None:
    """Write this batch's admitted counts per (client, minute) to its ledger
    partition (dynamic overwrite: a replayed batch rewrites only its own)."""
    from crashlens.operators.guards import client_key
    from crashlens.session import overwrite_partitions

    counts = (passed.groupBy(client_key(F.col("client_ip")).alias("client_key"),
                             F.date_trunc("minute", "arrived_at").alias("minute"))
                    .agg(F.count(F.lit(1)).alias("admitted"))
                    .withColumn("batch_id", F.lit(batch_id)))
    overwrite_partitions(counts, "batch_id").parquet(ledger)
