"""X6 as keyed state with a lifetime: a count per (client, minute), kept in state rows of many such keys.

Every task first keeps, per client and minute, the ``limit`` earliest requests of each ``POOL_ROWS`` rows of its own
partition: a later one is limited whatever other tasks hold.  Such a request goes on under a salted key and needs no
state, so that at most ``limit`` requests per task, minute and ``POOL_ROWS`` rows meet under one (client, minute),
however hot the client.

Most clients and minutes have a request or two, so one state row (and one call into Python) for each of them costs far
more than its decision.  A state row therefore holds the counts of all clients of one hash bucket in one window
of minutes: ``BUCKETS`` tasks at most share a window, and a batch touches the rows of its own windows only.  Each count
has its own end of life, a ``lifetime`` after its last change; the row expires with its last count.  No watermark is
used: late requests are decided like any other.

Needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from crashlens.schema import RATE_LIMIT_PER_MINUTE

COLUMNS = ["request_id", "body", "signature", "client_ip", "arrived_at"]
OUTPUT_SCHEMA = ("request_id string, body string, signature string, client_ip string, "
                 "arrived_at timestamp, rate_limited boolean, retry_after int")
_KEYED_SCHEMA = ("request_id string, body string, signature string, client_ip string, arrived_at timestamp, "
                 "_key string, _minute long, _salt int")
_MINUTE_US = 60_000_000
#: Keys over which requests that are limited already are spread.
SALTS = 1024
#: Rows that a task ranks at once.
POOL_ROWS = 50_000
#: A state row's keys: clients of one of ``BUCKETS`` hash buckets in one window of ``WINDOW_MINUTES``.
BUCKETS, WINDOW_MINUTES = 64, 240
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Session settings of the limiter: its state store, and no batches without data, of which a state with a
    lifetime would ask for ever (an ``availableNow`` run would not end)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def _micros(at: pd.Series) -> np.ndarray:
    """Microseconds of arrival; a missing time belongs to minute 0 and comes last in it."""
    known = at.notna().to_numpy()
    out = np.zeros(len(at), np.int64)
    out[known] = at[known].to_numpy(dtype="datetime64[us]").astype(np.int64)
    return np.where(known, out, _MINUTE_US - 1)


def _keyed(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows with the client and minute that they count for."""
    return rows.assign(_key=rows["client_ip"].fillna("unknown"), _minute=_micros(rows["arrived_at"]) // _MINUTE_US)


def _sorted_ranks(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Order by (client, minute, time, id) and each ordered row's place in its client and minute."""
    at = _micros(rows["arrived_at"])
    client, minute = pd.factorize(rows["_key"])[0], at // _MINUTE_US
    missing = rows["request_id"].isna().to_numpy()
    order = np.lexsort((rows["request_id"].fillna("").to_numpy(dtype=object).astype(str), missing, at, minute, client))
    first = np.ones(len(order), bool)
    first[1:] = (client[order][1:] != client[order][:-1]) | (minute[order][1:] != minute[order][:-1])
    begin = np.flatnonzero(first)
    return order, np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))


def partial_top(limit: int):
    """mapInPandas: rows with their key; those outside the partition's first ``limit`` of a minute get a salt."""
    def salted(rows: pd.DataFrame) -> pd.DataFrame:
        spread = np.arange(len(rows)) % SALTS + 1
        return rows.assign(_salt=spread.astype(np.int32))

    def ranked(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = pd.concat(parts, ignore_index=True)
        order, rank = _sorted_ranks(pool)
        over = pool.iloc[order[rank >= limit]]
        if len(over):
            yield salted(over)
        yield pool.iloc[order[rank < limit]].assign(_salt=np.int32(0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for rows in batches:
            if not len(rows):
                continue
            held.append(_keyed(rows))
            size += len(rows)
            if size >= POOL_ROWS:
                yield from ranked(held)
                held, size = [], 0
        if held:
            yield from ranked(held)
    return run


_STATE = StructType([StructField("clients", ArrayType(StringType())), *(
    StructField(name, ArrayType(LongType())) for name in ("minutes", "admitted", "until"))])


class MinuteQuota(StatefulProcessor):
    """Admits the earliest requests of each (client, minute) of a bucket while places are left."""

    def __init__(self, limit: int, lifetime_ms: int):
        self.limit, self.lifetime_ms = limit, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", _STATE, self.lifetime_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1]:  # decided by the task that read them
            for part in rows:
                yield self._emit(part, np.ones(len(part), bool))
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        stored = self.counts.get() if self.counts.exists() else ([], [], [], [])
        known = {(c, m): (n, until) for c, m, n, until in zip(*stored, strict=True) if until > now}
        held, size, most = [], 0, POOL_ROWS
        for part in rows:  # only those that may pass are kept
            held.append(_keyed(part))  # a group's rows lose column names that begin with "_"
            size += len(part)
            if size >= most:
                kept, over = self._sifted(held, known)
                if len(over):
                    yield self._emit(over, np.ones(len(over), bool))
                held, size = [kept], len(kept)
                most = max(POOL_ROWS, 2 * size)
        kept, over = self._sifted(held, known)
        if len(over):
            yield self._emit(over, np.ones(len(over), bool))
        if len(kept):
            for at, n in kept.groupby(["_key", "_minute"], sort=False).size().items():
                known[at] = known.get(at, (0, 0))[0] + n, now + self.lifetime_ms
            self.counts.update(tuple(map(list, zip(*((c, int(m), int(n), until) for (c, m), (n, until) in known.items()), strict=True))))
            yield self._emit(kept, np.zeros(len(kept), bool))

    def _sifted(self, parts: list[pd.DataFrame], known: dict) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Rows that find a place among these and the ``known`` counts, and the others."""
        pool = pd.concat(parts, ignore_index=True)
        order, rank = _sorted_ranks(pool)
        left = np.full(len(order), self.limit)
        if known:
            begin = np.flatnonzero(rank == 0)
            keys = zip(pool["_key"].to_numpy()[order[begin]], pool["_minute"].to_numpy()[order[begin]].tolist(), strict=True)
            left = np.repeat([max(0, self.limit - known.get(at, (0, 0))[0]) for at in keys], np.diff(np.append(begin, len(order))))
        return pool.iloc[order[rank < left]], pool.iloc[order[rank >= left]]

    def close(self) -> None:
        pass

    @staticmethod
    def _emit(rows: pd.DataFrame, limited: np.ndarray) -> pd.DataFrame:
        out = rows[COLUMNS].reset_index(drop=True)
        out["rate_limited"] = limited
        seconds = _micros(out["arrived_at"]) // 1_000_000
        retry = pd.array(60 - seconds % 60, dtype="Int32")
        retry[~limited | out["arrived_at"].isna().to_numpy()] = pd.NA
        out["retry_after"] = retry
        return out


# Sent to Python workers by value, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rate_limit_minutes(stream: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE, lifetime_minutes: float = 24 * 60) -> DataFrame:
    """Streaming twin of ``operators.rate_limit`` (append mode): every request, with ``rate_limited`` and ``retry_after``.

    A minute's count is forgotten ``lifetime_minutes`` of processing time after its last admission; a request that
    comes later for that minute finds all places free.  Choose it above the greatest delay of requests.
    """
    keyed = stream.select(*COLUMNS).mapInPandas(partial_top(limit), _KEYED_SCHEMA)
    window = F.floor(F.col("_minute") / WINDOW_MINUTES).cast("long")
    bucket = window * BUCKETS + F.pmod(F.xxhash64("_key"), F.lit(BUCKETS))
    keyed = keyed.select(*COLUMNS, "_salt", F.when(F.col("_salt") == 0, bucket).otherwise(F.lit(0).cast("long")).alias("_bucket"))
    processor = MinuteQuota(limit, max(1, int(lifetime_minutes * 60_000)))
    return keyed.groupBy("_bucket", "_salt").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT_SCHEMA, outputMode="Append", timeMode="ProcessingTime")


