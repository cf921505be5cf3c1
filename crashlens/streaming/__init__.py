"""Structured Streaming twins of the batch operators."""

from crashlens.streaming.ingest import (
    admit_stream, dedup_stream, read_ingested, read_report_stream, start_ingest,
)
from crashlens.streaming.late import (
    exact_rollup_parts, hourly_alerts, read_exact_rollup, start_exact_rollup, users_by,
)
from crashlens.streaming.limiter import rate_limit_stream
from crashlens.streaming.minute_limiter import rate_limit_minutes, use_rocksdb
from crashlens.streaming.rollup import (
    hourly_rollup_stream, read_rollup, read_rollup_sums, spike_alerts, start_rollup,
    write_rollup_partial,
)

__all__ = [
    "admit_stream", "dedup_stream", "read_ingested", "read_report_stream",
    "start_ingest", "rate_limit_stream", "rate_limit_minutes", "use_rocksdb", "start_exact_rollup", "read_exact_rollup",
    "exact_rollup_parts", "users_by", "hourly_alerts", "hourly_rollup_stream", "read_rollup",
    "spike_alerts", "start_rollup", "read_rollup_sums", "write_rollup_partial",
]
