"""Row operators: admission guards, validators, sanitiser, rollup."""

from crashlens.operators.guards import payload_ok, rate_limit, signature_valid
from crashlens.operators.ingest import (
    admit, ingest_batch, split, write_admitted, write_batch,
)
from crashlens.operators.rollup import (
    crash_analytics, hour_window, hourly_rollup, read_rollup_table, refresh_rollup,
)
from crashlens.operators.sanitize import sanitize_reports
from crashlens.operators.validate import (
    check_table, parse_body, rule_violations, table_ok, validate_reports,
)

__all__ = [
    "payload_ok", "rate_limit", "signature_valid", "admit", "split", "write_batch", "write_admitted", "ingest_batch",
    "crash_analytics", "hour_window", "hourly_rollup", "refresh_rollup", "read_rollup_table", "sanitize_reports", "check_table", "parse_body",
    "rule_violations", "table_ok", "validate_reports",
]
