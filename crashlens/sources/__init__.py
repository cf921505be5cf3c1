"""Sources and sinks: fixture derivation, JSON / Parquet reads, writes."""

from crashlens.sources.fixture import (
    AS_OF, FIXTURE_SECRET, crash_table, derive_crash_reports, derived_crash_table,
    derive_raw_envelopes, landing_zone, materialized, raw_envelopes,
)
from crashlens.sources.reports import (
    append_reports, crash_reports, export, flatten_for_export, read_reports,
    register_views, replay_fallback,
)

__all__ = [
    "AS_OF", "FIXTURE_SECRET", "crash_table", "derive_crash_reports",
    "derived_crash_table", "derive_raw_envelopes", "landing_zone", "materialized",
    "raw_envelopes", "append_reports", "crash_reports", "export",
    "flatten_for_export", "read_reports", "register_views", "replay_fallback",
]
