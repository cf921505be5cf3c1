"""Column expressions (JVM-side, codegen-friendly) used across the library."""

from crashlens.functions.crypto import hmac_sha256_hex, ip_hash, signature_ok
from crashlens.functions.hardware import (
    cpu_name, hw_bigint, hw_int, memory_tier, parse_hardware, with_hardware,
)
from crashlens.functions.numeric import avg_scaled_half_up, round_ratio
from crashlens.functions.text import (
    contains_ci, left, normalize_platform, sanitize, unknown_if_blank,
)
from crashlens.functions.time import (
    as_timestamp, day_name, dow_sunday0, lookback, trunc_like, ts_literal,
)

__all__ = [
    "hmac_sha256_hex", "ip_hash", "signature_ok", "cpu_name", "hw_bigint",
    "hw_int", "memory_tier", "parse_hardware", "with_hardware",
    "avg_scaled_half_up", "round_ratio", "contains_ci", "left",
    "normalize_platform", "sanitize", "unknown_if_blank", "as_timestamp",
    "day_name", "dow_sunday0", "lookback", "trunc_like", "ts_literal",
]
