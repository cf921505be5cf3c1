"""Hashing expressions: salted IP hash and HMAC-SHA256, all JVM-side."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashlens.schema import IP_SALT

_BLOCK = 64  # SHA-256 block size in bytes


def ip_hash(col: Column, salt: str = IP_SALT) -> Column:
    """Hex SHA-256 of ``ip || salt``."""
    return F.sha2(F.concat(col, F.lit(salt)), 256)


def _pads(secret: str) -> tuple[str, str]:
    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner = bytes(b ^ 0x36 for b in key).hex()
    outer = bytes(b ^ 0x5C for b in key).hex()
    return inner, outer


def hmac_sha256_hex(body: Column, secret: str) -> Column:
    """RFC 2104 HMAC-SHA256 of the UTF-8 body as lower-case hex.

    Built from two ``sha2`` calls over ``key xor pad`` prefixes, so it runs
    in whole-stage codegen with no Python UDF.
    """
    inner, outer = _pads(secret)
    h1 = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(body, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(h1)), 256)


def signature_ok(body: Column, signature: Column, secret: str | None) -> Column:
    """True when ``signature`` (optionally ``sha256=``-prefixed) matches.

    The first ``sha256=`` occurrence is removed, hex is compared without
    regard to case.  A missing secret or signature never verifies.
    """
    if not secret:
        return F.lit(False)
    clean = F.regexp_replace(signature, "(?s)^(.*?)sha256=", "$1")
    return F.coalesce(F.lower(clean) == hmac_sha256_hex(body, secret),
                      F.lit(False))
