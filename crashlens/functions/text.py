"""String expressions: sanitiser, platform aliases, search."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashlens.schema import PLATFORM_ALIASES, SANITIZED_MAX, UNKNOWN

# Removed outright: control characters \x00-\x1F and \x7F (newlines and
# tabs too) and the angle brackets < and >.
REMOVED_CHARS = "[\\x00-\\x1F\\x7F<>]"
# White space that a JavaScript String.trim() strips once control characters
# are gone: space, no-break space, U+1680, U+2000-U+200A, line and paragraph
# separators, U+202F, U+205F, U+3000 and the byte-order mark.
TRIM_CHARS = (" \u00A0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
              + "\u2028\u2029\u202F\u205F\u3000\uFEFF")


def sanitize(col: Column, max_len: int = SANITIZED_MAX) -> Column:
    """Remove control chars and ``<``/``>``, trim, cut to ``max_len``.

    One regex pass removes both character classes; the trim is the native
    ``btrim`` with an explicit character set.  NULL stays NULL and '' stays
    ''.  Lengths count code points.
    """
    out = F.regexp_replace(col, REMOVED_CHARS, "")
    out = F.btrim(out, F.lit(TRIM_CHARS))
    return F.substring(out, 1, max_len)


def normalize_platform(col: Column) -> Column:
    """Map OS identifiers (``win32``, ``darwin`` …) to report platforms."""
    mapping = F.create_map(*[F.lit(x) for x in chain(*PLATFORM_ALIASES.items())])
    return F.coalesce(mapping[F.lower(col)], col)


def left(col: Column, n: int) -> Column:
    """First ``n`` characters (SQL ``LEFT``)."""
    return F.substring(col, 1, n)


def contains_ci(col: Column, needle: str) -> Column:
    """Case-insensitive literal substring test (``%`` and ``_`` literal)."""
    return F.contains(F.lower(col), F.lower(F.lit(needle)))


def unknown_if_blank(col: Column) -> Column:
    """NULL or '' becomes ``'unknown'``."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(UNKNOWN))
