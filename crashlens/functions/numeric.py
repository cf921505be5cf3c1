"""Exact rounding of ratios.

Rounding a double at a tie differs between engines; ratios of integers are
rounded here with integer arithmetic (HALF_UP), which is exact at any scale
because the operands are widened to decimal(38,0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DEC = "decimal(38,0)"


def _floor_div(a: Column, b: Column) -> Column:
    """Exact ``a div b`` for non-negative decimals: ``(a - a % b) / b``."""
    return ((a - a % b) / b).cast(_DEC)


def _half_up(num: Column, den: Column, digits: int) -> Column:
    # HALF_UP(num / den) at `digits` decimals == floor((2*num*p + den) / (2*den)) / p
    p = 10 ** digits
    n = (num.cast(_DEC) * F.lit(2 * p).cast(_DEC)).cast(_DEC)
    d = den.cast(_DEC)
    whole = (n + d).cast(_DEC)
    two_d = (d * F.lit(2).cast(_DEC)).cast(_DEC)
    # the quotient by 10^digits stays decimal (scale 6 at least), so the cast to double is the only rounding
    return F.when(d != 0, (_floor_div(whole, two_d) / F.lit(p).cast(_DEC)).cast("double"))


def round_ratio(num: Column, den: Column, digits: int = 2,
                scale: int = 1) -> Column:
    """HALF_UP round of ``num * scale / den`` to ``digits`` decimals (double).

    ``num`` and ``den`` are non-negative integers; a zero or NULL
    denominator gives NULL, as ``NULLIF(den, 0)`` does.
    """
    if scale != 1:
        num = num.cast(_DEC) * F.lit(scale).cast(_DEC)
    return _half_up(num, den, digits)


def avg_scaled_half_up(total: Column, count: Column, divisor: int,
                       digits: int) -> Column:
    """``round(avg(x) / divisor, digits)`` from ``sum(x)`` and ``count(x)``.

    ``x`` is an integer column, so ``sum`` is exact and only one division
    and one rounding happen.
    """
    den = count.cast(_DEC) * F.lit(divisor).cast(_DEC)
    return _half_up(total, den, digits)
