"""Rounding by the exact value that a double stores, halves to the even digit.

``round`` and ``bround`` look at the shortest decimal that prints the same, so 2.675, stored a little lower,
becomes 2.68. Here the value times a power of ten is split into two doubles whose sum is exact; only if the
first part lies on a half does the sign of the second decide.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float(2**27 + 1)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def round_stored(value: Column, digits: int) -> Column:
    """``value`` (double) to at most six digits; NULL, NaN, infinities and values from 2 ** 52 / 10 ** digits on stay."""
    if not 0 <= digits <= 6:
        raise ValueError("digits must be between 0 and 6")
    scale = float(10**digits)

    def with_parts(p: Column) -> Column:
        high, low = p["high"] * scale, p["low"] * scale  # exact: 26 bits times at most 14
        total = high + low
        rest = low - (total - high)
        down = F.floor(total).cast("double")
        half = (total - down) == 0.5
        whole = F.when(half & (rest > 0), down + 1).when(half & (rest < 0), down).otherwise(F.rint(total))
        return F.when(F.abs(p["x"]) < 2.0**52 / scale, whole / scale).otherwise(p["x"])

    def parts(x: Column) -> Column:
        near = x * _SPLIT
        high = near - (near - x)
        return F.struct(x.alias("x"), high.alias("high"), (x - high).alias("low"))

    return _let(_let(value.cast("double"), parts), with_parts)
