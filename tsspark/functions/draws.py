"""Random numbers as a pure function of a key.

The same key gives the same number on every executor, in every partitioning and on every retry, so an
augmented table can be recomputed after a lost executor without changing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column | str | int) -> Column:
    """Number in [0, 1) from the first 32 bits of the md5 of ``seed|key...``."""
    parts = [F.lit(str(seed))] + [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def integer(seed: int, low: Column, high: Column, *key: Column | str | int) -> Column:
    """Whole number in [low, high)."""
    return low + F.floor(uniform(seed, *key) * (high - low)).cast("bigint")


def normal(seed: int, *key: Column | str | int) -> Column:
    """Standard normal by Box-Muller; 1 - u keeps the logarithm finite."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, *key, "r")))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, *key, "a"))
