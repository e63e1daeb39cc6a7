"""Seeded draws as columns: a hash of the seed and the row's own keys.

A draw depends on nothing but the row, so it is the same after a retry, a repartition or a
lost executor, and any SQL engine with md5 can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPAN = float(1 << 60)


def draw(seed, *keys) -> Column:
    """Uniform integer in [0, 2^60)."""
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    for key in keys:
        parts.append((F.col(key) if isinstance(key, str) else key).cast("string"))
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def draw_int(low, high, seed, *keys) -> Column:
    """Uniform integer in [low, high], both ends included."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return low + F.pmod(draw(seed, *keys), (high - low + 1).cast("bigint"))


def draw_unit(seed, *keys) -> Column:
    """Uniform double strictly inside (0, 1)."""
    return (draw(seed, *keys).cast("double") + F.lit(0.5)) / F.lit(_SPAN)
