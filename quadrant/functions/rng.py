"""Seeded randomness that depends on ids alone: the same on any partitioning, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, *parts: Column | str) -> Column:
    """A pseudo-random text by which to order rows: md5 of seed:part:part..."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def uniform(seed: int, *parts: Column | str) -> Column:
    """A double in [0, 1): the first 32 bits of order_key over 2^32."""
    return F.conv(F.substring(order_key(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
