"""Seeded pseudo-random numbers that depend on values only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def seeded_hash(seed: int | str, *keys: Column) -> Column:
    """Uniform integer in [0, 2**60): the first 15 hex digits of md5('seed:key:key...')."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def seeded_fraction(seed: int | str, *keys: Column) -> Column:
    """Uniform double in [0, 1)."""
    return seeded_hash(seed, *keys) / F.lit(float(1 << HASH_BITS))
