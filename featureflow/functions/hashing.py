"""Seeded fractions, folds and fingerprints that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_digest(key, seed: int) -> Column:
    """md5 text of `seed:key`; its text order is a seeded random order of the keys."""
    keys = key if isinstance(key, (list, tuple)) else [key]
    parts = [_col(k).cast("string") for k in keys]
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *parts)).cast("binary"))


def key_hash32(key, seed: int) -> Column:
    return F.conv(F.substring(key_digest(key, seed), 1, 8), 16, 10).cast("bigint")


def key_fraction(key, seed: int) -> Column:
    """Uniform number in [0, 1) that is a function of the key and the seed only."""
    return key_hash32(key, seed) / F.lit(TWO_32)
