"""Random numbers as functions of (seed, purpose, key): the same under any partitioning, and independent of each other."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, purpose: str, *key: Column) -> Column:
    """In (0, 1)."""
    h = F.xxhash64(F.lit(seed), F.lit(purpose), *key)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def normal(seed: int, purpose: str, *key: Column) -> Column:
    """Standard normal, by Box and Muller."""
    r = F.sqrt(-2.0 * F.log(uniform(seed, purpose + "/r", *key)))
    return r * F.cos(F.lit(2 * math.pi) * uniform(seed, purpose + "/a", *key))


def driver_rng(seed: int, purpose: str):
    """A numpy generator for small driver-side tables, by purpose."""
    import zlib

    import numpy as np

    return np.random.default_rng([seed, zlib.crc32(purpose.encode())])
