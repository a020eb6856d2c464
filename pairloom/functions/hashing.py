"""Deterministic pseudo-random draws: an md5 over ``seed|key|…``.

The same text hashes to the same value in any SQL engine and on any executor, so a
retried task or a re-run draws the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: number of values of ``hash_int``
RANGE = float(1 << 60)


def hash_hex(seed: str | int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_int(seed: str | int, *keys: Column) -> Column:
    """60-bit non-negative integer as bigint: a remainder by any table size stays even."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 15), 16, 10).cast("bigint")


def hash_unit(seed: str | int, *keys: Column) -> Column:
    """Uniform draw in [0, 1)."""
    return hash_int(seed, *keys) / F.lit(RANGE)


def hash_normal(seed: str | int, *keys: Column) -> Column:
    """Standard normal draw (Box-Muller on two hashed uniforms).

    Unlike ``randn(seed)`` it depends on the row's key only, not on partitioning or on row
    order after a shuffle, so a recomputed partition repeats its noise.
    """
    u = (hash_int(f"{seed}|u", *keys) + 1) / F.lit(RANGE)
    v = hash_int(f"{seed}|v", *keys) / F.lit(RANGE)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def hash_between(seed: str | int, low: float, high: float, *keys: Column) -> Column:
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * hash_unit(seed, *keys)
