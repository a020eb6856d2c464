"""Augmentation of long series, a sample a row: the steps that need no other sample, and short convolutions.

The whole chain works on blocks: see ``block_augment``. Every step keeps the length of the series.
A series is (track_id, pos, value, n). Parameters are numbers or columns, so a step can draw
its own strength per track. Random draws are hashes of (seed, track, position).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_int, hash_normal, hash_unit

_COLS = ("track_id", "pos", "value", "n")


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def gain(series: DataFrame, db: Column | float) -> DataFrame:
    return series.withColumn("value", F.col("value") * F.pow(F.lit(10.0), _col(db) / F.lit(20.0)))


def _noise_scale(power: Column, snr: Column | float) -> Column:
    return F.sqrt(power / F.pow(F.lit(10.0), _col(snr) / F.lit(10.0)))


def _with_power(series: DataFrame) -> DataFrame:
    power = series.groupBy("track_id").agg(F.avg(F.col("value") * F.col("value")).alias("_power"))
    return series.join(power, "track_id")


def add_noise(series: DataFrame, snr: Column | float, seed: str | int = 42, on: Column | None = None) -> DataFrame:
    """White noise at a signal-to-noise ratio in dB; ``on`` limits it to some tracks."""
    noise = hash_normal(f"{seed}|white", F.col("track_id"), F.col("pos")) * _noise_scale(F.col("_power"), snr)
    if on is not None:
        noise = F.when(on, noise).otherwise(F.lit(0.0))
    return _with_power(series).withColumn("value", F.col("value") + noise).select(*_COLS)


def decay_kernel(taps: int, seed: int = 42) -> list[tuple[int, float]]:
    """Decaying noise scaled by its largest absolute value."""
    rng = np.random.default_rng(int(seed))
    h = rng.standard_normal(taps) * np.exp(-np.linspace(0.0, 5.0, taps))
    h = h / (np.abs(h).max() + 1e-8)
    return [(int(k), float(v)) for k, v in enumerate(h)]


def convolve(series: DataFrame, kernel: list[tuple[int, float]], wet: Column | float) -> DataFrame:
    """(1 − wet)·x + wet·(x * h), cut to the length of x, for a few taps: each sample is spread over them."""
    share = lambda k, h: F.struct(F.lit(k).alias("k"), h.alias("h"))
    taps = F.array(share(0, F.lit(1.0) - _col(wet)), *[share(k, F.lit(h) * _col(wet)) for k, h in kernel])
    shifted = series.select("track_id", "n", "pos", "value", F.explode(taps).alias("_t"))
    added = shifted.select("track_id", "n", (F.col("pos") + F.col("_t.k")).alias("pos"), (F.col("value") * F.col("_t.h")).alias("value"))
    return (
        added.where(F.col("pos") < F.col("n")).groupBy("track_id", "pos")
        .agg(F.sum("value").alias("value"), F.max("n").alias("n")).select(*_COLS)
    )


def crop(series: DataFrame, low: int, high: int, seed: str | int = 42, on: Column | None = None) -> DataFrame:
    """A hashed piece of low..high samples moved to the front, zeros behind it; series not
    longer than ``low`` stay as they are. A map-side step."""
    span = F.least(F.lit(high), F.col("n")) - F.lit(low) + 1
    length = F.lit(low) + hash_int(f"{seed}|len", F.col("track_id")) % span
    rows = series.withColumn("_len", length)
    start = hash_int(f"{seed}|off", F.col("track_id")) % (F.col("n") - F.col("_len") + 1)
    rows = rows.withColumn("_start", start)
    applies = F.col("n") > low
    if on is not None:
        applies = applies & on
    inside = F.col("pos").between(F.col("_start"), F.col("_start") + F.col("_len") - 1)
    piece = lambda keep, pos, value: F.when(keep, F.struct(pos.alias("pos"), value.alias("value")))
    moved = F.filter(
        F.array(
            piece(applies & inside, F.col("pos") - F.col("_start"), F.col("value")),
            piece(applies & (F.col("pos") >= F.col("_len")), F.col("pos"), F.lit(0.0)),
            piece(~applies, F.col("pos"), F.col("value")),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("track_id", "n", F.explode(moved).alias("_r")).select("track_id", "_r.pos", "_r.value", "n")


def perturb(vectors: DataFrame, sigma: float, p: float, seed: str | int = 42) -> DataFrame:
    """Gaussian noise, then dropout, on a long vector table (track_id, chunk, dim, value)."""
    keys = [F.col("track_id"), F.col("chunk"), F.col("dim")]
    value = F.col("value")
    if sigma > 0:
        value = value + F.lit(float(sigma)) * hash_normal(f"{seed}|feat", *keys)
    if p > 0:
        value = value * (hash_unit(f"{seed}|drop", *keys) > p).cast("double")
    return vectors.withColumn("value", value)
