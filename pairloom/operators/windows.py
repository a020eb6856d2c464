"""Overlapping windows of long numeric series.

A series is a long table (track_id, pos, value, n): one row per sample, ``n`` the length of
its track. Windows of w samples every s samples: one if n <= w, else ceil((n - w) / s) + 1;
what a window misses at its end is zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_int
from pairloom.operators.ranking import depth_bounds, depth_bucket, exact_rank


def positions(events: DataFrame, track: str, time: str, tie: str, value: str) -> DataFrame:
    """Long series from time-stamped rows: position within the track by (time, tie).

    A track with a third of all rows is ranked in up to 1024 time slices.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.select(
        F.col(track).alias("track_id"), micros.alias("_t"), F.col(tie).alias("_tie"),
        F.col(value).cast("double").alias("value"),
    )
    bounds = depth_bounds(rows, F.col("_t"))
    ranked = exact_rank(
        rows, ["track_id"], [F.col("_t"), F.col("_tie")], depth_bucket(F.col("_t"), bounds),
        name="_rn", total="n",
    )
    return ranked.select("track_id", (F.col("_rn") - 1).alias("pos"), "value", "n")


def window_count(n: Column, w: int, s: int) -> Column:
    return F.when(n <= w, F.lit(1)).otherwise(F.ceil((n - w) / F.lit(s)) + 1).cast("int")


def chunk_array(df: DataFrame, col: str, w: int, s: int) -> DataFrame:
    """Windows of an array column, padded with zeros (short series only)."""
    last = window_count(F.size(col), w, s) - 1
    start = F.col("chunk") * s
    piece = F.slice(F.col(col), start + 1, F.lit(w))
    padded = F.concat(piece, F.array_repeat(F.lit(0.0), F.lit(w) - F.size(piece)))
    others = [c for c in df.columns if c != col]
    return (
        df.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("samples", padded)
        .select(*others, "chunk", "samples")
    )


def _padding(series: DataFrame, keys: Sequence[str], n: Column, w: int, s: int) -> DataFrame:
    """Zero samples that fill the last window of each track; at most w per track.

    Made from the row at position 0, so no grouping is needed.
    """
    last = window_count(n, w, s) - 1
    used = n - last * s
    first = series.where(F.col("pos") == 0).select(
        *keys, "n", last.alias("chunk"), F.greatest(used, F.lit(0)).cast("int").alias("_used")
    ).where(F.col("_used") < w)
    return first.select(
        *keys, "n", "chunk",
        F.explode(F.sequence(F.col("_used"), F.lit(w - 1))).alias("i"),
        F.lit(0.0).alias("value"),
    )


def chunk_rows(
    series: DataFrame, w: int, s: int, pad: bool = True, keys: Sequence[str] = ("track_id",)
) -> DataFrame:
    """(keys, chunk, i, value): each sample goes to the windows that cover it.

    A map-side expansion: no shuffle and no window function.
    """
    keys = list(keys)
    count = window_count(F.col("n"), w, s)
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - (w - 1)) / F.lit(s)))
    hi = F.least(count - 1, F.floor(F.col("pos") / F.lit(s)))
    spread = series.select(
        *keys, "n", "pos", "value", lo.cast("int").alias("_lo"), hi.cast("int").alias("_hi")
    ).where(F.col("_lo") <= F.col("_hi"))
    real = spread.select(
        *keys, "n", F.explode(F.sequence("_lo", "_hi")).alias("chunk"), "pos", "value"
    ).select(*keys, "n", "chunk", (F.col("pos") - F.col("chunk") * s).cast("int").alias("i"), "value")
    if pad:
        real = real.unionByName(_padding(series, keys, F.col("n"), w, s))
    return real.select(*keys, "chunk", "i", "value")


def window_features(events: DataFrame, size: str, slide: str, track: str, time: str, value: str) -> DataFrame:
    """Event-time windows per track: count, mean, deviation, extremes."""
    window = F.window(F.col(time), size, slide)
    return (
        events.groupBy(F.col(track).alias("track_id"), window.alias("_w"))
        .agg(*window_aggregates(F.col(value)))
        .select(
            "track_id",
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            "n", "mean", "std", "low", "high",
        )
    )


def window_aggregates(value: Column) -> list[Column]:
    return [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ]


def fit_windows(
    vectors: DataFrame,
    counts: DataFrame,
    slots: int = 12,
    training: bool = False,
    seed: str | int = 42,
) -> DataFrame:
    """Exactly ``slots`` windows per track of a long vector table (track_id, chunk, dim, value).

    ``counts`` is (track_id, chunks). Evaluation keeps the first ones; training starts at a
    hashed offset; missing ones are zero vectors of the dimensions the track has.
    """
    spare = F.greatest(F.col("chunks") - slots, F.lit(0))
    start = hash_int(f"{seed}|start", F.col("track_id")) % (spare + 1) if training else F.lit(0)
    offsets = counts.select("track_id", "chunks", start.cast("int").alias("_start"))
    kept = (
        vectors.join(offsets, "track_id")
        .withColumn("slot", F.col("chunk") - F.col("_start"))
        .where(F.col("slot").between(0, slots - 1))
        .select("track_id", "slot", "dim", "value")
    )
    # a track's dimensions are those of its first window
    short = vectors.where(F.col("chunk") == 0).join(
        offsets.where(F.col("chunks") < slots), "track_id"
    )
    pads = short.select(
        "track_id",
        F.explode(F.sequence(F.col("chunks").cast("int"), F.lit(slots - 1))).alias("slot"),
        "dim",
        F.lit(0.0).alias("value"),
    )
    return kept.unionByName(pads)


def pad_short(col: Column, n: int) -> Column:
    return F.concat(col, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(n) - F.size(col))))


def tile_vector(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def pad_to_group_max(vectors: DataFrame, counts: DataFrame, group: str) -> DataFrame:
    """Pad each track of a batch to the batch's largest window count.

    The maximum is a grouped aggregate (combined map-side), not a window over the batch.
    """
    largest = counts.groupBy(group).agg(F.max("chunks").alias("_max"))
    short = counts.join(largest, group).where(F.col("chunks") < F.col("_max"))
    dims = vectors.where(F.col("chunk") == 0).select("track_id", "dim")
    pads = dims.join(short, "track_id").select(
        group, "track_id",
        F.explode(F.expr("sequence(cast(chunks AS int), cast(_max AS int) - 1)")).alias("chunk"),
        "dim", F.lit(0.0).alias("value"),
    )
    named = vectors.join(counts.select("track_id", group), "track_id")
    return named.select(group, "track_id", "chunk", "dim", "value").unionByName(pads)


def framed_chunks(series: DataFrame, frame: int, w: int, s: int, pad: bool = True) -> DataFrame:
    """Frames of ``frame`` samples first, then windows inside each frame; none spans two frames."""
    index = F.floor(F.col("pos") / F.lit(frame))
    framed = series.select(
        "track_id",
        index.alias("frame"),
        (F.col("pos") % frame).alias("pos"),
        "value",
        F.least(F.lit(frame), F.col("n") - index * frame).alias("n"),
    )
    return chunk_rows(framed, w, s, pad, ["track_id", "frame"])


def route_by_duration(files: DataFrame, samples: str, rate: int, threshold: float = 300.0) -> DataFrame:
    duration = F.col(samples) / F.lit(float(rate))
    return files.withColumn("duration", duration).withColumn(
        "route", F.when(duration > threshold, "long").otherwise("short")
    )


def truncate_series(series: DataFrame, n: int) -> DataFrame:
    return series.where(F.col("pos") < n).withColumn("n", F.least("n", F.lit(n)))


def tracks(series: DataFrame) -> DataFrame:
    """(track_id, n) without grouping: every track has one sample at position 0."""
    return series.where(F.col("pos") == 0).select("track_id", "n")

