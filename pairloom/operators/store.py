"""Feature store keyed by content: keys, lookups with fallback, incremental refresh, statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import cut_lineage

WINDOW_SECONDS = 10.0
STRIDE_SECONDS = 5.0
RATE = 16000
EPSILON = 1e-8


def cache_key(
    path: Column,
    variant: Column | int = 0,
    window: float = WINDOW_SECONDS,
    stride: float = STRIDE_SECONDS,
    sr: int = RATE,
) -> Column:
    """sha256 of ``path|window|stride|sr``, with ``|aug_v`` for variants above 0."""
    variant = variant if isinstance(variant, Column) else F.lit(variant)
    suffix = F.when(variant > 0, F.concat(F.lit("aug_"), variant.cast("string")))
    # concat_ws leaves a null suffix out
    text = F.concat_ws("|", path, F.lit(str(float(window))), F.lit(str(float(stride))), F.lit(str(sr)), suffix)
    return F.sha2(text, 256)


def lookup_features(jobs: DataFrame, store: DataFrame) -> DataFrame:
    """Features for (path, variant): the variant's own, else the raw ones, else to compute.

    ``store`` is (cache_key, features), one row per key.
    """
    own = store.select(F.col("cache_key").alias("_k"), F.col("features").alias("_own"))
    raw = store.select(F.col("cache_key").alias("_k0"), F.col("features").alias("_raw"))
    keyed = jobs.withColumn("_k", cache_key(F.col("path"), F.col("variant"))).withColumn(
        "_k0", cache_key(F.col("path"))
    )
    joined = keyed.join(own, "_k", "left").join(raw, "_k0", "left")
    origin = (
        F.when(F.col("_own").isNotNull(), "variant").when(F.col("_raw").isNotNull(), "raw").otherwise("compute")
    )
    return joined.select(
        *jobs.columns, F.coalesce("_own", "_raw").alias("features"), origin.alias("origin")
    )


def missing_jobs(jobs: DataFrame, store: DataFrame) -> DataFrame:
    keyed = jobs.withColumn("cache_key", cache_key(F.col("path"), F.col("variant")))
    return keyed.join(store.select("cache_key"), "cache_key", "left_anti")


def refresh_store(
    jobs: DataFrame, store: DataFrame, compute: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Compute what the store lacks: (new rows, status counts).

    ``compute`` maps jobs (cache_key, path, variant) to (cache_key, features, error); a failed
    job is a row with an error and no features, so one bad input never stops the rest. The
    new rows are written once and read by the counts and by the append.
    """
    todo = missing_jobs(jobs, store)
    done = cut_lineage(compute(todo).select("cache_key", "features", "error"))
    total = jobs.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit("skipped").alias("status"))
    ran = done.groupBy(F.when(F.col("error").isNull(), "computed").otherwise("failed").alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )
    skipped = total.unionByName(ran.select((-F.col("n")).alias("n"), F.lit("skipped").alias("status")))
    counts = skipped.groupBy("status").agg(F.sum("n").alias("n")).unionByName(ran)
    return done.where(F.col("error").isNull()).select("cache_key", "features"), counts


def feature_stats(store: DataFrame, col: str = "features") -> DataFrame:
    """Mean and sample deviation per dimension in one row of two arrays.

    One mergeable pass over vectors; fewer than two vectors is an error, arrays that are
    null are left out.
    """
    vectors = store.where(F.col(col).isNotNull()).select(
        array_to_vector(F.col(col).cast("array<double>")).alias("_v")
    )
    out = vectors.agg(
        Summarizer.metrics("mean", "std", "count").summary(F.col("_v")).alias("_s")
    ).select(
        F.col("_s.count").alias("count"),
        vector_to_array(F.col("_s.mean")).alias("mean"),
        vector_to_array(F.col("_s.std")).alias("std"),
    )
    few = F.raise_error(F.concat(F.lit("too few vectors: "), F.col("count").cast("string")))
    return out.withColumn("mean", F.when(F.col("count") >= 2, F.col("mean")).otherwise(few))


def standardise(df: DataFrame, stats: DataFrame, col: str = "features") -> DataFrame:
    """(x − mean) / (std + 1e-8); the statistics are one row of fixed size."""
    row = stats.select("mean", "std").first()
    mean = F.lit(np.asarray(row["mean"], dtype="float64"))
    scale = F.lit(np.asarray(row["std"], dtype="float64") + EPSILON)
    centred = F.zip_with(F.col(col).cast("array<double>"), mean, lambda x, m: x - m)
    return df.withColumn(col, F.zip_with(centred, scale, lambda x, s: x / s))
