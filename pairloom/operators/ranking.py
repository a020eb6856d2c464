"""Exact ranks and running totals that never put a whole group into one task.

``row_number() over (partition by key order by x)`` sorts a hot key in one task. Here the
order is first cut into buckets that follow it (equal-depth bounds of a numeric column, or
the leading digits of a hash): rows are ranked inside (key, bucket) and shifted by the
sizes of the earlier buckets. Only the size table (keys x buckets) is ever windowed by key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 3
_STEPS = (512, 256, 128, 64, 32, 16, 8, 4, 2, 1)
BOUNDS = sum(_STEPS)


def hash_bucket(hex_hash: Column, digits: int = HASH_DIGITS) -> Column:
    """Leading hex digits; order-preserving for an order on the hash text."""
    return F.substring(hex_hash, 1, digits)


def depth_bounds(df: DataFrame, value: Column) -> list[float]:
    """At most 1023 equal-depth cut points of a numeric column (fixed-size result)."""
    shares = [i / (BOUNDS + 1) for i in range(1, BOUNDS + 1)]
    row = df.agg(F.percentile_approx(value.cast("double"), shares, 10000).alias("b")).first()
    return list(row["b"] or [])


def depth_bucket(value: Column, bounds: Sequence[float]) -> Column:
    """Number of bounds below ``value`` by binary search (ten comparisons per row)."""
    if not bounds:
        return F.lit(0)
    padded = [*bounds, *[float("inf")] * (BOUNDS - len(bounds))]
    cuts = F.lit(np.asarray(padded, dtype="float64"))
    steps = F.lit(np.asarray(_STEPS, dtype="int32"))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(
            F.element_at(cuts, low + step) < value.cast("double"), low + step
        ).otherwise(low),
    )


def _same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return cond


def exact_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """1-based row number within ``keys`` by (``bucket``, ``order``).

    ``bucket`` must not decrease along ``order``. ``total`` optionally names a column that
    receives the group size, at no further shuffle of ``df``.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(by_key).alias("_total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = rows.withColumn("_inside", F.row_number().over(inside))
    joined = ranked.alias("l").join(
        starts.alias("r"), _same_keys("l", "r", [*keys, "_bucket"]), "inner"
    )
    out = [F.col(f"l.{c}") for c in df.columns]
    out.append((F.col("l._inside") + F.col("r._start")).cast("bigint").alias(name))
    if total:
        out.append(F.col("r._total").cast("bigint").alias(total))
    return joined.select(*out)


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn"
) -> DataFrame:
    """First ``n`` rows per key for a fixed ``n``.

    ``row_number() <= literal`` is planned with a group limit on the map side, so a hot
    key sends at most ``n`` rows per task through the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= F.lit(n))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    sums: dict[str, str],
) -> DataFrame:
    """Inclusive running sums within ``keys`` along (``bucket``, ``order``).

    ``sums`` maps a source column to the name of its running sum.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    per_bucket = rows.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(f"_s_{c}") for c in sums]
    )
    before = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = per_bucket.select(
        *keys,
        "_bucket",
        *[
            F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_start_{c}")
            for c in sums
        ],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for c in sums:
        rows = rows.withColumn(f"_in_{c}", F.sum(c).over(inside))
    joined = rows.alias("l").join(
        starts.alias("r"), _same_keys("l", "r", [*keys, "_bucket"]), "inner"
    )
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"l._in_{c}") + F.col(f"r._start_{c}")).alias(out) for c, out in sums.items()],
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], col: str, shares: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact interpolated quantiles per key, one column per share.

    ``percentile`` gathers every distinct value of a group in one task. Here equal values are
    counted map-side, the counts are summed up along the values in slices, and only the rows
    that cover a wanted position are kept.
    """
    keys = list(keys)
    value = F.col(col).cast("double")
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, value.alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    bounds = depth_bounds(df, F.col(col))
    summed = running_totals(counts, keys, [F.col("_v")], depth_bucket(F.col("_v"), bounds), {"_n": "_upto"})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        placed = summed.alias("l").join(totals.alias("r"), _same_keys("l", "r", keys)).select(
            *[F.col(f"l.{k}") for k in keys], "_v", "_n", "_upto", "_total"
        )
    else:
        row = totals.first()
        placed = summed.withColumn("_total", F.lit(row["_total"] if row else None).cast("bigint"))
    first = F.col("_upto") - F.col("_n")  # positions first .. upto-1, counted from 0
    aggs, wanted = [], F.lit(False)
    for share, name in zip(shares, names):
        at = (F.col("_total") - 1) * F.lit(float(share))
        low, high = F.floor(at), F.ceil(at)
        covers = lambda p: (p >= first) & (p < F.col("_upto"))
        wanted = wanted | covers(low) | covers(high)
        v_low, v_high = F.max(F.when(covers(low), F.col("_v"))), F.max(F.when(covers(high), F.col("_v")))
        aggs.append((v_low + (v_high - v_low) * F.max(at - low)).alias(name))
    return placed.where(wanted).groupBy(*keys).agg(*aggs)
