"""Corpus profiles: counts, shares, distributions and group contrasts of feature vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.evaluation import bucket_index
from pairloom.operators.ranking import exact_quantiles

# fixed values: words left out of the word counts
STOP_WORDS = ("a", "the", "and", "of", "with", "in", "on", "is", "to", "it", "an", "for", "are", "by")
POOLED_EPS = 1e-10


# ---- tables
def profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls, distinct-free numeric summary (null for other types)."""
    numeric = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in df.columns:
        v = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        aggs.append(
            F.struct(
                F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.min(v).alias("low"), F.max(v).alias("high"),
            ).alias(f"_c_{c}")
        )
    row = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c_{c}").alias("s")) for c in df.columns])
    return row.select("_rows", F.explode(entries).alias("e")).select(
        F.col("e.column").alias("column"), F.col("_rows").alias("n"), "e.s.nulls", "e.s.mean", "e.s.std", "e.s.low", "e.s.high"
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value with their share in percent (one decimal)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    # the total is a mergeable aggregate of one row, read once
    total = df.count()
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / max(total, 1), 1)).orderBy(F.desc("n"), col)


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts of row x column values, absent combinations 0.

    Give ``values`` to spare the pass that finds them.
    """
    pivot = df.groupBy(row).pivot(col, list(values)) if values else df.groupBy(row).pivot(col)
    return pivot.count().na.fill(0)


def numeric_stats(df: DataFrame, col: str) -> DataFrame:
    """Minimum, maximum, mean and exact median in one row."""
    middle = exact_quantiles(df, [], col, [0.5], ["median"]).first()
    return df.agg(F.min(col).alias("low"), F.max(col).alias("high"), F.avg(col).alias("mean")).withColumn(
        "median", F.lit(middle["median"]).cast("double")
    )


def histogram(df: DataFrame, col: str, bins: int, group: str | None = None) -> DataFrame:
    """Equal-width counts over the column's whole range, optionally per group."""
    span = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    low, high = F.lit(span["lo"]), F.lit(span["hi"])
    keys = [group] if group else []
    binned = df.withColumn("bin", bucket_index(F.col(col).cast("double"), low, high, bins))
    return binned.where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def text_coverage(df: DataFrame, text: str) -> DataFrame:
    """Rows with text, their percentage, and word lengths over them."""
    has = F.col(text).isNotNull() & (F.trim(F.col(text)) != "")
    words = F.when(has, word_count(F.col(text)))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has).alias("with_text"),
        (F.count_if(has) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("percent"),
        F.avg(words).alias("mean_words"),
        F.max(words).alias("max_words"),
    )


def top_words(df: DataFrame, text: str, k: int = 20, stop: Sequence[str] = STOP_WORDS, longer_than: int = 2) -> DataFrame:
    """Most frequent words; ties by word. Counts are combined before the shuffle."""
    words = df.select(F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("word"))
    kept = words.where((F.length("word") > longer_than) & ~F.col("word").isin(list(stop)))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def count_by(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def quartiles(df: DataFrame, col: str, group: str) -> DataFrame:
    """Exact quartiles per group."""
    return exact_quantiles(df, [group], col, [0.25, 0.5, 0.75], ["q1", "q2", "q3"])


def segment_durations(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, start, end, duration) of the segments in a text literal ``[[s, e], …]`` or
    ``[s, e]``; text that is neither gives no rows, and duration is null unless end > start."""
    nested = F.from_json(F.col(text), "array<array<double>>")
    flat = F.from_json(F.col(text), "array<double>")
    usable = lambda x: x.isNotNull() & (F.size(x) >= 2)
    pieces = F.when(
        F.col(text).rlike(r"^\s*\[\s*\["), F.filter(nested, usable)
    ).otherwise(F.when(usable(flat), F.array(flat)))
    rows = df.select(key, F.explode(pieces).alias("_p"))
    start, end = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    return rows.select(
        key, start.alias("start"), end.alias("end"), F.when(end > start, end - start).alias("duration")
    ).where(F.col("start").isNotNull() & F.col("end").isNotNull())


# ---- feature matrices: (group, vector) -> long form, then grouped aggregates
def melt(vectors: DataFrame, keys: Sequence[str], col: str = "vector") -> DataFrame:
    return vectors.select(*keys, F.posexplode(F.col(col).cast("array<double>")).alias("dim", "value"))


def melt_dims(vectors: DataFrame, keys: Sequence[str], dims: Sequence[int], col: str = "vector") -> DataFrame:
    """Long form of selected dimensions only; others are never exploded."""
    picked = F.array(
        *[F.struct(F.lit(d).alias("dim"), F.get(F.col(col), F.lit(d)).cast("double").alias("value")) for d in dims]
    )
    return vectors.select(*keys, F.explode(picked).alias("_r")).select(*keys, "_r.dim", "_r.value")


def matrix_stats(vectors: DataFrame, group: str, tiers: dict[str, tuple[int, int]], col: str = "vector") -> DataFrame:
    """Shape, mean, population deviation and extremes per group and tier (half-open ranges)."""
    named = F.array(*[F.lit(t) for t in tiers])
    inside = lambda name: reduce(
        lambda a, b: a | b,
        [(name == t) & (F.col("dim") >= lo) & (F.col("dim") < hi) for t, (lo, hi) in tiers.items()],
    )
    long = melt(vectors, [group], col).withColumn("tier", F.explode(named)).where(inside(F.col("tier")))
    rows = vectors.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    stats = long.groupBy(group, "tier").agg(
        (F.max("dim") - F.min("dim") + 1).alias("dims"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"),
    )
    return stats.join(rows, group)


def group_moments(vectors: DataFrame, group: str, col: str = "vector") -> DataFrame:
    """(group, dim): count, mean, population and sample variance — the one pass every contrast reads."""
    return melt(vectors, [group], col).groupBy(group, "dim").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.var_pop("value").alias("var_pop"), F.var_samp("value").alias("var_samp"),
    )


def _two(moments: DataFrame, group: str, a, b) -> DataFrame:
    side = lambda v, s: moments.where(F.col(group) == F.lit(v)).select(
        "dim", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "mean", "var_pop", "var_samp")]
    )
    return side(a, "a").join(side(b, "b"), "dim")


def _effect() -> Column:
    pooled = F.sqrt((F.col("var_pop_a") + F.col("var_pop_b")) / 2 + POOLED_EPS)
    return F.abs(F.col("mean_a") - F.col("mean_b")) / pooled


def cohens_d(vectors: DataFrame, group: str, a, b, col: str = "vector") -> DataFrame:
    """Standardised mean difference per dimension, largest first (``rank`` from 1)."""
    out = _two(group_moments(vectors, group, col), group, a, b).select("dim", _effect().alias("cohens_d"))
    # one row per dimension: the window sees the width of a vector, not the data
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cohens_d"), "dim")))


def _beta_tail(batch_t: pd.Series, batch_df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta."""
    from math import exp, lgamma, log

    out = []
    for t, v in zip(batch_t, batch_df):
        if t is None or v is None or not np.isfinite(t) or not np.isfinite(v) or v <= 0:
            out.append(1.0 if v is None or not np.isfinite(t) else np.nan)
            continue
        x, p, q = v / (v + t * t), v / 2.0, 0.5
        if x <= 0.0 or x >= 1.0:
            out.append(float(x >= 1.0))
            continue
        front = exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * log(x) + q * log(1.0 - x))
        flip = x > (p + 1.0) / (p + q + 2.0)
        a, b, z = (q, p, 1.0 - x) if flip else (p, q, x)
        tiny, d = 1e-300, 1.0 - (a + b) * z / (a + 1.0)
        c, d = 1.0, 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for num in (
                m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1.0 + num * d
                c = 1.0 + num / c
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        value = front * h / a
        out.append(1.0 - value if flip else value)
    return pd.Series(out, dtype="float64")


def welch_t(vectors: DataFrame, group: str, a, b, col: str = "vector") -> DataFrame:
    """Unequal-variance t, degrees of freedom and p per dimension; p = 1 if a group has fewer
    than two vectors. The p-value runs on one row per dimension."""
    m = _two(group_moments(vectors, group, col), group, a, b)
    va, vb = F.col("var_samp_a") / F.col("n_a"), F.col("var_samp_b") / F.col("n_b")
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    out = m.select(
        "dim",
        F.when(enough, (F.col("mean_a") - F.col("mean_b")) / F.sqrt(va + vb)).alias("t"),
        F.when(
            enough, (va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
        ).alias("df"),
    )
    tail = F.pandas_udf(_beta_tail, "double")
    return out.withColumn("p", F.when(F.col("t").isNull(), F.lit(1.0)).otherwise(tail(F.col("t"), F.col("df"))))


def top_features(
    vectors: DataFrame, group: str, a, b, k: int = 10, tiers: dict[str, tuple[int, int]] | None = None, col: str = "vector"
) -> DataFrame:
    """The k dimensions of greatest effect per tier with a significance flag (p < 0.05)."""
    tiers = tiers or {"combined": (0, 1 << 30)}
    both = cohens_d(vectors, group, a, b, col).drop("rank").join(welch_t(vectors, group, a, b, col), "dim")
    tagged = both.withColumn("tier", F.explode(F.array(*[F.lit(t) for t in tiers]))).where(
        reduce(
            lambda x, y: x | y,
            [(F.col("tier") == t) & (F.col("dim") >= lo) & (F.col("dim") < hi) for t, (lo, hi) in tiers.items()],
        )
    )
    order = Window.partitionBy("tier").orderBy(F.desc("cohens_d"), "dim")
    return (
        tagged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .withColumn("significant", F.col("p") < 0.05)
    )


def mean_diff(vectors: DataFrame, group: str, a, b, col: str = "vector") -> DataFrame:
    m = _two(group_moments(vectors, group, col), group, a, b)
    return m.select("dim", F.abs(F.col("mean_a") - F.col("mean_b")).alias("mean_diff"))


def group_profile(vectors: DataFrame, group: str, k: int = 20, col: str = "vector") -> DataFrame:
    """Group means of the k dimensions that vary most between groups, z-scored within each
    group over those dimensions (a constant row gives 0)."""
    means = group_moments(vectors, group, col).select(group, "dim", "mean")
    spread = means.groupBy("dim").agg(F.var_pop("mean").alias("_v"))
    best = spread.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_v"), "dim"))).where(F.col("rank") <= k)
    kept = means.join(best.select("dim", "rank"), "dim")
    row = kept.groupBy(group).agg(F.avg("mean").alias("_m"), F.stddev_pop("mean").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("mean") - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return kept.join(row, group).select(group, "dim", "rank", "mean", z.alias("z"))


def pairwise_cohens_d(vectors: DataFrame, source: str, k: int = 30, col: str = "vector") -> DataFrame:
    """Effect per dimension for every pair of sources, on the k dimensions of greatest maximum.

    The data is read once into (source, dim) moments; only that small table is paired.
    """
    m = group_moments(vectors, source, col)
    side = lambda s: m.select(
        "dim", F.col(source).alias(f"source_{s}"), F.col("mean").alias(f"mean_{s}"), F.col("var_pop").alias(f"var_pop_{s}")
    )
    d = side("a").join(side("b"), "dim").where(F.col("source_a") < F.col("source_b")).select(
        "source_a", "source_b", "dim", _effect().alias("cohens_d")
    )
    top = d.groupBy("dim").agg(F.max("cohens_d").alias("_top"))
    best = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_top"), "dim"))).where(F.col("rank") <= k)
    return d.join(best.select("dim", "rank"), "dim")


def _gram_batches(batches):
    """Per group of a task: count, sums and the product matrix X'X, one row per matrix row."""
    sums: dict = {}
    for batch in batches:
        for value, part in batch.groupby("g", sort=False)["v"]:
            x = np.stack(part.to_list()).astype("float64")
            x = np.hstack([np.ones((len(x), 1)), x])
            sums[value] = sums.get(value, 0.0) + x.T @ x
    for value, m in sums.items():
        yield pd.DataFrame({"g": value, "i": np.arange(len(m), dtype="int32"), "row": list(m)})


def _explained(k: int, share: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        size = int(pdf["i"].max()) + 1
        m = pdf["x"].to_numpy().reshape(size, size)
        n, total = m[0, 0], m[0, 1:]
        cov = (m[1:, 1:] - np.outer(total, total) / n) / max(n - 1, 1)
        values = np.clip(np.linalg.eigvalsh(cov)[::-1], 0.0, None)
        whole = values.sum()
        cumulative = np.cumsum(values / whole if whole > 0 else values)[: int(min(k, n, size - 1))]
        reached = int(np.searchsorted(cumulative, share)) + 1
        return pd.DataFrame(
            {
                "g": pdf["g"].iloc[0],
                "component": np.arange(1, len(cumulative) + 1, dtype="int32"),
                "cumulative": cumulative,
                "needed": pd.array([reached if reached <= len(cumulative) else None] * len(cumulative), dtype="Int32"),
            }
        )

    return run


def pca_profile(vectors: DataFrame, group: str, k: int = 30, share: float = 0.9, col: str = "vector") -> DataFrame:
    """Cumulative explained variance per group and the number of components that reach the share
    (null if the first k do not).

    One pass for all groups: each task reduces its rows to one product matrix per group, the
    matrices are added by a grouped sum, and a group's eigenvalues come from a matrix whose
    size is the vector's width squared, whatever the number of rows.
    """
    kind = dict(vectors.dtypes)[group]
    rows = vectors.select(F.col(group).alias("g"), F.col(col).cast("array<double>").alias("v"))
    partial = rows.mapInPandas(_gram_batches, f"g {kind}, i int, row array<double>")
    added = partial.select("g", "i", F.posexplode("row").alias("j", "x")).groupBy("g", "i", "j").agg(F.sum("x").alias("x"))
    out = added.groupBy("g").applyInPandas(
        _explained(k, share), f"g {kind}, component int, cumulative double, needed int"
    )
    return out.withColumnRenamed("g", group)


def project_2d(vectors: DataFrame, key: str, col: str = "vector", head: int | None = None) -> DataFrame:
    """Two principal coordinates of standardised vectors; ``head`` keeps the first rows by key
    for display."""
    rows = vectors if head is None else vectors.orderBy(key).limit(head)
    rows = rows.select(key, array_to_vector(F.col(col).cast("array<double>")).alias("_v"))
    scaled = StandardScaler(inputCol="_v", outputCol="_z", withMean=True).fit(rows).transform(rows)
    placed = PCA(k=2, inputCol="_z", outputCol="_p").fit(scaled).transform(scaled)
    xy = vector_to_array("_p")
    return placed.select(key, F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"))


def score_by_relation(scored: DataFrame, relation: str, score: str, order: Sequence) -> DataFrame:
    """Summary and quartiles of pair scores per relation, in a fixed display order."""
    stats = scored.groupBy(relation).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"),
        F.min(score).alias("low"), F.max(score).alias("high"),
    )
    place = F.coalesce(*[F.when(F.col(relation) == F.lit(v), F.lit(i)) for i, v in enumerate(order)], F.lit(len(order)))
    return stats.join(quartiles(scored, score, relation), relation).withColumn("position", place)


def corpus_totals(**catalogues: DataFrame) -> DataFrame:
    """Rows per catalogue and overall."""
    tagged = [df.select(F.lit(name).alias("source")) for name, df in catalogues.items()]
    both = reduce(lambda a, b: a.unionAll(b), tagged)
    counts = both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(counts.agg(F.lit("total").alias("source"), F.sum("n").alias("n")))
