"""Catalogue preparation: existence filter, label mapping, captions, quotas, idempotent re-runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import depth_bounds, depth_bucket, exact_rank, first_rows


def keep_existing(cat: DataFrame, listing: DataFrame, cols: Sequence[str], path: str = "path") -> DataFrame:
    """Rows whose file is listed, for every path column; blank or null paths never match."""
    for col in cols:
        on_disk = listing.select(F.col(path).alias(col)).where(F.col(col) != "")
        cat = cat.join(on_disk, col, "left_semi").select(*cat.columns)
    return cat


def normalise_labels(fake: DataFrame, real: DataFrame) -> DataFrame:
    """Every fake variant becomes ``ai`` with its source as generator; real is (real, real)."""
    split = F.coalesce(F.col("split"), F.lit("train")).alias("split")
    fakes = fake.select(
        "filename",
        F.lit("ai").alias("label"),
        F.coalesce(F.col("source"), F.lit("unknown")).alias("generator"),
        split,
    )
    reals = real.select(
        "filename", F.lit("real").alias("label"), F.lit("real").alias("generator"), split
    )
    return fakes.unionByName(reals)


def dedupe_pairs(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row per key combination; partial aggregation keeps copies out of the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def sanitise(title: Column) -> Column:
    """Characters other than letters, digits, blank, ``-`` and ``_`` become ``_``."""
    cleaned = F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "_")
    return F.substring(F.trim(cleaned), 1, 100)


def pair_filename(pair_id: Column, side: str, title: Column) -> Column:
    number = pair_id.cast("string")
    padded = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    return F.concat(
        F.lit("pair"), padded, F.lit(f"_{side}_"), F.substring(sanitise(title), 1, 50), F.lit(".wav")
    )


def caption_lookup(captions: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One caption per trimmed key, the last row by ``order`` wins; null becomes ''."""
    if key not in captions.columns or text not in captions.columns:
        spark = captions.sparkSession
        return spark.createDataFrame([], f"{key} string, {text} string")
    cleaned = captions.select(
        F.trim(F.col(key).cast("string")).alias(key),
        F.coalesce(F.trim(F.col(text)), F.lit("")).alias(text),
        F.col(order).alias("_order"),
    ).where(F.col(key) != "")
    return cleaned.groupBy(key).agg(F.max_by(text, "_order").alias(text))


def attach_caption(tracks: DataFrame, lookup: DataFrame, key: str, text: str) -> DataFrame:
    joined = tracks.join(lookup, key, "left")
    return joined.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def valid_generator(df: DataFrame, names: Sequence[str], col: str = "generator") -> DataFrame:
    return df.where(F.col(col).isin(list(names)))


def discover_groups(listing: DataFrame, names: Sequence[str] | None = None, path: str = "path") -> DataFrame:
    """First folder path per folder name; shadow trees and hidden resource files are skipped.

    Every directory on a path counts, so each path is exploded over its ancestors. Within a
    name the smallest path wins, which is the first in sorted order.
    """
    parts = F.split(F.col(path), "/")
    rows = listing.select(parts.alias("_p")).where(
        ~F.array_contains("_p", "__MACOSX") & ~F.element_at("_p", -1).startswith("._")
    )
    depth = rows.select("_p", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)).alias("_d"))
    folders = depth.select(
        F.element_at("_p", F.col("_d")).alias("name"),
        F.array_join(F.slice("_p", 1, F.col("_d")), "/").alias("folder"),
    ).where(F.col("name") != "")
    if names is not None:
        folders = folders.where(F.col("name").isin(list(names)))
    return folders.groupBy("name").agg(F.min("folder").alias("folder"))


def proportional_sample(
    df: DataFrame, cls: str, fake: str, real: str, n: int, order: str
) -> DataFrame:
    """First rows of two classes by ``order`` with quotas in proportion to the class sizes.

    The fake quota is the integer part of its share, the rest goes to real; each present
    class gets at least one row when ``n >= 2``. ``order`` must be numeric and unique.
    """
    two = df.where(F.col(cls).isin(fake, real))
    sizes = two.agg(
        F.count_if(F.col(cls) == fake).alias("nf"), F.count_if(F.col(cls) == real).alias("nr")
    ).first()
    quota_fake, quota_real = class_quotas(sizes["nf"], sizes["nr"], n)
    bounds = depth_bounds(two, F.col(order))
    ranked = exact_rank(two, [cls], [F.col(order)], depth_bucket(F.col(order), bounds))
    quota = F.when(F.col(cls) == fake, F.lit(quota_fake)).otherwise(F.lit(quota_real))
    return ranked.where(F.col("rn") <= quota)


def class_quotas(n_fake: int, n_real: int, n: int) -> tuple[int, int]:
    """Quotas (fake, real) that add up to ``n`` or to all rows there are."""
    total = min(n, n_fake + n_real)
    quota = total * n_fake // max(n_fake + n_real, 1)
    if total >= 2:
        if quota == 0 and n_fake:
            quota = 1
        elif quota == total and n_real:
            quota = total - 1
    return quota, total - quota


def per_group_quota(
    df: DataFrame, group: str, n: int, key: str, order: str, done: DataFrame
) -> DataFrame:
    """Equal quota ``max(1, ceil(n / groups))`` per group in ``order``; finished keys count
    toward the quota and are then left out."""
    groups = df.select(F.count_distinct(group).alias("g")).first()["g"]
    quota = max(1, -(-n // max(groups, 1)))
    bounds = depth_bounds(df, F.col(order))
    ranked = exact_rank(df, [group], [F.col(order)], depth_bucket(F.col(order), bounds))
    return ranked.where(F.col("rn") <= quota).join(done.select(key), key, "left_anti").select(*df.columns, "rn")


def completed_keys(done: DataFrame, key: str, filled: Sequence[str] = ()) -> DataFrame:
    """Keys already in the target; with ``filled`` only rows where all those columns have text
    (null and '' are both incomplete)."""
    cond = reduce(lambda a, c: a & (F.coalesce(F.col(c), F.lit("")) != ""), filled, F.lit(True))
    return done.where(cond).select(key)


def incremental_new(src: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return src.join(done.select(*keys), list(keys), "left_anti").select(*src.columns)


def append_catalogue(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def unify_catalogues(**catalogues: DataFrame) -> DataFrame:
    """Union of catalogues with ``source``, ``class_label`` and a common ``filename``.

    The class is taken from generator, model or similarity_label, else the source name.
    """
    parts = []
    for name, df in catalogues.items():
        known = [c for c in ("generator", "model", "similarity_label") if c in df.columns]
        cls = F.col(known[0]).cast("string") if known else F.lit(name)
        part = df.withColumn("source", F.lit(name)).withColumn("class_label", cls)
        if "filename" not in df.columns and "track_a" in df.columns:
            part = part.withColumn("filename", F.col("track_a"))
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def head_per_group(df: DataFrame, group: str, n: int, order: Sequence[Column]) -> DataFrame:
    return first_rows(df, [group], order, n)
