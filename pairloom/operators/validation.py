"""File verdicts, references, orphans and repair on catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import first_rows


def verdict(min_duration: float = 0.1, expected_sr: int = 16000) -> Column:
    """Reason of the first failing rule, '' when valid.

    Expects path facts ``size``, ``readable``, ``error``, ``sample_rate``, ``channels`` and
    ``duration``; a file that is not listed has a null size.
    """
    return (
        F.when(F.col("size").isNull(), "missing")
        .when(F.col("size") == 0, "empty file (0 bytes)")
        .when(
            ~F.coalesce(F.col("readable"), F.lit(False)),
            F.concat(F.lit("corrupt ("), F.coalesce("error", F.lit("unreadable")), F.lit(")")),
        )
        .when(
            F.col("sample_rate") != expected_sr,
            F.format_string(f"wrong sample rate (%d Hz, expected {expected_sr})", "sample_rate"),
        )
        .when(F.col("channels") != 1, F.format_string("not mono (%d channels)", "channels"))
        .when(
            F.col("duration") <= min_duration,
            F.format_string(f"too short (%.3fs, min {min_duration}s)", "duration"),
        )
        .otherwise("")
    )


def validate(
    referenced: DataFrame, headers: DataFrame, min_duration: float = 0.1, expected_sr: int = 16000
) -> DataFrame:
    """One verdict per referenced path; ``headers`` holds the facts of the files on disk."""
    extra = [c for c in referenced.columns if c != "path"]
    return (
        referenced.join(headers, "path", "left")
        .withColumn("reason", verdict(min_duration, expected_sr))
        .select("path", *extra, (F.col("reason") == "").alias("valid"), "reason")
    )


def referenced_files(cat: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Files named in any of the present columns, blanks and ``nan`` skipped, each once."""
    present = [F.trim(F.col(c).cast("string")) for c in cols if c in cat.columns]
    return (
        cat.select(F.explode(F.array(*present)).alias("path"))
        .where(F.col("path").isNotNull() & ~F.col("path").isin("", "nan"))
        .distinct()
    )


def orphans(listing: DataFrame, refs: DataFrame) -> DataFrame:
    return listing.join(refs.select("path"), "path", "left_anti").select("path")


def categorise(verdicts: DataFrame) -> DataFrame:
    category = (
        F.when(F.col("valid"), "ok")
        .when(F.col("reason") == "missing", "missing")
        .when(F.col("reason").startswith("corrupt"), "corrupt")
        .otherwise("wrong_format")
    )
    return verdicts.withColumn("category", category)


def validation_summary(categorised: DataFrame, orphaned: DataFrame, group: str = "dataset") -> DataFrame:
    """Totals per category, orphan count with the first five, and status per dataset."""
    kinds = ("ok", "missing", "corrupt", "wrong_format")
    totals = categorised.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("category") == k).alias(f"n_{k}") for k in kinds],
    )
    counts = orphaned.groupBy(group).agg(F.count(F.lit(1)).alias("n_orphans"))
    shown = (
        first_rows(orphaned, [group], [F.col("path")], 5)
        .groupBy(group)
        .agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("first_orphans"))
    )
    return (
        totals.join(counts, group, "left")
        .join(shown, group, "left")
        .withColumn("n_orphans", F.coalesce("n_orphans", F.lit(0)))
        .withColumn("first_orphans", F.coalesce("first_orphans", F.lit("")))
        .withColumn("status", F.when(F.col("total") == F.col("n_ok"), "OK").otherwise("ISSUES FOUND"))
    )


def drop_invalid_rows(cat: DataFrame, invalid: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Catalogue without rows that name an invalid file (by base name) in any file column."""
    names = invalid.select(F.element_at(F.split("path", "/"), -1).alias("_bad")).distinct()
    for col in [c for c in cols if c in cat.columns]:
        base = F.element_at(F.split(F.trim(F.col(col).cast("string")), "/"), -1)
        cat = cat.join(names, base == F.col("_bad"), "left_anti")
    return cat


def rows_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, after and removed."""
    both = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return both.agg(F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after")).withColumn(
        "rows_removed", F.col("rows_before") - F.col("rows_after")
    )


def missing_columns(tables: dict[str, DataFrame], wanted: dict[str, Sequence[str]]) -> DataFrame:
    """(dataset, column_name, n_rows) of every wanted column that a table lacks, with the rows that it concerns."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("dataset"), F.explode(F.array(*[F.lit(c) for c in lacking])).alias("column_name"), "n_rows")
        for name, df in tables.items()
        if (lacking := [c for c in wanted.get(name, ()) if c not in df.columns])
    ]
    if not parts:
        return next(iter(tables.values())).limit(0).selectExpr("'' as dataset", "'' as column_name", "0L as n_rows")
    return reduce(lambda a, b: a.unionAll(b), parts)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df

