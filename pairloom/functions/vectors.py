"""Array-valued vector expressions (double arithmetic, null on zero norm)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def clip01(x: Column) -> Column:
    """Clip to [0, 1]; null stays null (least/greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def cosine(a: Column, b: Column) -> Column:
    denominator = norm(a) * norm(b)
    return F.when(denominator > 0, dot(a, b) / denominator)


def cosine01(a: Column, b: Column) -> Column:
    return clip01(cosine(a, b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )
    )
