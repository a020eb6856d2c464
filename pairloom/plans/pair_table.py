"""Catalogues -> labelled pair table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators import pairs as ops
from pairloom.session import kept


def complete(pairs: DataFrame, a: str = "track_a", b: str = "track_b") -> DataFrame:
    """Annotated pairs with both sides filled; null and '' both count as missing."""
    return pairs.where((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""))


def all_pairs(
    labelled: DataFrame | None,
    renditions: DataFrame | None,
    annotated: DataFrame | None,
    order: Sequence[Column],
    seed: str | int = 42,
) -> DataFrame:
    """Union of every pair set the given catalogues allow; an absent catalogue is skipped.

    The number of class positives drawn sets the number of class negatives.
    """
    parts: list[DataFrame] = []
    if labelled is not None:
        positives = kept(ops.class_positive_pairs(labelled, seed))
        parts += [
            positives,
            ops.class_negative_pairs(labelled, positives.count(), seed),
            ops.hard_negatives(labelled.where(F.col("label") == "ai"), "generator", order, seed=seed),
        ]
    if annotated is not None:
        known = ops.annotated_positives(complete(annotated))
        parts += [known, ops.negatives_excluding(known, seed=seed)]
    if labelled is not None and renditions is not None:
        real = labelled.where(F.col("label") == "real")
        parts.append(ops.cross_source_negatives(real, renditions, seed=seed))
    if renditions is not None:
        parts += [
            ops.hard_negatives(renditions, "model", order, ops.MODEL_CAP, seed),
            ops.shared_key_positives(renditions, ops.shared_key(F.col("path")), seed=seed),
        ]
    if not parts:
        raise ValueError("no catalogue given, so no pairs")
    return ops.union_pairs(*parts)


def split_table(pairs: DataFrame, val: float = 0.15, test: float = 0.15, seed: str | int = 42) -> DataFrame:
    """Pair table with its split. The ranking reads the pairs twice, so they are built once."""
    return ops.stratified_split(kept(pairs), val, test, seed)
