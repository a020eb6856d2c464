"""Vectors with classes -> labelled pairs -> cosine scores -> metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import evaluation, pairs
from pairloom.operators.ranking import exact_rank
from pairloom.operators.similarity import pair_cosine
from pairloom.session import cut_lineage


#: draws beyond the expected number of which the wanted one joins two classes
SPARE_SHARE, SPARE_DRAWS = 1.25, 100


def class_pairs(vectors: DataFrame, seed: str | int = 42) -> DataFrame:
    """Pairs within a class, as many as it has tracks, and as many sampled pairs across classes.

    ``vectors`` is (track_id, class, …). Both numbers follow the table: draws within a class are
    left out, so more are drawn by the share of pairs that lie across, and the first ones are kept.
    """
    named = vectors.select(F.col("track_id").cast("string").alias("path"), F.col("class"))
    same = pairs.shared_key_positives(named, F.col("class"), None, seed)
    n = F.col("count").cast("double")
    kept = F.when(n >= 2, F.least(n, n * (n - 1) / 2)).otherwise(0.0)
    sizes = named.groupBy("class").count().agg(F.sum(kept).alias("same"), F.sum("count").alias("all"), F.sum(n * n).alias("within")).first()
    wanted, total = int(sizes["same"] or 0), sizes["all"] or 0
    across_share = 1 - (sizes["within"] or 0.0) / max(total * total, 1)
    draws = math.floor(SPARE_SHARE * wanted / across_share) + SPARE_DRAWS if across_share > 0 else 0
    drawn = pairs.sample_pairs(named, named, draws, seed, sizes=(total, total))
    a = named.select(F.col("path").alias("track_a_path"), F.col("class").alias("_ca"))
    b = named.select(F.col("path").alias("track_b_path"), F.col("class").alias("_cb"))
    across = drawn.join(a, "track_a_path").join(b, "track_b_path").where(F.col("_ca") != F.col("_cb"))
    slices = F.floor(F.col("draw") / max(1, draws * pairs.ATTEMPTS // 4096))
    across = exact_rank(across, [], [F.col("draw")], slices, name="_rank").where(F.col("_rank") <= wanted)
    return pairs.union_pairs(same, pairs.labelled(across, 0, "negative"))


def pair_scoring(vectors: DataFrame, threshold: float, seed: str | int = 42) -> DataFrame:
    """Metrics record of cosine scores over class pairs, with the balance of the pairs."""
    table = class_pairs(vectors, seed)
    scored = cut_lineage(
        pair_cosine(table, vectors.withColumn("track_id", F.col("track_id").cast("string")), clip=True)
    )
    report = evaluation.evaluation_report(scored, threshold, True)
    balance = pairs.pair_balance(scored).first()
    return report.select(
        "accuracy", "precision", "recall", "f1", "auc_roc", "threshold", "n",
        F.lit(balance["n_pos"]).alias("n_pos"), F.lit(balance["n_neg"]).alias("n_neg"),
    )
