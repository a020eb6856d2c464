"""Evaluation of scored pairs (score, label 0/1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import depth_bounds, depth_bucket, running_totals


def predict(df: DataFrame, threshold: float, inclusive: bool, score: str = "score") -> DataFrame:
    """Predictions at a threshold; whether the threshold itself counts must be said."""
    hit = F.col(score) >= threshold if inclusive else F.col(score) > threshold
    return df.withColumn("predicted", hit.cast("int"))


def _counts() -> list[Column]:
    y, p = F.col("label"), F.col("predicted")
    return [
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    ]


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.agg(*_counts())


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def binary_metrics(predicted: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where a denominator is 0."""
    c = confusion(predicted)
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return (
        c.withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn))
        .withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", _ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))
    )


def _by_score(df: DataFrame, score: str) -> DataFrame:
    """Counts per distinct score; ties collapse map-side."""
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n")
    )


def _cumulated(df: DataFrame, score: str) -> DataFrame:
    """Running positives and negatives from the highest score down.

    Scores are cut into equal-depth ranges, summed per range and shifted, so the curve of a
    billion distinct scores is not built in one task.
    """
    grouped = _by_score(df, score)
    bounds = depth_bounds(df, F.col(score))
    down = -depth_bucket(F.col("score"), bounds)
    return running_totals(grouped, [], [F.col("score").desc()], down, {"_p": "tp", "_n": "fp"})


def roc_curve(df: DataFrame, score: str = "score") -> DataFrame:
    """Points (threshold, fpr, tpr) per distinct score, and (0, 0) at threshold infinity."""
    totals = df.agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")
    ).first()
    points = _cumulated(df, score).select(
        F.col("score").alias("threshold"),
        _ratio(F.col("fp"), F.lit(totals["n"])).alias("fpr"),
        _ratio(F.col("tp"), F.lit(totals["p"])).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], points.schema)
    return origin.unionByName(points)


def auc(df: DataFrame, score: str = "score") -> DataFrame:
    """Area under the curve with ties counted half; 0.0 when only one class is present."""
    c = _cumulated(df, score)
    # a negative loses to every positive above it and ties with those at its score
    wins = F.sum(F.col("_n") * (F.col("tp") - F.col("_p") + F.col("_p") / 2))
    pairs = F.sum("_n") * F.sum("_p")
    return c.agg(F.when(pairs > 0, wins / pairs).otherwise(F.lit(0.0)).alias("auc"))


def bucket_index(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of an equal-width bin of [low, high], the last one closed; null outside."""
    width = (high - low) / bins
    at = F.when(width > 0, F.least(F.floor((x - low) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return F.when(x.between(low, high), at).cast("int")


def score_histogram(
    df: DataFrame, bins: int = 30, span: tuple[float, float] | None = None, score: str = "score"
) -> DataFrame:
    """Counts per (label, bin): over each class's own range, or over a given span."""
    if span is None:
        # two classes, so two rows: read as literals
        ranges = df.groupBy("label").agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
        found = {r["label"]: r for r in ranges.where(F.col("label").isin(0, 1)).collect()}
        bound = lambda key: F.coalesce(
            *[F.when(F.col("label") == k, F.lit(float(r[key]))) for k, r in found.items()], F.lit(None)
        )
        low, high = bound("lo"), bound("hi")
    else:
        low, high = F.lit(float(span[0])), F.lit(float(span[1]))
    return (
        df.withColumn("bin", bucket_index(F.col(score), low, high, bins))
        .where(F.col("bin").isNotNull())
        .groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"))
    )


def evaluation_report(df: DataFrame, threshold: float = 0.5, inclusive: bool = True, score: str = "score") -> DataFrame:
    """One record: metrics, matrix, AUC, threshold and sample count."""
    metrics = binary_metrics(predict(df, threshold, inclusive, score))
    area = auc(df, score).first()["auc"]
    return metrics.select(
        "accuracy", "precision", "recall", "f1",
        F.lit(area).alias("auc_roc"),
        F.lit(float(threshold)).alias("threshold"),
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
    )


def score_range(df: DataFrame, score: str = "score") -> DataFrame:
    return df.groupBy("label").agg(
        F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean")
    )
