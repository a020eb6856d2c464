"""Pair features, pooling, losses and a pair classifier.

Score tables carry ``logit`` and ``label``; vector tables (track_id, vector); window tables
(track_id, chunk, vector).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.vectors import cosine, dot, l2_distance, norm, to_double
from pairloom.operators.similarity import A, B, both_sides

#: rows of a batch within which all vectors are compared
MAX_BATCH = 4096
DISTANCE_EPS = 1e-6


# ---- features and pooling
def pair_features(pairs: DataFrame, vectors: DataFrame, name: str = "pair_features") -> DataFrame:
    """[a; b; |a − b|; a ⊙ b] per pair."""
    j = both_sides(pairs, vectors, ["vector"])
    a, b = to_double(F.col("vector_a")), to_double(F.col("vector_b"))
    parts = F.concat(
        a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y)
    )
    return j.withColumn(name, parts).drop("vector_a", "vector_b")


def multi_head_pool(
    chunks: DataFrame, queries: Sequence[Sequence[float]], mask_padding: bool = False
) -> DataFrame:
    """Softmax(x·q / sqrt(d))-weighted mean of a track's windows for every head.

    The maximum and both sums are grouped aggregates, so the windows of a long track are
    never gathered. All-zero windows take part unless ``mask_padding`` is set.
    """
    vec, q = to_double(F.col("vector")), F.col("_q.query")
    rows = chunks.where(norm(vec) > 0) if mask_padding else chunks
    heads = F.array(
        *[
            F.struct(F.lit(h).alias("head"), F.lit(np.asarray(v, dtype="float64")).alias("query"))
            for h, v in enumerate(queries)
        ]
    )
    score = dot(F.col("vector"), q) / F.sqrt(F.size(q).cast("double"))
    scored = rows.select("track_id", vec.alias("vector"), F.explode(heads).alias("_q")).select(
        "track_id", F.col("_q.head").alias("head"), "vector", score.alias("_s")
    )
    top = scored.groupBy("track_id", "head").agg(F.max("_s").alias("_top"))
    weighted = scored.join(top, ["track_id", "head"]).withColumn("_w", F.exp(F.col("_s") - F.col("_top")))
    return (
        weighted.select("track_id", "head", "_w", F.posexplode("vector").alias("dim", "x"))
        .groupBy("track_id", "head", "dim")
        .agg((F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("value"))
    )


def attention_pool(chunks: DataFrame, query: Sequence[float], mask_padding: bool = False) -> DataFrame:
    """One head with a given query: (track_id, dim, value)."""
    return multi_head_pool(chunks, [query], mask_padding).drop("head")


def concat_heads(pooled: DataFrame, dims: int) -> DataFrame:
    """Heads one after another in one array per track (heads x dims values)."""
    slot = F.col("head") * dims + F.col("dim")
    ordered = F.array_sort(F.collect_list(F.struct(slot.alias("slot"), "value"))).getField("value")
    return pooled.groupBy("track_id").agg(ordered.alias("vector"))


def mean_pool(chunks: DataFrame) -> DataFrame:
    return (
        chunks.select("track_id", F.posexplode(to_double(F.col("vector"))).alias("dim", "x"))
        .groupBy("track_id", "dim").agg(F.avg("x").alias("value"))
    )


# ---- losses
def smoothed(label: Column, smoothing: float) -> Column:
    return label * (1.0 - smoothing) + F.lit(0.5 * smoothing)


def bce_term(logit: Column, target: Column) -> Column:
    """Cross-entropy on logits without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def focal_term(logit: Column, label: Column, gamma: float = 2.0, alpha: float = 0.25, smoothing: float = 0.0) -> Column:
    y = smoothed(label.cast("double"), smoothing)
    p = sigmoid(logit)
    p_t = p * y + (F.lit(1.0) - p) * (F.lit(1.0) - y)
    alpha_t = F.lit(alpha) * y + F.lit(1.0 - alpha) * (F.lit(1.0) - y)
    return alpha_t * F.pow(F.lit(1.0) - p_t, F.lit(gamma)) * bce_term(logit, y)


def focal_loss(scores: DataFrame, gamma: float = 2.0, alpha: float = 0.25, smoothing: float = 0.0) -> DataFrame:
    return scores.agg(F.avg(focal_term(F.col("logit"), F.col("label"), gamma, alpha, smoothing)).alias("focal_loss"))


def bce_loss(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg(bce_term(F.col("logit"), F.col("label").cast("double"))).alias("bce_loss"))


def contrastive_term(similarity: Column, label: Column, margin: float = 0.4) -> Column:
    d = F.lit(1.0) - similarity
    short = F.greatest(F.lit(margin) - d, F.lit(0.0))
    return label * d * d + (F.lit(1.0) - label) * short * short


def contrastive_loss(pairs: DataFrame, vectors: DataFrame, margin: float = 0.4) -> DataFrame:
    """Mean cosine contrastive loss over labelled pairs (zero vectors count as similarity 0)."""
    j = both_sides(pairs, vectors, ["vector"])
    sim = F.coalesce(cosine(to_double(F.col("vector_a")), to_double(F.col("vector_b"))), F.lit(0.0))
    return j.agg(F.avg(contrastive_term(sim, F.col("label").cast("double"), margin)).alias("contrastive_loss"))


def bounded_batches(batches: DataFrame, most: int = MAX_BATCH) -> DataFrame:
    """``batches`` as they are; running them fails if a batch has more than ``most`` rows.

    All rows of a batch meet each other, so a batch that grows with the data must not get through.
    """
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("_n"))
    fault = F.raise_error(F.concat(F.lit("batch "), F.col("batch").cast("string"), F.lit(f" has more than {most} rows")))
    kept = sizes.select(F.when(F.col("_n") > most, fault).otherwise(F.col("batch")).alias("batch"))
    return batches.join(kept, "batch")


def triplet_loss(batches: DataFrame, margin: float = 0.3) -> DataFrame:
    """Triplet loss per batch with the nearest negative of the batch.

    ``batches`` is (batch, row, label, vector_a, vector_b) with batches of at most ``MAX_BATCH`` rows;
    the pool of negatives is both sides of the batch's negative pairs. A batch without one
    of the two classes has loss 0.
    """
    batches = bounded_batches(batches)
    pos = batches.where(F.col("label") == 1).select(
        "batch", "row", to_double(F.col("vector_a")).alias("anchor"), to_double(F.col("vector_b")).alias("mate")
    )
    neg = batches.where(F.col("label") == 0).select(
        "batch",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("row").alias("row"), to_double(F.col("vector_a")).alias("v")),
                F.struct(F.lit(1).alias("side"), F.col("row").alias("row"), to_double(F.col("vector_b")).alias("v")),
            )
        ).alias("n"),
    )
    near = pos.join(neg, "batch").withColumn("_d", l2_distance(F.col("anchor"), F.col("n.v")))
    shifted = lambda x, y: F.sqrt(
        F.aggregate(
            F.zip_with(x, y, lambda p, q: (p - q + DISTANCE_EPS) * (p - q + DISTANCE_EPS)),
            F.lit(0.0), lambda acc, v: acc + v,
        )
    )
    hardest = near.groupBy("batch", "row").agg(
        F.min_by(F.struct("anchor", "mate", "n.v"), F.struct("_d", "n.side", "n.row")).alias("_h")
    )
    loss = F.greatest(
        shifted(F.col("_h.anchor"), F.col("_h.mate")) - shifted(F.col("_h.anchor"), F.col("_h.v")) + margin, F.lit(0.0)
    )
    per_batch = hardest.groupBy("batch").agg(F.avg(loss).alias("_loss"))
    every = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    return every.join(per_batch, "batch", "left").select(
        "batch", "n", F.coalesce("_loss", F.lit(0.0)).alias("triplet_loss")
    )


def ntxent_loss(views: DataFrame, tau: float = 0.5) -> DataFrame:
    """Normalised temperature cross-entropy per batch of two views.

    ``views`` is (batch, row, vector_a, vector_b), batches of at most ``MAX_BATCH`` rows. Each of the
    2N vectors is compared with the others of its batch, itself excluded; the target is its
    partner. Log-sum-exp is taken around the maximum.
    """
    views = bounded_batches(views)
    side = lambda i, c: F.struct(F.lit(i).alias("side"), to_double(F.col(c)).alias("v"))
    flat = views.select("batch", "row", F.explode(F.array(side(0, "vector_a"), side(1, "vector_b"))).alias("_x"))
    length = norm(F.col("_x.v"))
    unit = flat.select(
        "batch", "row", F.col("_x.side").alias("side"),
        F.zip_with(F.col("_x.v"), F.array_repeat(F.greatest(length, F.lit(1e-12)), F.size("_x.v")), lambda v, s: v / s).alias("v"),
    )
    other = unit.select("batch", F.col("row").alias("row2"), F.col("side").alias("side2"), F.col("v").alias("v2"))
    pairs = unit.join(other, "batch").where((F.col("row") != F.col("row2")) | (F.col("side") != F.col("side2")))
    logits = pairs.withColumn("_s", dot(F.col("v"), F.col("v2")) / F.lit(float(tau)))
    partner = F.max(F.when(F.col("row") == F.col("row2"), F.col("_s")))
    # cosine / tau is at most 1 / tau, which is a safe shift
    total = F.log(F.sum(F.exp(F.col("_s") - F.lit(1.0 / tau)))) + F.lit(1.0 / tau)
    rows = logits.groupBy("batch", "row", "side").agg((total - partner).alias("_l"))
    return rows.groupBy("batch").agg((F.count(F.lit(1)) / 2).cast("bigint").alias("n"), F.avg("_l").alias("ntxent_loss"))


def embedding_mse(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean squared difference of two vector tables over shared tracks; lengths must agree."""
    a = left.select("track_id", to_double(F.col("vector")).alias("_a"))
    b = right.select("track_id", to_double(F.col("vector")).alias("_b"))
    differ = F.raise_error(F.lit("vectors differ in length"))
    gap = F.when(
        F.size("_a") == F.size("_b"), F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y))
    ).otherwise(differ)
    squares = a.join(b, "track_id").select(
        F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v).alias("_s"), F.size("_a").alias("_n")
    )
    return squares.agg((F.sum("_s") / F.sum("_n")).alias("mse"))


def scored_summary(batches: DataFrame) -> DataFrame:
    """Losses averaged by batch size and accuracy with logit > 0.

    ``batches`` is one row per scored pair: (batch, logit, label) plus loss terms.
    """
    y = F.col("label").cast("double")
    per_batch = batches.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(bce_term(F.col("logit"), y)).alias("bce"),
        F.avg(focal_term(F.col("logit"), F.col("label"))).alias("focal"),
        F.count_if((F.col("logit") > 0).cast("int") == F.col("label")).alias("hits"),
    )
    n = F.greatest(F.sum("n"), F.lit(1))
    return per_batch.agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("bce") * F.col("n")) / n).alias("bce_loss"),
        (F.sum(F.col("focal") * F.col("n")) / n).alias("focal_loss"),
        (F.sum("hits") / n).alias("accuracy"),
    )


# ---- classifier
def _as_rows(features: DataFrame, col: str) -> DataFrame:
    return features.withColumn("_x", array_to_vector(F.col(col).cast("array<double>"))).withColumn(
        "label", F.col("label").cast("double")
    )


def _stages(kind: str, width: int, hidden: int, reg: float, iterations: int, seed: int) -> list:
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True)
    if kind == "mlp":
        model = MultilayerPerceptronClassifier(
            featuresCol="_z", labelCol="label", layers=[width, hidden, 2], maxIter=iterations, seed=seed
        )
    else:
        model = LogisticRegression(featuresCol="_z", labelCol="label", regParam=reg, maxIter=iterations)
    return [scaler, model]


def fit_pair_model(
    train: DataFrame,
    col: str = "pair_features",
    kind: str = "logistic",
    hidden: int = 64,
    reg: float = 0.01,
    iterations: int = 50,
    seed: int = 42,
) -> PipelineModel:
    """Standardised pair features into a classifier; the fitted pipeline can be saved and
    applied to batches and streams alike."""
    rows = _as_rows(train, col)
    width = len(train.select(col).first()[0]) if kind == "mlp" else 0
    return Pipeline(stages=_stages(kind, width, hidden, reg, iterations, seed)).fit(rows)


def score_model(model: PipelineModel, features: DataFrame, col: str = "pair_features") -> DataFrame:
    """Adds ``score``, the probability of label 1."""
    rows = features.withColumn("_x", array_to_vector(F.col(col).cast("array<double>")))
    scored = model.transform(rows)
    return scored.withColumn("score", F.element_at(vector_to_array("probability"), 2)).select(*features.columns, "score")


def tune_pair_model(
    train: DataFrame,
    col: str = "pair_features",
    regs: Sequence[float] = (0.001, 0.01, 0.1),
    mixes: Sequence[float] = (0.0, 0.5),
    train_share: float = 0.85,
    parallelism: int = 4,
    seed: int = 42,
) -> tuple[PipelineModel, DataFrame]:
    """Search for the parameters with the highest validation AUC: (best model, one row per trial)."""
    rows = _as_rows(train, col)
    stages = _stages("logistic", 0, 0, 0.0, 30, seed)
    lr = stages[-1]
    grid = ParamGridBuilder().addGrid(lr.regParam, list(regs)).addGrid(lr.elasticNetParam, list(mixes)).build()
    search = TrainValidationSplit(
        estimator=Pipeline(stages=stages), estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC"),
        trainRatio=train_share, parallelism=parallelism, seed=seed,
    )
    fitted = search.fit(rows)
    trials = [
        (float(p[lr.regParam]), float(p[lr.elasticNetParam]), float(m))
        for p, m in zip(grid, fitted.validationMetrics)
    ]
    table = train.sparkSession.createDataFrame(trials, "reg double, mix double, auc double")
    return fitted.bestModel, table
