"""Evaluation of cosine scores of vector pairs against the same-class label."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import r6, with_sql
from checks.similarity import COS, KEY, VPAIRS, vector_pairs, vectors
from pairloom.operators import evaluation as ops
from pairloom.operators.similarity import pair_cosine

QUERIES: dict = {}
SQL: dict = {}

T = 0.1


def scored(spark, sf):
    """Scores rounded to two digits, so that ties are common."""
    return pair_cosine(vector_pairs(spark, sf), vectors(spark, sf), clip=False).withColumn("score", r6(F.col("score"), 2))


SCORED = with_sql(VPAIRS, f"sc AS (SELECT {KEY}, label, round({COS}, 2) + 0.0 AS score FROM vp)")
CONF = """cf AS (SELECT count(*) FILTER (label = 0 AND NOT hit) AS tn, count(*) FILTER (label = 0 AND hit) AS fp,
  count(*) FILTER (label = 1 AND NOT hit) AS fn, count(*) FILTER (label = 1 AND hit) AS tp
  FROM (SELECT label, score >= 0.1 AS hit FROM sc)),
mt AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM cf),
m2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM mt)"""
AUC = """ap AS (SELECT score, count(*) AS c FROM sc WHERE label = 1 GROUP BY 1),
an AS (SELECT score, count(*) AS c FROM sc WHERE label = 0 GROUP BY 1),
ac AS (SELECT coalesce(sum(CASE WHEN ap.score > an.score THEN ap.c * an.c WHEN ap.score = an.score THEN ap.c * an.c / 2.0::DOUBLE
    ELSE 0 END) / sum(ap.c * an.c), 0) AS auc FROM ap, an)"""

QUERIES["h01_predict_inclusive"] = lambda spark, sf: ops.predict(scored(spark, sf), T, True)
SQL["h01_predict_inclusive"] = SCORED + f"SELECT {KEY}, label, score, CASE WHEN score >= {T} THEN 1 ELSE 0 END AS predicted FROM sc"
QUERIES["h01_predict_strict"] = lambda spark, sf: ops.predict(scored(spark, sf), T, False)
SQL["h01_predict_strict"] = SCORED + f"SELECT {KEY}, label, score, CASE WHEN score > {T} THEN 1 ELSE 0 END AS predicted FROM sc"

_pred = lambda spark, sf: ops.predict(scored(spark, sf), T, True)
QUERIES["h02_confusion"] = lambda spark, sf: ops.confusion(_pred(spark, sf))
SQL["h02_confusion"] = SCORED + "," + CONF + "SELECT tn, fp, fn, tp FROM m2"
_METRICS = ("accuracy", "precision", "recall", "f1")
QUERIES["h03_binary_metrics"] = lambda spark, sf: ops.binary_metrics(_pred(spark, sf)).select(
    *[r6(F.col(c)).alias(c) for c in _METRICS]
)
SQL["h03_binary_metrics"] = SCORED + "," + CONF + (
    "SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS) + " FROM m2"
)
QUERIES["h04_roc_curve"] = lambda spark, sf: ops.roc_curve(scored(spark, sf)).select(
    F.when(F.col("threshold") < 2, F.col("threshold")).alias("threshold"), r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr")
)
SQL["h04_roc_curve"] = SCORED + """,
g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM sc GROUP BY 1)
SELECT NULL AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL SELECT score, round(sum(n) OVER w / (SELECT sum(n) FROM g), 6), round(sum(p) OVER w / (SELECT sum(p) FROM g), 6)
FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""
QUERIES["h05_auc"] = lambda spark, sf: ops.auc(scored(spark, sf)).select(r6(F.col("auc")).alias("auc"))
SQL["h05_auc"] = SCORED + "," + AUC + "SELECT round(auc, 6) AS auc FROM ac"

QUERIES["h06_score_histogram"] = lambda spark, sf: ops.score_histogram(scored(spark, sf))
SQL["h06_score_histogram"] = SCORED + """,
r AS (SELECT *, min(score) OVER l AS lo, (max(score) OVER l - min(score) OVER l) / 30 AS w FROM sc WINDOW l AS (PARTITION BY label))
SELECT label, least(CAST(floor((score - lo) / w) AS INT), 29) AS bin, count(*) AS n FROM r GROUP BY 1, 2"""
QUERIES["h06_unit_histogram"] = lambda spark, sf: ops.score_histogram(scored(spark, sf), 24, (0.0, 1.0))
SQL["h06_unit_histogram"] = SCORED + """
SELECT label, least(CAST(floor(score / (1.0::DOUBLE / 24)) AS INT), 23) AS bin, count(*) AS n FROM sc
WHERE score BETWEEN 0 AND 1 GROUP BY 1, 2"""


def _report(spark, sf):
    out = ops.evaluation_report(scored(spark, sf), T)
    cell = lambda i, j: F.get(F.get("confusion_matrix", F.lit(i)), F.lit(j))
    return out.select(
        *[r6(F.col(c)).alias(c) for c in (*_METRICS, "auc_roc")], "threshold", "n",
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"),
    )


QUERIES["h07_evaluation_report"] = _report
SQL["h07_evaluation_report"] = SCORED + "," + CONF + "," + AUC + """
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round(auc, 6) AS auc_roc, 0.1::DOUBLE AS threshold, tn + fp + fn + tp AS n, tn, fp, fn, tp FROM m2, ac"""
QUERIES["h08_score_range"] = lambda spark, sf: ops.score_range(scored(spark, sf)).withColumn("mean", r6(F.col("mean")))
SQL["h08_score_range"] = SCORED + (
    "SELECT label, min(score) AS low, max(score) AS high, round(avg(score), 6) + 0.0 AS mean FROM sc GROUP BY 1"
)
