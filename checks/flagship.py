"""Label-balanced pair scoring over the whole embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import int_sql, md5_sql, r6, table, with_sql
from checks.evaluation import AUC
from checks.pairs import sample_sql
from checks.similarity import _clip_sql, _cos
from pairloom.plans.pair_scoring import pair_scoring

THRESHOLD = 0.1


def _run(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("track_id"), F.col("label").alias("class"), F.col("embedding").alias("vector")
    )
    out = pair_scoring(vectors, THRESHOLD)
    rounded = {"accuracy", "precision", "recall", "f1", "auc_roc"}
    return out.select(*[r6(F.col(c)).alias(c) if c in rounded else F.col(c) for c in out.columns])


QUERIES = {"z01_pair_scoring": _run}

_POOL = "SELECT path FROM v"
SQL = {
    "z01_pair_scoring": with_sql(
        "v AS (SELECT CAST(vec_id AS VARCHAR) AS path, label AS class, embedding::DOUBLE[] AS e FROM embeddings)",
        f"""r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {md5_sql('42|shared', 'path')}, path) AS rn FROM v)""",
        f"""k AS (SELECT class, m, {int_sql('42|start', 'class')} % m AS st, least(m, n) AS take FROM (
  SELECT class, count(*) AS n, count(*) * (count(*) - 1) // 2 AS m FROM v GROUP BY 1 HAVING count(*) >= 2))""",
        "t AS (SELECT class, (st + j * (m // take)) % m AS t FROM (SELECT *, unnest(range(0, take)) AS j FROM k))",
        """pos AS (SELECT a.e AS va, b.e AS vb, 1 AS label FROM r a JOIN r b ON a.class = b.class AND a.rn < b.rn
  JOIN t ON t.class = a.class AND t.t = (b.rn - 1) * (b.rn - 2) // 2 + a.rn - 1)""",
        """sz AS (SELECT coalesce(sum(CASE WHEN n >= 2 THEN least(n, n * (n - 1) / 2) ELSE 0 END), 0)::BIGINT AS same,
  1 - sum(n * n) / (sum(n) * sum(n)) AS across FROM (SELECT class, count(*)::DOUBLE AS n FROM v GROUP BY 1))""",
        sample_sql("d", _POOL, _POOL, "(SELECT CASE WHEN across > 0 THEN floor(1.25::DOUBLE * same / across) + 100 ELSE 0 END FROM sz)", "42"),
        """neg AS (SELECT va, vb, 0 AS label FROM (
  SELECT a.e AS va, b.e AS vb, row_number() OVER (ORDER BY draw) AS rk
  FROM d JOIN v a ON a.path = track_a_path JOIN v b ON b.path = track_b_path WHERE a.class <> b.class)
  WHERE rk <= (SELECT same FROM sz))""",
        f"""sc AS (SELECT label, {_clip_sql(_cos('va', 'vb'))} AS score FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg))""",
        f"""c AS (SELECT count(*) FILTER (label = 0 AND score < {THRESHOLD}) AS tn, count(*) FILTER (label = 0 AND score >= {THRESHOLD}) AS fp,
  count(*) FILTER (label = 1 AND score < {THRESHOLD}) AS fn, count(*) FILTER (label = 1 AND score >= {THRESHOLD}) AS tp FROM sc)""",
        AUC,
    )
    + f"""SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(auc, 6) AS auc_roc,
  {THRESHOLD}::DOUBLE AS threshold, tp + tn + fp + fn AS n, tp + fn AS n_pos, tn + fp AS n_neg FROM c, ac"""
}
