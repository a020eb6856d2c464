"""Pair-model features, pooling, losses and a classifier over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import r6, table, with_sql
from checks.similarity import A, B, COS, KEY, VPAIRS, _cos, chunks, vector_pairs, vectors
from pairloom.operators import model as ops
from pairloom.operators.pairs import stratified_split
from pairloom.session import cut_lineage

QUERIES: dict = {}
SQL: dict = {}

BATCH = 16


def scores(spark, sf):
    """Scored pairs: the logit is a stretched dot product."""
    j = ops.both_sides(vector_pairs(spark, sf), vectors(spark, sf), ["vector"])
    logit = ops.dot(F.col("vector_a").cast("array<double>"), F.col("vector_b").cast("array<double>")) * 8.0
    return j.select(A, B, "label", logit.alias("logit"), F.floor(F.col(A) / BATCH).alias("batch"))


SCORES = with_sql(VPAIRS) + f""",
sc AS (SELECT {KEY}, label, list_dot_product(va, vb) * 8 AS x, {A} // {BATCH} AS batch FROM vp),
ls AS (SELECT *, greatest(x, 0) - x * label + ln(1 + exp(-abs(x))) AS bce, 1 / (1 + exp(-x)) AS p FROM sc)"""

QUERIES["g01_pair_features"] = lambda spark, sf: ops.pair_features(
    vector_pairs(spark, sf), vectors(spark, sf)
).select(A, B, F.posexplode("pair_features").alias("dim", "value")).withColumn("value", r6(F.col("value")))
SQL["g01_pair_features"] = with_sql(VPAIRS) + f"""
SELECT {KEY}, dim, round(CASE dim // 64 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN abs(x - y) ELSE x * y END, 6) + 0.0 AS value
FROM (SELECT {KEY}, dim, va[dim % 64 + 1] AS x, vb[dim % 64 + 1] AS y FROM vp, (SELECT unnest(range(0, 256)) AS dim))"""

QUERY_A = [0.5 if i % 3 == 0 else -0.25 for i in range(16)]
QUERY_B = [0.1 * (i - 8) for i in range(16)]
_CHUNKS = """ck AS (SELECT vec_id AS track_id, c AS chunk, embedding[16 * c + 1 : 16 * c + 16]::DOUBLE[] AS v
  FROM embeddings, (SELECT unnest(range(0, 4)) AS c))"""


def _pool_sql(queries) -> str:
    rows = ", ".join(f"({h}, [{', '.join(map(repr, q))}]::DOUBLE[])" for h, q in enumerate(queries))
    return with_sql(_CHUNKS, f"qs(head, q) AS (VALUES {rows})") + """,
sw AS (SELECT track_id, head, v, exp(list_dot_product(v, q) / 4) AS w FROM ck, qs),
pl AS (SELECT track_id, head, dim, sum(w * v[dim + 1]) / sum(w) AS value
  FROM sw, (SELECT unnest(range(0, 16)) AS dim) GROUP BY 1, 2, 3)"""


QUERIES["g02_attention_pool"] = lambda spark, sf: ops.attention_pool(chunks(spark, sf), QUERY_A).withColumn(
    "value", r6(F.col("value"))
)
SQL["g02_attention_pool"] = _pool_sql([QUERY_A]) + " SELECT track_id, dim, round(value, 6) + 0.0 AS value FROM pl"


def _heads(spark, sf):
    pooled = ops.multi_head_pool(chunks(spark, sf), [QUERY_A, QUERY_B])
    return ops.concat_heads(pooled, 16).select(
        "track_id", F.posexplode("vector").alias("slot", "value")
    ).withColumn("value", r6(F.col("value")))


QUERIES["g03_multi_head_pool"] = _heads
SQL["g03_multi_head_pool"] = _pool_sql([QUERY_A, QUERY_B]) + (
    " SELECT track_id, head * 16 + dim AS slot, round(value, 6) + 0.0 AS value FROM pl"
)


def _features(spark, sf):
    return ops.pair_features(vector_pairs(spark, sf), vectors(spark, sf))


def _model_scores(kind):
    def run(spark, sf):
        # the split sorts and moves keys only, once; the vectors come to each part afterwards
        rows = cut_lineage(stratified_split(vector_pairs(spark, sf), key=(A, B)))
        part = lambda name: ops.pair_features(rows.where(F.col("split") == name), vectors(spark, sf))
        model = ops.fit_pair_model(part("train"), kind=kind, iterations=15)
        return ops.score_model(model, part("test")).select(A, B, "label", "score")

    return run


QUERIES["g04_fit_pair_model"] = _model_scores("logistic")
QUERIES["g04_fit_pair_mlp"] = _model_scores("mlp")
QUERIES["g05_tune_pair_model"] = lambda spark, sf: ops.tune_pair_model(
    _features(spark, sf), regs=(0.01, 0.1), mixes=(0.0,)
)[1]


def _focal(smoothing):
    return lambda spark, sf: ops.focal_loss(scores(spark, sf), smoothing=smoothing).select(
        r6(F.col("focal_loss")).alias("focal_loss")
    )


def _focal_sql(s: float) -> str:
    return SCORES + f""",
t AS (SELECT *, label * {1 - s} + {0.5 * s} AS y FROM ls),
u AS (SELECT *, p * y + (1 - p) * (1 - y) AS pt, 0.25 * y + 0.75 * (1 - y) AS al,
  greatest(x, 0) - x * y + ln(1 + exp(-abs(x))) AS ce FROM t)
SELECT round(avg(al * pow(1 - pt, 2) * ce), 6) AS focal_loss FROM u"""


QUERIES["g06_focal_loss"] = _focal(0.0)
SQL["g06_focal_loss"] = _focal_sql(0.0)
QUERIES["g06_focal_loss_smoothed"] = _focal(0.1)
SQL["g06_focal_loss_smoothed"] = _focal_sql(0.1)
QUERIES["g07_bce_loss"] = lambda spark, sf: ops.bce_loss(scores(spark, sf)).select(r6(F.col("bce_loss")).alias("bce_loss"))
SQL["g07_bce_loss"] = SCORES + "SELECT round(avg(bce), 6) AS bce_loss FROM ls"
QUERIES["g08_contrastive_loss"] = lambda spark, sf: ops.contrastive_loss(
    vector_pairs(spark, sf), vectors(spark, sf), 1.1
).select(r6(F.col("contrastive_loss")).alias("contrastive_loss"))
SQL["g08_contrastive_loss"] = with_sql(VPAIRS) + f"""
SELECT round(avg(label * d * d + (1 - label) * pow(greatest(1.1 - d, 0), 2)), 6) AS contrastive_loss
FROM (SELECT label, 1 - {COS} AS d FROM vp)"""


# batches of pairs: the pairs of sixteen neighbouring vectors
def _batches(spark, sf):
    j = ops.both_sides(vector_pairs(spark, sf), vectors(spark, sf), ["vector"])
    return j.withColumn("batch", F.floor(F.col(A) / 4)).withColumn("row", F.col(A) * 100 + F.col(B) - F.col(A))


QUERIES["g09_triplet_loss"] = lambda spark, sf: ops.triplet_loss(_batches(spark, sf)).withColumn(
    "triplet_loss", r6(F.col("triplet_loss"))
)
_DIST = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: pow(z[1] - z[2] + {2}, 2))))"
SQL["g09_triplet_loss"] = with_sql(VPAIRS) + f""",
bt AS (SELECT {A} // 4 AS batch, {A} * 100 + {B} - {A} AS row, label, va, vb FROM vp),
ng AS (SELECT batch, 0 AS side, row, va AS v FROM bt WHERE label = 0 UNION ALL SELECT batch, 1, row, vb FROM bt WHERE label = 0),
nr AS (SELECT b.batch, b.row, b.va, b.vb, n.v, row_number() OVER (PARTITION BY b.batch, b.row
    ORDER BY {_DIST.format('b.va', 'n.v', '0')}, n.side, n.row) AS k FROM bt b JOIN ng n ON n.batch = b.batch WHERE b.label = 1),
tl AS (SELECT batch, avg(greatest({_DIST.format('va', 'vb', '1e-6')} - {_DIST.format('va', 'v', '1e-6')} + 0.3, 0)) AS l
  FROM nr WHERE k = 1 GROUP BY batch)
SELECT b.batch, count(*) AS n, round(coalesce(any_value(l), 0), 6) + 0.0 AS triplet_loss
FROM bt b LEFT JOIN tl ON tl.batch = b.batch GROUP BY b.batch"""

QUERIES["g10_ntxent_loss"] = lambda spark, sf: ops.ntxent_loss(_batches(spark, sf), 0.5).withColumn(
    "ntxent_loss", r6(F.col("ntxent_loss"))
)
SQL["g10_ntxent_loss"] = with_sql(VPAIRS) + f""",
bt AS (SELECT {A} // 4 AS batch, {A} * 100 + {B} - {A} AS row, va, vb FROM vp),
vw AS (SELECT batch, row, 0 AS side, va AS v FROM bt UNION ALL SELECT batch, row, 1, vb FROM bt),
sm AS (SELECT a.batch, a.row, a.side, a.row = b.row AS mate, {_cos('a.v', 'b.v')} / 0.5 AS s
  FROM vw a JOIN vw b ON a.batch = b.batch AND (a.row <> b.row OR a.side <> b.side)),
lr AS (SELECT batch, row, side, ln(sum(exp(s))) - max(s) FILTER (mate) AS l FROM sm GROUP BY 1, 2, 3)
SELECT batch, count(*) // 2 AS n, round(avg(l), 6) AS ntxent_loss FROM lr GROUP BY batch"""

QUERIES["g11_embedding_mse"] = lambda spark, sf: ops.embedding_mse(
    vectors(spark, sf), vectors(spark, sf).withColumn("track_id", F.col("track_id") + 1)
).select(r6(F.col("mse"), 9).alias("mse"))
SQL["g11_embedding_mse"] = """
SELECT round(avg(pow(x - y, 2)), 9) AS mse FROM (
  SELECT unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y
  FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1)"""
QUERIES["g12_mean_pool"] = lambda spark, sf: ops.mean_pool(chunks(spark, sf)).withColumn("value", r6(F.col("value")))
SQL["g12_mean_pool"] = with_sql(_CHUNKS) + """
SELECT track_id, dim, round(avg(v[dim + 1]), 6) + 0.0 AS value FROM ck, (SELECT unnest(range(0, 16)) AS dim) GROUP BY 1, 2"""


def _summary(spark, sf):
    out = ops.scored_summary(scores(spark, sf))
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("bce_loss", "focal_loss", "accuracy")])


QUERIES["g13_scored_summary"] = _summary
SQL["g13_scored_summary"] = SCORES + """,
f AS (SELECT *, CASE WHEN label = 1 THEN 0.25 * pow(1 - p, 2) ELSE 0.75 * pow(p, 2) END * bce AS focal FROM ls)
SELECT count(*) AS n, round(avg(bce), 6) AS bce_loss, round(avg(focal), 6) AS focal_loss,
  round(avg(CASE WHEN (x > 0) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM f"""
