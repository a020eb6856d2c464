"""Feature store over documents (paths), split roles (jobs) and embeddings (features)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import CATALOGUE_SQL, catalogue, r6, table, with_sql
from pairloom.operators import store as ops

QUERIES: dict = {}
SQL: dict = {}


def _jobs(spark, sf):
    variants = F.explode(F.sequence(F.lit(0), F.when(F.col("split") == "train", 2).otherwise(0)))
    return catalogue(spark, sf).select("doc_id", "path", variants.alias("variant"))


# keys already stored: raw for two thirds of the tracks, variants for a quarter of the jobs
def _stored(spark, sf):
    i, v = F.col("doc_id"), F.col("variant")
    kept = _jobs(spark, sf).where(((v == 0) & (i % 3 != 0)) | ((v > 0) & (i % 4 == 1)))
    return kept.select(
        ops.cache_key(F.col("path"), v).alias("cache_key"), F.array((i * 10 + v).cast("double")).alias("features")
    )


def key_sql(path: str, variant: str) -> str:
    return (
        f"sha256({path} || '|10.0|5.0|16000' || CASE WHEN {variant} > 0 THEN '|aug_' || {variant} ELSE '' END)"
    )


_JOBS = """jobs AS (SELECT doc_id, path, unnest(range(0, CASE WHEN split = 'train' THEN 3 ELSE 1 END)) AS variant FROM cat)"""
_STORED = f"""st AS (SELECT {key_sql('path', 'variant')} AS key, (doc_id * 10 + variant)::DOUBLE AS f FROM jobs
  WHERE (variant = 0 AND doc_id % 3 <> 0) OR (variant > 0 AND doc_id % 4 = 1))"""

QUERIES["k01_cache_key"] = lambda spark, sf: _jobs(spark, sf).withColumn(
    "cache_key", ops.cache_key(F.col("path"), F.col("variant"))
)
SQL["k01_cache_key"] = with_sql(CATALOGUE_SQL, _JOBS) + f"SELECT *, {key_sql('path', 'variant')} AS cache_key FROM jobs"

QUERIES["k02_lookup_features"] = lambda spark, sf: ops.lookup_features(
    _jobs(spark, sf), _stored(spark, sf)
).select("doc_id", "variant", "origin", F.element_at("features", 1).alias("f"))
SQL["k02_lookup_features"] = with_sql(CATALOGUE_SQL, _JOBS, _STORED) + f"""
SELECT doc_id, variant, CASE WHEN o.f IS NOT NULL THEN 'variant' WHEN r.f IS NOT NULL THEN 'raw' ELSE 'compute' END AS origin,
  coalesce(o.f, r.f) AS f
FROM jobs LEFT JOIN st o ON o.key = {key_sql('path', 'variant')} LEFT JOIN st r ON r.key = {key_sql('path', '0')}"""


def _refresh(spark, sf):
    docs = catalogue(spark, sf).select("path", "n_chars")

    def compute(todo):
        bad = F.col("n_chars") % 5 == 0
        return todo.join(docs, "path").select(
            "cache_key",
            F.when(~bad, F.array(F.col("n_chars").cast("double"))).alias("features"),
            F.when(bad, "unreadable").alias("error"),
        )

    return ops.refresh_store(_jobs(spark, sf), _stored(spark, sf), compute)


QUERIES["k03_refresh_counts"] = lambda spark, sf: _refresh(spark, sf)[1]
SQL["k03_refresh_counts"] = with_sql(CATALOGUE_SQL, _JOBS, _STORED) + f"""
SELECT CASE WHEN s.key IS NOT NULL THEN 'skipped' WHEN c.n_chars % 5 = 0 THEN 'failed' ELSE 'computed' END AS status,
  count(*) AS n
FROM jobs j JOIN cat c USING (path) LEFT JOIN st s ON s.key = {key_sql('j.path', 'j.variant')} GROUP BY 1"""
QUERIES["k03_refresh_rows"] = lambda spark, sf: _refresh(spark, sf)[0].select(
    "cache_key", F.element_at("features", 1).alias("f")
)
SQL["k03_refresh_rows"] = with_sql(CATALOGUE_SQL, _JOBS, _STORED) + f"""
SELECT {key_sql('j.path', 'j.variant')} AS cache_key, c.n_chars::DOUBLE AS f
FROM jobs j JOIN cat c USING (path) LEFT JOIN st s ON s.key = {key_sql('j.path', 'j.variant')}
WHERE s.key IS NULL AND c.n_chars % 5 <> 0"""

QUERIES["k04_feature_stats"] = lambda spark, sf: ops.feature_stats(
    table(spark, sf, "embeddings"), "embedding"
).select("count", F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "z")).select(
    "count", "dim", r6(F.col("z.mean")).alias("mean"), r6(F.col("z.std")).alias("std")
)
_LONG = "lng AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)"
SQL["k04_feature_stats"] = with_sql(_LONG) + """
SELECT count(*) AS count, dim, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) AS std FROM lng GROUP BY dim"""

QUERIES["k05_standardise"] = lambda spark, sf: ops.standardise(
    table(spark, sf, "embeddings"), ops.feature_stats(table(spark, sf, "embeddings"), "embedding"), "embedding"
).select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", r6(F.col("value")))
SQL["k05_standardise"] = with_sql(_LONG) + """
SELECT vec_id, dim, round((v - avg(v) OVER d) / (stddev_samp(v) OVER d + 1e-8), 6) + 0.0 AS value
FROM lng WINDOW d AS (PARTITION BY dim)"""
