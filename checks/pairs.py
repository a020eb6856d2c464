"""Pair construction and splitting over the document catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    ANNOTATED_SQL, CATALOGUE_SQL, RENDITIONS_SQL, annotated, catalogue, int_sql, md5_sql, r6,
    renditions, with_sql,
)
from pairloom.operators import pairs as ops
from pairloom.plans import pair_table

QUERIES: dict = {}
SQL: dict = {}


def sample_sql(name: str, pool_a: str, pool_b: str, n: str, seed: str) -> str:
    """CTEs that draw up to n distinct ordered pairs of paths."""
    numbered = (
        "SELECT path, row_number() OVER (ORDER BY "
        + md5_sql(f"{seed}|pool", "path")
        + ", path) - 1 AS i FROM ({0})"
    )
    return f"""{name}_a AS ({numbered.format(pool_a)}),
{name}_b AS ({numbered.format(pool_b)}),
{name}_n AS (SELECT CAST({n} AS BIGINT) AS n),
{name}_d AS (SELECT draw, {int_sql(f'{seed}|a', 'draw')} % (SELECT count(*) FROM {name}_a) AS ia,
                    {int_sql(f'{seed}|b', 'draw')} % (SELECT count(*) FROM {name}_b) AS ib
             FROM (SELECT unnest(range(0, n * 5)) AS draw FROM {name}_n)),
{name}_u AS (SELECT a.path AS track_a_path, b.path AS track_b_path, min(draw) AS draw
             FROM {name}_d JOIN {name}_a a ON ia = a.i JOIN {name}_b b ON ib = b.i
             WHERE a.path <> b.path GROUP BY 1, 2),
{name} AS (SELECT track_a_path, track_b_path, draw FROM (
             SELECT *, row_number() OVER (ORDER BY draw) AS rk FROM {name}_u)
           WHERE rk <= (SELECT n FROM {name}_n))"""


_REAL = "SELECT path FROM cat WHERE label = 'real'"
_AI = "SELECT path FROM cat WHERE label = 'ai'"
_NPOS = """(SELECT least(r * a, greatest(r, a)) FROM (
  SELECT count(*) FILTER (label = 'real') AS r, count(*) FILTER (label = 'ai') AS a FROM cat))"""
POS = sample_sql("pos", _REAL, _AI, _NPOS, "42|pos")
NEG = sample_sql("neg", _REAL, _REAL, "(SELECT count(*) FROM pos)", "42|neg")


def hard_sql(name: str, source: str, group: str, cap: int, seed: str = "42") -> str:
    return f"""{name}_h AS (SELECT * FROM (
    SELECT {group} AS g, path, row_number() OVER (PARTITION BY {group} ORDER BY doc_id) AS rn FROM {source})
  WHERE rn <= {cap}),
{name}_c AS (SELECT a.g, a.path AS track_a_path, b.path AS track_b_path
  FROM {name}_h a JOIN {name}_h b ON a.g = b.g AND a.rn < b.rn),
{name} AS (SELECT track_a_path, track_b_path FROM (
    SELECT *, count(*) OVER (PARTITION BY g) AS n,
      row_number() OVER (PARTITION BY g ORDER BY {md5_sql(f'{seed}|hard', 'track_a_path', 'track_b_path')},
        track_a_path, track_b_path) AS k FROM {name}_c)
  WHERE k <= greatest(10, n // 4))"""


HARD = hard_sql("hard", "(SELECT * FROM cat WHERE label = 'ai')", "generator", 50)
MODEL = hard_sql("hmod", "ren", "model", 40)

SHARED = f"""sh AS (SELECT path, replace(regexp_extract(path, '([^_]*)$', 1), '.wav', '') AS key FROM ren),
sh_r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {md5_sql('42|shared', 'path')}, path) AS rn FROM sh),
sh_n AS (SELECT key, count(*) AS n, count(*) * (count(*) - 1) // 2 AS m FROM sh GROUP BY key HAVING count(*) >= 2),
sh_t AS (SELECT key, m, ({int_sql('42|start', 'key')} % m + j * (m // take)) % m AS t FROM (
   SELECT key, m, least(m, 5) AS take, unnest(range(0, least(m, 5))) AS j FROM sh_n)),
sh_c AS (SELECT a.key, a.path AS track_a_path, b.path AS track_b_path,
   (b.rn - 1) * (b.rn - 2) // 2 + a.rn - 1 AS t
   FROM sh_r a JOIN sh_r b ON a.key = b.key AND a.rn < b.rn),
shared AS (SELECT c.track_a_path, c.track_b_path FROM sh_c c JOIN sh_t p ON p.key = c.key AND p.t = c.t)"""

ANNOT = """annp AS (SELECT track_a AS track_a_path, track_b AS track_b_path FROM ann
  WHERE coalesce(track_a, '') <> '' AND coalesce(track_b, '') <> '')"""
EXCL = (
    sample_sql(
        "exd",
        "SELECT track_a_path AS path FROM annp UNION SELECT track_b_path FROM annp",
        "SELECT track_a_path AS path FROM annp UNION SELECT track_b_path FROM annp",
        "(SELECT count(*) FROM annp)",
        "42|excl",
    )
    + """,
excl AS (SELECT d.track_a_path, d.track_b_path FROM exd d WHERE NOT EXISTS (
  SELECT 1 FROM annp p WHERE (p.track_a_path = d.track_a_path AND p.track_b_path = d.track_b_path)
                          OR (p.track_a_path = d.track_b_path AND p.track_b_path = d.track_a_path)))"""
)
CROSS = sample_sql("crs", _REAL, "SELECT path FROM ren", "500", "42|cross")

ALL = """allp AS (
  SELECT track_a_path, track_b_path, 1 AS label, 'positive' AS pair_type FROM pos
  UNION ALL SELECT track_a_path, track_b_path, 0, 'negative' FROM neg
  UNION ALL SELECT track_a_path, track_b_path, 0, 'hard_negative' FROM hard
  UNION ALL SELECT track_a_path, track_b_path, 1, 'positive' FROM annp
  UNION ALL SELECT track_a_path, track_b_path, 0, 'negative' FROM excl
  UNION ALL SELECT track_a_path, track_b_path, 0, 'negative' FROM crs
  UNION ALL SELECT track_a_path, track_b_path, 0, 'hard_negative' FROM hmod
  UNION ALL SELECT track_a_path, track_b_path, 1, 'fmc_positive' FROM shared)"""
EVERY = with_sql(CATALOGUE_SQL, RENDITIONS_SQL, ANNOTATED_SQL, POS, NEG, HARD, ANNOT, EXCL, CROSS, MODEL, SHARED, ALL)

_SPLIT_H = md5_sql("42|split", "track_a_path", "track_b_path", "pair_type")
SPLIT = EVERY + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_SPLIT_H}, track_a_path, track_b_path, pair_type) AS r FROM allp),
ct AS (SELECT label, count(*) AS n FROM allp GROUP BY 1),
t0 AS (SELECT label, n, ceil(round(0.15::DOUBLE * sum(n) OVER (), 9)) AS q, sum(n) OVER () AS tot FROM ct),
t1 AS (SELECT label, n, q, floor(q * n / tot) AS f, q * n / tot - floor(q * n / tot) AS fr FROM t0),
t2 AS (SELECT label, n, CAST(f + CASE WHEN row_number() OVER (ORDER BY round(fr, 9) DESC, label) <= q - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS nt FROM t1),
v0 AS (SELECT label, nt, n - nt AS m, ceil(round(0.15::DOUBLE / 0.85::DOUBLE * sum(n - nt) OVER (), 9)) AS q, sum(n - nt) OVER () AS tot FROM t2),
v1 AS (SELECT label, nt, q, floor(q * m / tot) AS f, q * m / tot - floor(q * m / tot) AS fr FROM v0),
v2 AS (SELECT label, nt, CAST(f + CASE WHEN row_number() OVER (ORDER BY round(fr, 9) DESC, label) <= q - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS nv FROM v1),
sv AS (SELECT rk.*, nt, nv FROM rk JOIN v2 USING (label)),
sp AS (SELECT track_a_path, track_b_path, label, pair_type,
   CASE WHEN r <= nt THEN 'test' WHEN r <= nt + nv THEN 'val' ELSE 'train' END AS split FROM sv)
"""
ROLES = SPLIT + """, roles AS (SELECT path, bool_or(split = 'train') AS in_train FROM (
  SELECT track_a_path AS path, split FROM sp UNION ALL SELECT track_b_path, split FROM sp) GROUP BY path)
"""


def every_pair(spark, sf):
    return pair_table.all_pairs(
        catalogue(spark, sf), renditions(spark, sf), annotated(spark, sf), order=[F.col("doc_id")]
    )


def split_pairs(spark, sf):
    return pair_table.split_table(every_pair(spark, sf))


def roles(spark, sf):
    return ops.track_roles(split_pairs(spark, sf))


_real = lambda spark, sf: catalogue(spark, sf).where(F.col("label") == "real").select("path")

QUERIES["c01_sample_pairs"] = lambda spark, sf: ops.sample_pairs(
    _real(spark, sf), renditions(spark, sf).select("path"), 300, "7"
)
SQL["c01_sample_pairs"] = with_sql(
    CATALOGUE_SQL, RENDITIONS_SQL, sample_sql("s", _REAL, "SELECT path FROM ren", "300", "7")
) + "SELECT * FROM s"

QUERIES["c02_class_positive_pairs"] = lambda spark, sf: ops.class_positive_pairs(catalogue(spark, sf))
SQL["c02_class_positive_pairs"] = with_sql(CATALOGUE_SQL, POS) + (
    "SELECT track_a_path, track_b_path, 1 AS label, 'positive' AS pair_type FROM pos"
)


def _negatives(spark, sf):
    cat = catalogue(spark, sf)
    return ops.class_negative_pairs(cat, ops.class_positive_pairs(cat).count())


QUERIES["c03_class_negative_pairs"] = _negatives
SQL["c03_class_negative_pairs"] = with_sql(CATALOGUE_SQL, POS, NEG) + (
    "SELECT track_a_path, track_b_path, 0 AS label, 'negative' AS pair_type FROM neg"
)

QUERIES["c04_hard_negatives"] = lambda spark, sf: ops.hard_negatives(
    catalogue(spark, sf).where(F.col("label") == "ai"), "generator", [F.col("doc_id")]
)
SQL["c04_hard_negatives"] = with_sql(CATALOGUE_SQL, HARD) + (
    "SELECT track_a_path, track_b_path, 0 AS label, 'hard_negative' AS pair_type FROM hard"
)
QUERIES["c05_model_hard_negatives"] = lambda spark, sf: ops.hard_negatives(
    renditions(spark, sf), "model", [F.col("doc_id")], ops.MODEL_CAP
)
SQL["c05_model_hard_negatives"] = with_sql(RENDITIONS_SQL, MODEL) + (
    "SELECT track_a_path, track_b_path, 0 AS label, 'hard_negative' AS pair_type FROM hmod"
)

QUERIES["c06_annotated_positives"] = lambda spark, sf: ops.annotated_positives(
    pair_table.complete(annotated(spark, sf))
)
SQL["c06_annotated_positives"] = with_sql(ANNOTATED_SQL, ANNOT) + (
    "SELECT track_a_path, track_b_path, 1 AS label, 'positive' AS pair_type FROM annp"
)
QUERIES["c07_negatives_excluding"] = lambda spark, sf: ops.negatives_excluding(
    ops.annotated_positives(pair_table.complete(annotated(spark, sf)))
)
SQL["c07_negatives_excluding"] = with_sql(ANNOTATED_SQL, ANNOT, EXCL) + (
    "SELECT track_a_path, track_b_path, 0 AS label, 'negative' AS pair_type FROM excl"
)
QUERIES["c08_cross_source_negatives"] = lambda spark, sf: ops.cross_source_negatives(
    _real(spark, sf), renditions(spark, sf)
)
SQL["c08_cross_source_negatives"] = with_sql(CATALOGUE_SQL, RENDITIONS_SQL, CROSS) + (
    "SELECT track_a_path, track_b_path, 0 AS label, 'negative' AS pair_type FROM crs"
)
QUERIES["c09_shared_key_positives"] = lambda spark, sf: ops.shared_key_positives(
    renditions(spark, sf), ops.shared_key(F.col("path"))
)
SQL["c09_shared_key_positives"] = with_sql(RENDITIONS_SQL, SHARED) + (
    "SELECT track_a_path, track_b_path, 1 AS label, 'fmc_positive' AS pair_type FROM shared"
)

QUERIES["c10_all_pairs"] = every_pair
SQL["c10_all_pairs"] = EVERY + "SELECT * FROM allp"
QUERIES["c11_pair_balance"] = lambda spark, sf: ops.pair_balance(every_pair(spark, sf)).withColumn(
    "ratio", r6(F.col("ratio"))
)
SQL["c11_pair_balance"] = EVERY + """
SELECT n_pos, n_neg, round(n_pos / greatest(n_neg, 1), 6) AS ratio,
       n_pos / greatest(n_neg, 1) < 0.3 OR n_pos / greatest(n_neg, 1) > 3.0 AS skewed
FROM (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM allp)"""
QUERIES["c11_pair_type_counts"] = lambda spark, sf: ops.pair_type_counts(every_pair(spark, sf))
SQL["c11_pair_type_counts"] = EVERY + "SELECT pair_type, count(*) AS n FROM allp GROUP BY pair_type"
QUERIES["c12_stratified_split"] = split_pairs
SQL["c12_stratified_split"] = SPLIT + "SELECT * FROM sp"
QUERIES["c12_split_leaks"] = lambda spark, sf: ops.split_leaks(split_pairs(spark, sf))
SQL["c12_split_leaks"] = SPLIT + """
SELECT path, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM (
  SELECT track_a_path AS path, split FROM sp UNION ALL SELECT track_b_path, split FROM sp)
GROUP BY path HAVING count(DISTINCT split) > 1"""
QUERIES["c13_track_roles"] = roles
SQL["c13_track_roles"] = ROLES + "SELECT * FROM roles"
QUERIES["c14_variant_jobs"] = lambda spark, sf: ops.variant_jobs(roles(spark, sf), 5)
SQL["c14_variant_jobs"] = ROLES + (
    "SELECT path, unnest(range(0, CASE WHEN in_train THEN 6 ELSE 1 END)) AS variant FROM roles"
)
QUERIES["c15_pick_variant"] = lambda spark, sf: ops.pick_variant(every_pair(spark, sf), 5)
SQL["c15_pick_variant"] = EVERY + f"""
SELECT *, {int_sql('42|variant', 'track_a_path', 'track_b_path')} % 6 AS variant FROM allp"""
QUERIES["c16_as_views"] = lambda spark, sf: ops.as_views(every_pair(spark, sf))
SQL["c16_as_views"] = EVERY + (
    "SELECT track_a_path || '|' || track_b_path AS view_id, track_a_path AS view_1, track_b_path AS view_2 FROM allp"
)
QUERIES["c16_as_singles"] = lambda spark, sf: ops.as_singles(every_pair(spark, sf))
SQL["c16_as_singles"] = EVERY + "SELECT track_a_path AS path, label FROM allp"
