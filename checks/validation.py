"""Validation over documents as a file listing with header facts derived from their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import ANNOTATED_SQL, annotated, table, with_sql
from pairloom.operators import validation as ops

QUERIES: dict = {}
SQL: dict = {}


# every document stands for a file whose facts vary with its numbers
def _headers(spark, sf):
    docs = table(spark, sf, "documents")
    i = F.col("doc_id")
    return docs.where(i % 17 != 0).select(
        F.concat("source", F.lit("/"), i, F.lit(".wav")).alias("path"),
        F.when(i % 13 == 0, 0).otherwise(F.col("n_chars")).alias("size"),
        (i % 11 != 0).alias("readable"),
        F.when(i % 11 == 0, "bad header").alias("error"),
        F.when(i % 7 == 0, 44100).otherwise(16000).alias("sample_rate"),
        F.when(i % 5 == 0, 2).otherwise(1).alias("channels"),
        (F.col("n_chars") / 8000.0).alias("duration"),
    )


def _refs(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".wav")).alias("path"), F.col("lang").alias("dataset")
    )


VERDICT_SQL = """ver AS (
  SELECT source || '/' || doc_id || '.wav' AS path, lang AS dataset,
    CASE WHEN doc_id % 17 = 0 THEN 'missing'
         WHEN doc_id % 13 = 0 OR n_chars = 0 THEN 'empty file (0 bytes)'
         WHEN doc_id % 11 = 0 THEN 'corrupt (bad header)'
         WHEN doc_id % 7 = 0 THEN 'wrong sample rate (44100 Hz, expected 16000)'
         WHEN doc_id % 5 = 0 THEN 'not mono (2 channels)'
         WHEN n_chars / 8000.0::DOUBLE <= 0.1 THEN 'too short (' || round(CAST(n_chars / 8000.0 AS DECIMAL(18, 9)), 3)::DECIMAL(18, 3) || 's, min 0.1s)'
         ELSE '' END AS reason FROM documents)"""
CATEGORY_SQL = VERDICT_SQL + """,
cats AS (SELECT path, dataset, reason = '' AS valid, reason,
  CASE WHEN reason = '' THEN 'ok' WHEN reason = 'missing' THEN 'missing'
       WHEN reason LIKE 'corrupt%' THEN 'corrupt' ELSE 'wrong_format' END AS category FROM ver)"""

_verdicts = lambda spark, sf: ops.validate(_refs(spark, sf), _headers(spark, sf))

QUERIES["b01_validate"] = _verdicts
SQL["b01_validate"] = with_sql(VERDICT_SQL) + "SELECT path, dataset, reason = '' AS valid, reason FROM ver"

QUERIES["b02_referenced_files"] = lambda spark, sf: ops.referenced_files(
    annotated(spark, sf), ["track_a", "track_b", "absent"]
)
_REFS = """refs AS (SELECT DISTINCT path FROM (SELECT trim(track_a) AS path FROM ann UNION ALL SELECT trim(track_b) FROM ann)
  WHERE path IS NOT NULL AND path NOT IN ('', 'nan'))"""
SQL["b02_referenced_files"] = with_sql(ANNOTATED_SQL, _REFS) + "SELECT path FROM refs"


def _orphans(spark, sf):
    disk = table(spark, sf, "documents").select(F.concat(F.lit("t"), "doc_id").alias("path"))
    return ops.orphans(disk, ops.referenced_files(annotated(spark, sf), ["track_a", "track_b"]))


QUERIES["b03_orphans"] = _orphans
SQL["b03_orphans"] = with_sql(ANNOTATED_SQL, _REFS) + """
SELECT path FROM (SELECT 't' || doc_id AS path FROM documents) WHERE path NOT IN (SELECT path FROM refs)"""

QUERIES["b04_categorise"] = lambda spark, sf: ops.categorise(_verdicts(spark, sf))
SQL["b04_categorise"] = with_sql(CATEGORY_SQL) + "SELECT * FROM cats"


def _summary(spark, sf):
    docs = table(spark, sf, "documents")
    loose = docs.where(F.col("n_chars") % 3 == 0).select(
        F.col("lang").alias("dataset"), F.concat("source", F.lit("/x"), "doc_id").alias("path")
    )
    return ops.validation_summary(ops.categorise(_verdicts(spark, sf)), loose)


QUERIES["b05_validation_summary"] = _summary
SQL["b05_validation_summary"] = with_sql(CATEGORY_SQL) + """,
loose AS (SELECT lang AS dataset, source || '/x' || doc_id AS path FROM documents WHERE n_chars % 3 = 0),
o AS (SELECT dataset, count(*) AS n FROM loose GROUP BY 1),
f AS (SELECT dataset, string_agg(path, ',' ORDER BY path) AS p FROM (
   SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY path) AS rn FROM loose) WHERE rn <= 5 GROUP BY 1),
t AS (SELECT dataset, count(*) AS total, count(*) FILTER (category = 'ok') AS n_ok,
   count(*) FILTER (category = 'missing') AS n_missing, count(*) FILTER (category = 'corrupt') AS n_corrupt,
   count(*) FILTER (category = 'wrong_format') AS n_wrong_format FROM cats GROUP BY 1)
SELECT t.*, coalesce(o.n, 0) AS n_orphans, coalesce(f.p, '') AS first_orphans,
  CASE WHEN total = n_ok THEN 'OK' ELSE 'ISSUES FOUND' END AS status
FROM t LEFT JOIN o USING (dataset) LEFT JOIN f USING (dataset)"""


def _bad(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.where(F.length("url") % 4 == 0).select(F.concat(F.lit("root/t"), "page_id").alias("path"))


_BAD = "bad AS (SELECT 't' || page_id AS name FROM pages WHERE length(url) % 4 = 0)"
_KEPT = """kept AS (SELECT * FROM ann WHERE track_a NOT IN (SELECT name FROM bad)
  AND (track_b IS NULL OR trim(track_b) NOT IN (SELECT name FROM bad)))"""
QUERIES["b06_drop_invalid_rows"] = lambda spark, sf: ops.drop_invalid_rows(
    annotated(spark, sf), _bad(spark, sf), ["track_a", "track_b"]
)
SQL["b06_drop_invalid_rows"] = with_sql(ANNOTATED_SQL, _BAD, _KEPT) + "SELECT * FROM kept"
QUERIES["b06_rows_removed"] = lambda spark, sf: ops.rows_removed(
    annotated(spark, sf),
    ops.drop_invalid_rows(annotated(spark, sf), _bad(spark, sf), ["track_a", "track_b"]),
)
SQL["b06_rows_removed"] = with_sql(ANNOTATED_SQL, _BAD, _KEPT) + """
SELECT (SELECT count(*) FROM ann) AS rows_before, (SELECT count(*) FROM kept) AS rows_after,
  (SELECT count(*) FROM ann) - (SELECT count(*) FROM kept) AS rows_removed"""

_WANTED = {"documents": ["doc_id", "text", "caption"], "labels": ["doc_id", "label", "split"], "pages": ["page_id", "url"]}
QUERIES["b07_missing_columns"] = lambda spark, sf: ops.missing_columns({name: table(spark, sf, name) for name in _WANTED}, _WANTED)
SQL["b07_missing_columns"] = """SELECT w.t AS dataset, w.c AS column_name, n.n AS n_rows
FROM (VALUES ('documents', 'doc_id'), ('documents', 'text'), ('documents', 'caption'), ('labels', 'doc_id'), ('labels', 'label'),
  ('labels', 'split'), ('pages', 'page_id'), ('pages', 'url')) w(t, c)
JOIN (SELECT 'documents' AS t, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels
  UNION ALL SELECT 'pages', count(*) FROM pages) n ON n.t = w.t
LEFT JOIN duckdb_columns() d ON d.table_name = w.t AND d.column_name = w.c
WHERE d.column_name IS NULL"""
