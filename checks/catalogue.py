"""Catalogue preparation over documents, labels and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import (
    ANNOTATED_SQL, CATALOGUE_SQL, RENDITIONS_SQL, annotated, catalogue, renditions, table, with_sql,
)
from checks.windows import SERIES_SQL, series
from pairloom.operators import catalogue as ops
from pairloom.operators.blocks import block_table
from pairloom.session import shared_folder
from pairloom.sources import signals

QUERIES: dict = {}
SQL: dict = {}

GENERATORS = ["src1", "src4", "src7", "src11", "src16"]


def _vendor(spark, sf):
    cat = catalogue(spark, sf)
    split = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("split")).alias("split")
    fake = cat.where(F.col("label") == "ai").select(
        F.col("path").alias("filename"),
        F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"),
        split,
    )
    real = cat.where(F.col("label") == "real").select(F.col("path").alias("filename"), split)
    return fake, real


QUERIES["a02_keep_existing"] = lambda spark, sf: ops.keep_existing(
    annotated(spark, sf),
    table(spark, sf, "pages").select(F.concat(F.lit("t"), "page_id").alias("path")),
    ["track_a", "track_b"],
).select("pair_id", "track_a", "track_b")
SQL["a02_keep_existing"] = with_sql(ANNOTATED_SQL, "disk AS (SELECT 't' || page_id AS path FROM pages)") + """
SELECT pair_id, track_a, track_b FROM ann
WHERE track_a IN (SELECT path FROM disk) AND track_b IN (SELECT path FROM disk)"""

def _signal_files(spark, sf):
    """Each user's event values written as a WAV file and read back by ranges."""
    folder = f"{shared_folder(spark).rstrip('/')}/signals/{uuid.uuid4().hex}"
    blocks = block_table(series(spark, sf))
    files = signals.write_signals(blocks, folder)
    written = files.count()
    read = signals.ingest_signals(signals.read_signal_blocks(spark, folder))
    name = F.regexp_extract("track_id", r"([^/]+)[.]wav$", 1).cast("long")
    return read.select(name.alias("track_id"), "pos", "value", "n", F.lit(written).alias("files"))


QUERIES["a03_signal_files"] = _signal_files
SQL["a03_signal_files"] = with_sql(SERIES_SQL) + "SELECT track_id, pos, value, n, (SELECT count(DISTINCT track_id) FROM ser) AS files FROM ser"
QUERIES["a04_normalise_labels"] = lambda spark, sf: ops.normalise_labels(*_vendor(spark, sf))
SQL["a04_normalise_labels"] = with_sql(CATALOGUE_SQL) + """
SELECT path AS filename, label,
       CASE WHEN label = 'real' THEN 'real' WHEN doc_id % 9 = 0 THEN 'unknown' ELSE source END AS generator,
       CASE WHEN doc_id % 4 = 0 THEN 'train' ELSE split END AS split FROM cat"""

QUERIES["a05_dedupe_pairs"] = lambda spark, sf: ops.dedupe_pairs(
    table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.col("text").alias("title"), F.length("text").alias("link"), "n_chars"
    ),
    ["lang", "title", "link", "n_chars"],
    "doc_id",
).select("doc_id", "lang", "source", "n_chars")
SQL["a05_dedupe_pairs"] = """
SELECT doc_id, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, text, length(text), n_chars ORDER BY doc_id) AS rn
  FROM documents) WHERE rn = 1"""

QUERIES["a06_sanitise_titles"] = lambda spark, sf: table(spark, sf, "pages").select(
    "page_id",
    ops.sanitise(F.col("url")).alias("title"),
    ops.pair_filename(F.col("page_id"), "a", F.col("url")).alias("file_a"),
    ops.pair_filename(F.col("page_id"), "b", F.col("html")).alias("file_b"),
)
_CLEAN = r"substr(trim(regexp_replace({0}, '[^\p{{L}}\p{{N}} _-]', '_', 'g'), ' '), 1, 100)"
_PAD = "CASE WHEN page_id < 1000 THEN lpad(CAST(page_id AS VARCHAR), 3, '0') ELSE CAST(page_id AS VARCHAR) END"
SQL["a06_sanitise_titles"] = f"""
SELECT page_id, {_CLEAN.format('url')} AS title,
  'pair' || {_PAD} || '_a_' || substr({_CLEAN.format('url')}, 1, 50) || '.wav' AS file_a,
  'pair' || {_PAD} || '_b_' || substr({_CLEAN.format('html')}, 1, 50) || '.wav' AS file_b
FROM pages"""


def _attach(spark, sf):
    docs = table(spark, sf, "documents")
    captions = docs.select(
        F.when(F.col("doc_id") % 11 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit(" k"), F.floor(F.col("doc_id") / 3), F.lit(" ")))
        .alias("key"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("text")).alias("caption"),
        "doc_id",
    )
    tracks = docs.select("doc_id", F.concat(F.lit("k"), F.floor(F.col("doc_id") / 2)).alias("key"))
    lookup = ops.caption_lookup(captions, "key", "caption", "doc_id")
    return ops.attach_caption(tracks, lookup, "key", "caption").select("doc_id", "key", "caption")


QUERIES["a07_attach_caption"] = _attach
SQL["a07_attach_caption"] = """
WITH cap AS (
  SELECT trim(CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE ' k' || (doc_id // 3) || ' ' END, ' ') AS key,
         coalesce(trim(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END, ' '), '') AS caption, doc_id
  FROM documents),
last AS (SELECT key, caption FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id DESC) AS rn FROM cap WHERE key <> '') WHERE rn = 1)
SELECT d.doc_id, 'k' || (d.doc_id // 2) AS key, coalesce(l.caption, '') AS caption
FROM documents d LEFT JOIN last l ON l.key = 'k' || (d.doc_id // 2)"""

QUERIES["a08_valid_generator"] = lambda spark, sf: ops.valid_generator(
    renditions(spark, sf), GENERATORS, "model"
).select("doc_id", "path", "model")
SQL["a08_valid_generator"] = with_sql(RENDITIONS_SQL) + """
SELECT doc_id, path, model FROM ren WHERE model IN ('src1','src4','src7','src11','src16')"""


def _listing(spark, sf):
    docs = table(spark, sf, "documents")
    root = F.when(F.col("doc_id") % 13 == 0, "pack/__MACOSX/data/").otherwise(
        F.when(F.col("doc_id") % 3 == 0, "pack/extra/").otherwise("pack/data/")
    )
    hidden = F.when(F.col("doc_id") % 6 == 0, "._").otherwise("")
    return docs.select(F.concat(root, "source", F.lit("/"), hidden, "doc_id", F.lit(".wav")).alias("path"))


QUERIES["a09_discover_groups"] = lambda spark, sf: ops.discover_groups(_listing(spark, sf))
SQL["a09_discover_groups"] = """
WITH f AS (
  SELECT CASE WHEN doc_id % 13 = 0 THEN 'pack/__MACOSX/data/' WHEN doc_id % 3 = 0 THEN 'pack/extra/'
              ELSE 'pack/data/' END AS root, source, doc_id FROM documents),
ok AS (SELECT root, source FROM f WHERE doc_id % 13 <> 0 AND doc_id % 6 <> 0)
SELECT source AS name, min(root || source) AS folder FROM ok GROUP BY source
UNION ALL SELECT DISTINCT 'pack', 'pack' FROM ok
UNION ALL SELECT split_part(root, '/', 2), min('pack/' || split_part(root, '/', 2)) FROM ok GROUP BY 1"""

QUERIES["a10_proportional_sample"] = lambda spark, sf: ops.proportional_sample(
    catalogue(spark, sf), "label", "ai", "real", 120, "doc_id"
).select("doc_id", "label", "rn")
SQL["a10_proportional_sample"] = with_sql(CATALOGUE_SQL) + """,
s AS (SELECT count(*) FILTER (label = 'ai') AS nf, count(*) FILTER (label = 'real') AS nr,
             least(120, count(*)) AS total FROM cat),
q0 AS (SELECT nf, nr, total, total * nf // (nf + nr) AS qf FROM s),
q AS (SELECT total, CASE WHEN qf = 0 AND nf > 0 AND total >= 2 THEN 1
                         WHEN qf = total AND nr > 0 AND total >= 2 THEN total - 1 ELSE qf END AS qf FROM q0),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn FROM cat)
SELECT doc_id, label, rn FROM r, q WHERE rn <= CASE WHEN label = 'ai' THEN qf ELSE total - qf END"""

QUERIES["a11_per_group_quota"] = lambda spark, sf: ops.per_group_quota(
    renditions(spark, sf).select("doc_id", "path", "model"), "model", 150, "path", "doc_id",
    renditions(spark, sf).where(F.col("doc_id") % 4 == 0).select("path"),
)
SQL["a11_per_group_quota"] = with_sql(RENDITIONS_SQL) + """,
q AS (SELECT greatest(1, CAST(ceil(150.0 / count(DISTINCT model)) AS BIGINT)) AS quota FROM ren),
r AS (SELECT doc_id, path, model, row_number() OVER (PARTITION BY model ORDER BY doc_id) AS rn FROM ren)
SELECT doc_id, path, model, rn FROM r, q WHERE rn <= quota AND doc_id % 4 <> 0"""

QUERIES["a12_incremental_new"] = lambda spark, sf: ops.incremental_new(
    annotated(spark, sf),
    ops.completed_keys(annotated(spark, sf).where(F.col("pair_id") % 2 == 0), "pair_id", ["track_a", "track_b"]),
    ["pair_id"],
)
SQL["a12_incremental_new"] = with_sql(ANNOTATED_SQL) + """
SELECT * FROM ann WHERE pair_id NOT IN (
  SELECT pair_id FROM ann WHERE pair_id % 2 = 0 AND coalesce(track_a, '') <> '' AND coalesce(track_b, '') <> '')"""

QUERIES["a13_append_catalogue"] = lambda spark, sf: ops.append_catalogue(
    renditions(spark, sf).where(F.col("doc_id") % 2 == 0).select("path", "model", "doc_id"),
    renditions(spark, sf).where(F.col("doc_id") % 2 == 1).select("doc_id", "model", "path"),
)
SQL["a13_append_catalogue"] = with_sql(RENDITIONS_SQL) + "SELECT path, model, doc_id FROM ren"

QUERIES["a14_unify_catalogues"] = lambda spark, sf: ops.unify_catalogues(
    labelled=catalogue(spark, sf).select(F.col("path").alias("filename"), "label", "generator", "split"),
    renditions=renditions(spark, sf).select(F.col("path").alias("filename"), "model", "caption"),
    annotated=annotated(spark, sf),
).select("source", "class_label", "filename", "split", "caption", "track_b")
SQL["a14_unify_catalogues"] = with_sql(CATALOGUE_SQL, RENDITIONS_SQL, ANNOTATED_SQL) + """
SELECT 'labelled' AS source, generator AS class_label, path AS filename, split, NULL AS caption, NULL AS track_b FROM cat
UNION ALL SELECT 'renditions', model, path, NULL, caption, NULL FROM ren
UNION ALL SELECT 'annotated', similarity_label, track_a, NULL, NULL, track_b FROM ann"""

QUERIES["a16_head_per_group"] = lambda spark, sf: ops.head_per_group(
    catalogue(spark, sf), "label", 5, [F.col("doc_id")]
).select("doc_id", "label", "rn")
SQL["a16_head_per_group"] = with_sql(CATALOGUE_SQL) + """
SELECT doc_id, label, rn FROM (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn FROM cat) WHERE rn <= 5"""
