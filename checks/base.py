"""Inputs shared by the registered queries, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col, digits: int = 6):
    """Rounded double, so that summation order does not show."""
    return F.round(col.cast("double"), digits)


def md5_sql(seed: str, *cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(cols)}))"


def int_sql(seed: str, *cols: str) -> str:
    return f"CAST('0x' || substr({md5_sql(seed, *cols)}, 1, 15) AS BIGINT)"


def unit_sql(seed: str, *cols: str) -> str:
    return f"({int_sql(seed, *cols)} / 1152921504606846976.0::DOUBLE)"


def values_sql(rows, columns: str, name: str) -> str:
    """A small constant table as a CTE body."""
    body = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


# documents with labels as a track catalogue: one row per track
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    real = F.col("quality") == 1
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat("source", F.lit("_"), "doc_id", F.lit(".wav")).alias("path"),
        F.when(real, "real").otherwise("ai").alias("label"),
        F.when(real, "real").otherwise(F.col("source")).alias("generator"),
        F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"),
        "lang",
        "source",
        "text",
        "n_chars",
    )


CATALOGUE_SQL = """cat AS (
  SELECT d.doc_id, d.source || '_' || d.doc_id || '.wav' AS path,
         CASE WHEN l.quality = 1 THEN 'real' ELSE 'ai' END AS label,
         CASE WHEN l.quality = 1 THEN 'real' ELSE d.source END AS generator,
         CASE WHEN d.doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split,
         d.lang, d.source, d.text, d.n_chars
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


# documents as a catalogue of generated renditions of shared origins
def renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = F.floor(F.col("doc_id") / 20)
    return docs.select(
        "doc_id",
        F.concat("source", F.lit("_"), "doc_id", F.lit("_k"), key, F.lit(".wav")).alias("path"),
        F.col("source").alias("model"),
        F.col("text").alias("caption"),
    )


RENDITIONS_SQL = """ren AS (
  SELECT doc_id, source || '_' || doc_id || '_k' || (doc_id // 20) || '.wav' AS path,
         source AS model, text AS caption FROM documents)"""


# pages as annotated pairs of tracks; every third lacks its second side
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id")
    kind = F.element_at(
        F.array(F.lit("plag"), F.lit("plag_doubt"), F.lit("remake")), (F.col("page_id") % 3 + 1).cast("int")
    )
    return pages.select(
        F.col("page_id").alias("pair_id"),
        F.concat(F.lit("t"), F.col("page_id") % 97).alias("track_a"),
        F.when(F.col("page_id") % 7 == 0, "")
        .when(F.col("page_id") % 7 == 3, F.lit(None))
        .otherwise(F.concat(F.lit("t"), F.col("page_id") + 1))
        .alias("track_b"),
        kind.alias("similarity_label"),
    )


ANNOTATED_SQL = """ann AS (
  SELECT page_id AS pair_id, 't' || (page_id % 97) AS track_a,
         CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 7 = 3 THEN NULL
              ELSE 't' || (page_id + 1) END AS track_b,
         CASE page_id % 3 WHEN 0 THEN 'plag' WHEN 1 THEN 'plag_doubt' ELSE 'remake' END
           AS similarity_label
  FROM pages)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
