"""Streaming jobs over events and documents, files written and read back, user vectorisers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import CATALOGUE_SQL, catalogue, r6, table, with_sql
from checks.pairs import SPLIT, split_pairs
from checks.similarity import A, ARTIFACT, B, _clip_sql, _cos, tier2
from checks.windows import WINDOWS_SQL
from pairloom.functions.vectoriser import with_vectoriser
from pairloom.operators.similarity import artifact_score
from pairloom.session import shared_folder
from pairloom.sources import catalogue as files
from pairloom.sources import schemas
from pairloom.streaming import jobs

QUERIES: dict = {}
SQL: dict = {}


def scratch(spark) -> str:
    """New folder for what a query writes, on the cluster's shared storage."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return jobs.file_stream(spark, sf, schema, pattern=f"{name}.parquet")


def _csv_catalogue(spark, sf):
    path = scratch(spark)
    catalogue(spark, sf).select(
        "split", "label", F.col("path").alias("filename"), "generator"
    ).write.option("header", True).csv(path)
    return files.read_catalogue(spark, path, schemas.LABELLED_CATALOGUE)


QUERIES["a01_read_catalogue"] = _csv_catalogue
SQL["a01_read_catalogue"] = with_sql(CATALOGUE_SQL) + "SELECT path AS filename, label, generator, split FROM cat"


def _pairs_written(spark, sf):
    path = scratch(spark)
    files.write_pairs(split_pairs(spark, sf), path)
    return files.read_pairs(spark, path, "test")


QUERIES["a15_write_read_pairs"] = _pairs_written
SQL["a15_write_read_pairs"] = SPLIT + "SELECT * FROM sp WHERE split = 'test'"


def _json_written(spark, sf):
    path = scratch(spark)
    rows = catalogue(spark, sf).select("doc_id", "label", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"))
    files.write_json(rows, path)
    return spark.read.schema("doc_id long, label string, lang string").json(path)


QUERIES["a15_write_json"] = _json_written
SQL["a15_write_json"] = with_sql(CATALOGUE_SQL) + (
    "SELECT doc_id, label, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang FROM cat"
)


def _window_stream(spark, sf):
    out, state = scratch(spark), scratch(spark)
    windows = jobs.stream_window_features(
        _stream(spark, sf, "events"), "10 days", "5 days", "1 day", "user_id", "ts", "value"
    )
    jobs.write_stream(windows, out, state).awaitTermination()
    return spark.read.parquet(out).select(
        "track_id", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n",
        r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "low", "high",
    )


QUERIES["s01_stream_window_features"] = _window_stream
SQL["s01_stream_window_features"] = with_sql(WINDOWS_SQL) + """
SELECT track_id, strftime(ws, '%Y-%m-%d') AS window_start, n, mean, std, low, high FROM wf
WHERE ws + INTERVAL 10 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""


def _ingest(spark, sf):
    out = scratch(spark)
    docs = _stream(spark, sf, "documents").select(F.md5("text").alias("key"), "doc_id", "lang")
    # two runs over the same files: the second finds every key stored
    for _ in range(2):
        jobs.stream_ingest(docs, out, scratch(spark), ["key"], "doc_id", counts=f"{out}_counts").awaitTermination()
    return jobs.read_ingested(spark, out, docs.schema)


QUERIES["s02_stream_ingest"] = _ingest
SQL["s02_stream_ingest"] = """
SELECT md5(text) AS key, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text"""


def _score_stream(spark, sf):
    out, state = scratch(spark), scratch(spark)
    pairs = _stream(spark, sf, "events").select(
        "event_id", F.col("user_id").alias(A), (F.col("user_id") + 3).alias(B)
    )
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("vector"))
    arts = tier2(spark, sf).select("track_id", artifact_score(F.col("features")).alias("artifact"))
    scored = jobs.stream_score(pairs, vecs.join(arts, "track_id"))
    jobs.write_stream(scored, out, state).awaitTermination()
    return spark.read.parquet(out).select(
        "event_id", A, B, r6(F.col("attribution_score")).alias("attribution_score"), "confidence",
        "is_likely_attribution", r6(F.col("max_artifact")).alias("max_artifact"),
    )


QUERIES["s03_stream_score"] = _score_stream
SQL["s03_stream_score"] = with_sql(ARTIFACT) + f""",
p AS (SELECT event_id, user_id AS {A}, user_id + 3 AS {B}, {_clip_sql(_cos('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]'))} AS s,
    greatest(x.artifact, y.artifact) AS m
  FROM events JOIN embeddings a ON a.vec_id = user_id JOIN embeddings b ON b.vec_id = user_id + 3
  JOIN art x ON x.track_id = user_id JOIN art y ON y.track_id = user_id + 3)
SELECT event_id, {A}, {B}, round(s, 6) + 0.0 AS attribution_score,
  CASE WHEN abs(s - 0.5) > 0.25 THEN 'high' ELSE 'medium' END AS confidence, s > 0.65 AS is_likely_attribution,
  round(m, 6) + 0.0 AS max_artifact FROM p"""


def _letters():
    """Vectoriser with state: counts of a few letters per text."""
    wanted = ["a", "e", "n"]

    def run(batch):
        import pandas as pd

        lower = batch["text"].str.lower()
        return pd.DataFrame(
            {"doc_id": batch["doc_id"], "vector": list(zip(*[lower.str.count(w).astype(float) for w in wanted]))}
        )

    return run


QUERIES["u01_with_vectoriser"] = lambda spark, sf: with_vectoriser(
    table(spark, sf, "documents").select("doc_id", "text"), _letters, "doc_id long, vector array<double>"
).select("doc_id", *[F.get("vector", F.lit(i)).alias(w) for i, w in enumerate("aen")])
SQL["u01_with_vectoriser"] = "SELECT doc_id, " + ", ".join(
    f"(length(lower(text)) - length(replace(lower(text), '{w}', '')))::DOUBLE AS {w}" for w in "aen"
) + " FROM documents"
