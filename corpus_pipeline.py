"""From raw documents to packed training sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.decontamination import contaminated_passages
from pairloom.llm.packing import pack_tracks
from pairloom.llm.queries import training_labels, tracks_of
from pairloom.llm.secrets import announced_labels, redacted, secret_candidates, secret_findings
from pairloom.llm.shingles import first_of_near_duplicates
from pairloom.llm.storage import stored
from pairloom.llm.toxicity import THRESHOLD, toxicity_scorer


def _for_rows(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """Joins (track_id, text_key) decisions to the documents that they are about, also without or with repeated ids."""
    decided = decided.select(F.col("track_id").alias("_decided_id"), F.col("text_key").alias("_decided_key"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_decided_id")) & (F.xxhash64("text") == F.col("_decided_key"))
    return docs.join(decided, same, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; empty and null texts are scored like others."""
    scorer = toxicity_scorer(tracks_of(docs), training_labels(spark, sf_dir))
    return docs.where(scorer(F.col("text")) < THRESHOLD)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id; repeated rows stay once."""
    kept = _for_rows(docs, first_of_near_duplicates(tracks_of(docs)), "left_semi")
    same = Window.partitionBy("doc_id", "text").orderBy(F.lit(0))
    return kept.withColumn("_n", F.row_number().over(same)).where("_n = 1").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = stored(contaminated_passages(tracks_of(docs), items).select("track_id", "text_key").distinct())
    return _for_rows(docs, found, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the changed texts."""
    tracks = tracks_of(docs)
    found = stored(secret_candidates(tracks))
    findings = stored(secret_findings(found, announced_labels(found)).select("track_id", "text_key", "start", "length", "is_secret").where("is_secret = 1"))
    out = redacted(docs.withColumn("_before", F.xxhash64("text")), findings, "text", "doc_id")
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.xxhash64("text") != F.col("_before"), size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return pack_tracks(tracks_of(docs)).withColumnsRenamed({"track_id": "doc_id", "track_tokens": "doc_tokens"})


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each result but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
