"""Structured Streaming jobs: rolling window features, catalogue ingest, pair scoring.

The jobs return streaming DataFrames or start queries with the checkpoint folder they are
given; results go to files, never through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators import similarity as s
from pairloom.operators.windows import window_aggregates
from pairloom.sources.catalogue import path_exists

#: folders of an ingested table, and the column that names them
PARTS, PART = 64, "key_part"


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None,
    files_per_batch: int | None = None, **options: str,
) -> DataFrame:
    """New files of a folder as a stream; ``pattern`` names files or folders of files in it, as a glob."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as one alternative in braces a plain name is a glob too: Spark takes other paths for folders only
    return reader.load(f"{folder}/{{{pattern}}}" if pattern else folder)


def stream_window_features(
    stream: DataFrame, size: str, slide: str, watermark: str, track: str, time: str, value: str
) -> DataFrame:
    """Window aggregates per track; rows later than the watermark are dropped and a window
    leaves the state once the watermark passes its end."""
    stamped = stream.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", watermark)
    return (
        stamped.groupBy(F.window("_ts", size, slide).alias("_w"), F.col(track).alias("track_id"))
        .agg(*window_aggregates(F.col(value)))
        .select(
            "track_id", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
            "n", "mean", "std", "low", "high",
        )
    )


def write_stream(
    df: DataFrame, target: str, checkpoint: str, mode: str = "append", available_now: bool = True
) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(target)


def key_part(keys: Sequence[str], parts: int) -> Column:
    """The folder of a key in a table that is laid out by its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias(PART)


def read_ingested(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of an ingested table; its folders are no column."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())]))
    return reader.parquet(target).drop(PART)


def stored_keys(spark: SparkSession, target: str, schema: T.StructType, keys: Sequence[str], touched: Sequence[int]) -> DataFrame:
    """Keys of the table in the folders ``touched``: no other folder is listed or read."""
    layout = T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())])
    return spark.read.schema(layout).parquet(target).where(F.col(PART).isin(list(touched))).select(*keys)


def stream_ingest(
    stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: str,
    counts: str | None = None, available_now: bool = True, parts: int = PARTS,
) -> StreamingQuery:
    """Append rows with new keys to a Parquet table; no key is stored twice.

    Within a batch the first row per key by ``order`` stays; keys of the table are left out.
    The table itself decides, so a batch that is run again after a failure adds nothing it
    already wrote. Its rows lie in ``parts`` folders by their keys, and a batch only reads those that its own
    keys fall into. ``counts`` names a folder for (epoch, status, n) rows.
    """
    keys = list(keys)

    def ingest(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        unique = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(
            *keys, *[F.col(f"_r.{c}").alias(c) for c in rest]
        )
        held = unique.select(*batch.columns, key_part(keys, parts)).persist()
        try:
            fresh = held
            if path_exists(spark, target):
                touched = [r[PART] for r in held.select(PART).distinct().collect()]  # at most ``parts`` numbers
                stored = stored_keys(spark, target, batch.schema, keys, touched)
                same = reduce(lambda x, y: x & y, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
                fresh = held.alias("l").join(stored.alias("r"), same, "left_anti").select(*held.columns)
            added = fresh.count() if counts else 0
            fresh.write.mode("append").partitionBy(PART).parquet(target)
        finally:
            held.unpersist()
        if counts:
            report = spark.createDataFrame(
                [(epoch, "added", added), (epoch, "skipped", batch.count() - added)], "epoch long, status string, n long"
            )
            report.coalesce(1).write.mode("append").parquet(counts)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(ingest)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_score(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Arriving pairs joined with the static feature store and scored.

    ``features`` is (track_id, vector, artifact). The embedding component is the clipped
    cosine; score, confidence and decision follow as for a batch, and the artefact scores of
    both tracks come along.
    """
    joined = s.both_sides(pairs, features, ["vector", "artifact"])
    a, b = F.col("vector_a").cast("array<double>"), F.col("vector_b").cast("array<double>")
    scored = joined.withColumn("embedding", s.clip01(s.cosine(a, b))).drop("vector_a", "vector_b")
    out = s.confidence(s.attribution_score(scored))
    return out.withColumn("is_likely_attribution", s.is_attribution(F.col("attribution_score"))).withColumn(
        "max_artifact", F.greatest("artifact_a", "artifact_b")
    )
