"""Explicit schemas of catalogue, pair and vendor tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# fixed values: column names and order of the tables
LABELLED_CATALOGUE = _strings("filename", "label", "generator", "split")
CAPTION_CATALOGUE = _strings("filename", "model", "caption")
PAIR_CATALOGUE = T.StructType(
    [
        T.StructField("pair_id", T.IntegerType()),
        T.StructField("track_a", T.StringType()),
        T.StructField("track_b", T.StringType()),
        T.StructField("similarity_label", T.StringType()),
    ]
)
CAPTIONS = _strings("ytid", "caption")
VENDOR_FAKE = _strings(
    "id", "filename", "title", "duration", "algorithm", "style", "source", "lyrics_features",
    "topic", "genre", "mood", "label", "target", "split",
)
VENDOR_REAL = _strings(
    "id", "filename", "title", "artist", "year", "lyrics", "lyrics_features", "duration",
    "youtube_id", "label", "artist_overlap", "target", "skip_time", "no_vocal", "split",
)
PAIRS = T.StructType(
    [
        T.StructField("track_a_path", T.StringType()),
        T.StructField("track_b_path", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("pair_type", T.StringType()),
    ]
)
SIGNALS = T.StructType(
    [
        T.StructField("track_id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)
HEADERS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("readable", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("duration", T.DoubleType()),
    ]
)
