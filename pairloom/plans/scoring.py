"""Scoring of a pair table: only the component tables a mode needs are joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import similarity as s


@dataclass
class TrackTables:
    """Feature tables keyed by track_id; None where a modality is absent."""

    tier2: DataFrame  # track_id, features (22)
    chroma_frames: DataFrame | None = None  # track_id, frame, band, value
    cepstrum_frames: DataFrame | None = None
    embeddings: DataFrame | None = None  # track_id, kinds map
    texts: DataFrame | None = None  # track_id, text
    voices: DataFrame | None = None  # track_id, vector, active
    neural: DataFrame | None = None  # track_a_path, track_b_path, neural


def artifacts(tier2: DataFrame) -> DataFrame:
    return tier2.select("track_id", s.artifact_score(F.col("features")).alias("artifact"))


def track_table(tables: TrackTables, use_embeddings: bool = True, use_lyrics: bool = True, use_vocals: bool = True) -> tuple[DataFrame, list[str]]:
    """One row per track with all that a pair needs of it in one row, and the names of these columns.

    The parts are stacked and grouped by track: one exchange for all of them, which both sides of the pairs share.
    """
    parts: dict[str, DataFrame] = {"artifact": artifacts(tables.tier2)}
    if tables.cepstrum_frames is not None:
        parts["frame"] = s.mean_frames(tables.cepstrum_frames).withColumnRenamed("vector", "frame")
    if use_embeddings and tables.embeddings is not None:
        parts["kinds"] = tables.embeddings
    if use_lyrics and tables.texts is not None:
        parts["terms"] = s.packed_terms(tables.texts)
    if use_vocals and tables.voices is not None:
        parts["voice"] = tables.voices.select("track_id", F.struct("vector", "active").alias("voice"))
    stacked = [df.select("track_id", name) for name, df in parts.items()]
    out = stacked[0]
    for part in stacked[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    names = list(parts)
    return out.groupBy("track_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in names)), names


def score_pairs(
    pairs: DataFrame,
    tables: TrackTables,
    mode: str = "standard",
    use_embeddings: bool = True,
    use_lyrics: bool = True,
    use_vocals: bool = True,
) -> DataFrame:
    """One scored row per pair whose tracks have features; others drop out.

    'fast' reads the tier-2 table alone. A toggle that is off, or a table that is None, takes
    its component out of the plan altogether; a null component only drops its weight. What a track gives by itself
    stands in one table that is joined once for each side; only parts that need frames of both tracks are joined by pair.
    """
    if mode not in ("fast", "standard", "full"):
        raise ValueError(f"unknown mode {mode}")
    keys = pairs.select(s.A, s.B).distinct()
    if mode == "fast":
        return s.fast_screen(keys, artifacts(tables.tier2))
    side, names = track_table(tables, use_embeddings, use_lyrics, use_vocals)
    out = s.both_sides(keys, side.where("artifact is not null"), names)
    of = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    if "frame" in names:
        a, b = of("frame")
        out = out.withColumn("timbral", F.when(a.isNotNull() & b.isNotNull(), F.coalesce(s.clip01(s.cosine(a, b)), F.lit(0.0))))
    if "kinds" in names:
        out = out.withColumn("by_kind", s.kind_cosines(*of("kinds"))).withColumn("embedding", s.map_mean(F.col("by_kind")))
    if "terms" in names:
        out = out.withColumn("lyrical", s.term_cosine(*of("terms")))
    if "voice" in names:
        a, b = of("voice")
        out = out.withColumn("vocal", s.gated_cosine(a["vector"], a["active"], b["vector"], b["active"]))
    out = out.drop(*(f"{c}_{x}" for c in names if c != "artifact" for x in "ab"))
    parts: list[DataFrame] = []
    if tables.chroma_frames is not None:
        parts += [s.melodic_similarity(keys, tables.chroma_frames), s.structural_similarity(keys, tables.chroma_frames)]
    if tables.neural is not None:
        parts.append(tables.neural.select(s.A, s.B, "neural"))
    for part in parts:
        out = out.join(part, [s.A, s.B], "left")
    scored = s.confidence(s.attribution_score(out))
    return scored.withColumn(
        "is_likely_attribution", s.is_attribution(F.col("attribution_score"))
    ).withColumn("mode", F.lit(mode))
