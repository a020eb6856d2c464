"""Pair similarity dimensions and the blended attribution score.

Pair tables carry (track_a_path, track_b_path); feature tables are keyed by track_id. Every
pair operator is two equi-joins and column arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.vectors import clip01, cosine, dot, norm, to_double
from pairloom.session import bounded_batches

# fixed values: weights of the components and thresholds
WEIGHTS = {
    "melodic": 0.15, "timbral": 0.15, "structural": 0.10, "embedding": 0.15,
    "neural": 0.30, "lyrical": 0.10, "vocal": 0.05,
}
ARTIFACT_WEIGHTS = (0.15, 0.15, 0.10, 0.10, 0.50)
ATTRIBUTION_THRESHOLD = 0.65
MAX_STRUCTURE = 200
#: texts, or pairs of texts, in an Arrow batch
TEXTS_TOGETHER = 256
TINY = 1e-10
A, B = "track_a_path", "track_b_path"


def both_sides(pairs: DataFrame, features: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Pairs with the features of both tracks as ``col_a`` and ``col_b``."""
    a = features.select(F.col("track_id").alias(A), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = features.select(F.col("track_id").alias(B), *[F.col(c).alias(f"{c}_b") for c in cols])
    return pairs.join(a, A, how).join(b, B, how)


def _cosine_batch() -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if len(a) == 0:
            return pd.Series([], dtype="float64")
        x, y = np.stack(a.to_list()).astype(float), np.stack(b.to_list()).astype(float)
        size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return pd.Series(np.where(size > 0, np.einsum("ij,ij->i", x, y) / size, np.nan))

    return run


def pair_cosine(pairs: DataFrame, vectors: DataFrame, name: str = "score", path: str = "native", clip: bool = True) -> DataFrame:
    """Cosine per pair of (track_id, vector); a zero vector gives null.

    ``path`` 'native' keeps to array functions, 'arrow' multiplies batches in NumPy (whole
    batches of wide vectors; arrays must have one length and no nulls).
    """
    joined = both_sides(pairs, vectors, ["vector"])
    a, b = to_double(F.col("vector_a")), to_double(F.col("vector_b"))
    if path == "arrow":
        raw = _cosine_batch()(a, b)
        score = F.when(~F.isnan(raw), raw)
    else:
        score = cosine(a, b)
    return joined.withColumn(name, clip01(score) if clip else score).drop("vector_a", "vector_b")


def mean_frames(frames: DataFrame) -> DataFrame:
    """(track_id, vector): the mean of every band over a track's frames, NaN as 0."""
    means = frames.groupBy("track_id", "band").agg(F.avg("value").alias("m"))
    clean = F.when(F.isnan("m") | F.col("m").isNull(), F.lit(0.0)).otherwise(F.col("m"))
    return means.groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct("band", clean.alias("m")))).getField("m").alias("vector")
    )


def timbral_similarity(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """Cosine of the mean frame; NaN counts as 0 and a zero vector gives 0."""
    scored = pair_cosine(pairs, mean_frames(frames), "timbral")
    return scored.withColumn("timbral", F.coalesce("timbral", F.lit(0.0)))


def embedding_similarity(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Clipped cosine per embedding kind present on both sides, and their mean.

    ``embeddings`` is (track_id, kinds map<string, array>).
    """
    flat = embeddings.select("track_id", F.explode("kinds").alias("kind", "vector"))
    a = flat.select(F.col("track_id").alias(A), "kind", F.col("vector").alias("_a"))
    b = flat.select(F.col("track_id").alias(B), "kind", F.col("vector").alias("_b"))
    scored = pairs.select(A, B).distinct().join(a, A).join(b, [B, "kind"]).withColumn(
        "_s", clip01(cosine(to_double(F.col("_a")), to_double(F.col("_b"))))
    )
    by_kind = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "_s"))))
    return scored.groupBy(A, B).agg(by_kind.alias("by_kind"), F.avg("_s").alias("embedding"))


def kind_cosines(a: Column, b: Column) -> Column:
    """Map from each kind that both maps of vectors have to its clipped cosine; null without any."""
    kinds = F.array_sort(F.array_intersect(F.map_keys(a), F.map_keys(b)))
    score = F.transform(kinds, lambda k: clip01(cosine(to_double(F.element_at(a, k)), to_double(F.element_at(b, k)))))
    return F.when(F.size(kinds) > 0, F.map_from_arrays(kinds, score))


def map_mean(values: Column) -> Column:
    """Mean of a map's values that are not null."""
    known = F.filter(F.map_values(values), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda total, v: total + v) / F.size(known))


def _counted() -> Column:
    @F.pandas_udf("struct<h: array<long>, check: array<long>, tf: array<long>>")
    def run(h: pd.Series, check: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(h, check):
            terms, tf = np.unique(np.stack([np.asarray(x, np.int64), np.asarray(y, np.int64)], 1), axis=0, return_counts=True)
            rows.append((terms[:, 0], terms[:, 1], tf))
        return pd.DataFrame(rows, columns=["h", "check", "tf"])

    return run


def packed_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(track_id, terms): the lower-case words of a whole text as sorted arrays of two hashes and the count.

    Two words count as one only if both 64-bit hashes agree. No word is a row; a text is cut and hashed in one
    expression and packed in batches of few texts, as are the pairs that are scored later.
    """
    bounded_batches(docs.sparkSession, TEXTS_TOGETHER)
    whole = docs.groupBy("track_id").agg(F.concat_ws(" ", F.collect_list(text)).alias("_t"))
    words = F.filter(F.split(F.lower("_t"), r"\s+"), lambda w: w != "")
    cut = whole.select("track_id", words.alias("_w"))
    hashes = [F.transform("_w", lambda w: F.xxhash64(w)), F.transform("_w", lambda w: F.xxhash64(F.lit(7), w))]
    # dealt by track after packing, so that both sides of a pair read one exchange
    return cut.select("track_id", _counted()(*hashes).alias("terms")).repartition("track_id")


def _text_cosine() -> Column:
    @F.pandas_udf("double")
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        for ha, ca, ta, hb, cb, tb in zip(a["h"], a["check"], a["tf"], b["h"], b["check"], b["tf"]):
            if ha is None or hb is None or not len(ha) or not len(hb):
                both_empty = (ha is None or not len(ha)) and (hb is None or not len(hb))
                out.append(None if both_empty else 0.0)
                continue
            low, high = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
            shared = 0
            for k in range(int((high - low).max(initial=0))):  # once, but for words with one first hash
                at = np.flatnonzero(low + k < high)
                same = at[np.asarray(cb)[low[at] + k] == np.asarray(ca)[at]]
                shared += int(np.asarray(ta)[same] @ np.asarray(tb)[low[same] + k])
            out.append(shared / (np.sqrt(float(np.asarray(ta) @ np.asarray(ta))) * np.sqrt(float(np.asarray(tb) @ np.asarray(tb)))))
        return pd.Series(out, dtype="float64")

    return run


def text_similarity(pairs: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Raw cosine of term counts: both texts empty -> null, exactly one -> 0; a track without text is an empty one.

    Packed terms travel to a pair once for each side and are merged there.
    """
    sides = both_sides(pairs.select(A, B).distinct(), packed_terms(docs, text), ["terms"], "left")
    return sides.select(A, B, term_cosine(F.col("terms_a"), F.col("terms_b")).alias("lyrical"))


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of packed terms; a missing side is an empty text."""
    blank = lambda c: F.coalesce(c, F.struct(*(F.array().cast("array<bigint>").alias(k) for k in ("h", "check", "tf"))))
    score = _text_cosine()(blank(a), blank(b))
    return F.when(~F.isnan(score), score)


def energy_gate(frames: DataFrame, threshold: float) -> DataFrame:
    """Activity flag per track: mean square above a threshold."""
    return frames.groupBy("track_id").agg(
        (F.avg(F.col("value") * F.col("value")) > threshold).alias("active")
    )


def gated_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Raw cosine when both sides are active and neither norm is below 1e-8, else null.

    ``vectors`` is (track_id, vector, active).
    """
    j = both_sides(pairs, vectors, ["vector", "active"])
    return j.withColumn("vocal", gated_cosine(*(F.col(c) for c in ("vector_a", "active_a", "vector_b", "active_b")))).drop(
        "vector_a", "vector_b", "active_a", "active_b"
    )


def gated_cosine(vector_a: Column, active_a: Column, vector_b: Column, active_b: Column) -> Column:
    a, b = to_double(vector_a), to_double(vector_b)
    ok = active_a & active_b & (norm(a) >= 1e-8) & (norm(b) >= 1e-8)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b)))


def _frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("track_id").agg((F.max("frame") + 1).alias("t"))


def structural_similarity(pairs: DataFrame, frames: DataFrame, limit: int = MAX_STRUCTURE) -> DataFrame:
    """Normalised cross-correlation of the two self-similarity matrices, resized bilinearly to
    min(a, b, 200), mapped to [0, 1]; fewer than two rows or a constant matrix gives 0.

    ``frames`` is (track_id, frame, band, value). Bilinear resizing acts on rows and columns
    alike, so resizing X'X equals taking Y'Y of linearly resampled frames Y, and sums over
    the products of two such matrices are squared entries of small band-by-band matrices:
    Sum((Ya'Ya)·(Yb'Yb)) = |Ya Yb'|². No frame-by-frame matrix is ever built. A row is a frame with its bands; a pair gathers
    at most 2 · ``limit`` of them for each side.
    """
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    packed = frames.groupBy("track_id", "frame").agg(
        F.collect_list(F.struct(F.col("band").cast("int").alias("band"), value.alias("x"))).alias("x"), F.max(F.abs(value)).alias("_top")
    )
    sized = both_sides(pairs.select(A, B).distinct(), _frame_counts(frames), ["t"], "left")
    # a track without frames has none to compare
    sized = sized.withColumn("m", F.least(F.coalesce("t_a", F.lit(0)), F.coalesce("t_b", F.lit(0)), F.lit(limit)).cast("int"))
    usable = sized.where(F.col("m") >= 2)
    # grid point i of m reads frame i·(t−1)/(m−1) between its two neighbours
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.col(track).alias("track_id"), F.col(t).alias("t")) for k, track, t in ((0, A, "t_a"), (1, B, "t_b"))))
    grid = usable.select(A, B, "m", F.explode(sides).alias("_s")).select(A, B, "m", "_s.*", F.explode(F.expr("sequence(0, m - 1)")).alias("i"))
    grid = grid.withColumn("_at", F.col("i") * (F.col("t") - 1) / (F.col("m") - 1))
    low, rest = F.floor("_at"), F.col("_at") - F.floor("_at")
    near = grid.withColumn("_n", F.explode(F.array(F.struct(low.alias("frame"), (F.lit(1.0) - rest).alias("w")), F.struct((low + 1).alias("frame"), rest.alias("w")))))
    near = near.select(A, B, "m", "side", "track_id", "i", "_n.frame", "_n.w").where(F.col("w") > 0)
    scaled = F.when(F.col("_top") > 0, F.col("w") / F.col("_top")).otherwise(F.lit(0.0))
    point = F.struct("side", "i", scaled.alias("w"), F.col("x.band").alias("band"), F.col("x.x").alias("x"))
    gathered = near.join(packed, ["track_id", "frame"]).groupBy(A, B, "m").agg(F.collect_list(point).alias("_p"))
    types = dict(pairs.dtypes)
    done = gathered.mapInArrow(_structures, f"{A} {types[A]}, {B} {types[B]}, structural double")
    return sized.select(A, B).join(done, [A, B], "left").withColumn(
        "structural", F.coalesce("structural", F.lit(0.0))
    )


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ends, points = batch.column(2).to_pylist(), batch.column(3).offsets.to_pylist(), batch.column(3).values
        side, at, w, lists = (points.field(k) for k in ("side", "i", "w", "band"))
        side, at, w = (c.to_numpy(zero_copy_only=False) for c in (side, at, w))
        inside, bands = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        values, begun = points.field("x").values.to_numpy(zero_copy_only=False), points.field("x").offsets.to_numpy()
        scores = []
        for m, a, b in zip(sizes, ends[:-1], ends[1:]):
            here = np.repeat(np.arange(a, b), np.diff(inside[a : b + 1]))
            band = bands[inside[a] : inside[b]]
            y = np.zeros((2, m, int(band.max(initial=0)) + 1))
            np.add.at(y, (side[here], at[here], band), w[here] * values[begun[a] : begun[b]])
            scores.append(_structure(*y))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], [A, B, "structural"])


def _structure(ya: np.ndarray, yb: np.ndarray) -> float:
    """Correlation of Ya'Ya and Yb'Yb, mapped to [0, 1]; 0 for a constant matrix."""
    ab, aa, bb = (float(((x.T @ y) ** 2).sum()) for x, y in ((ya, yb), (ya, ya), (yb, yb)))
    sum_a, sum_b = (float((y.sum(0) ** 2).sum()) for y in (ya, yb))
    cells = float(len(ya)) ** 2
    var_a, var_b = aa - sum_a * sum_a / cells, bb - sum_b * sum_b / cells
    # rounding leaves a constant matrix slightly off zero
    if var_a <= aa * 1e-12 or var_b <= bb * 1e-12:
        return 0.0
    return min(1.0, max(0.0, ((ab - sum_a * sum_b / cells) / np.sqrt(var_a * var_b) + 1) / 2))


def frame_arrays(frames: DataFrame) -> DataFrame:
    """(track_id, frames array<array>, t): unit-length frames in order; a zero frame becomes
    1e-10 in every band first."""
    packed = frames.groupBy("track_id", "frame").agg(
        F.array_sort(F.collect_list(F.struct("band", "value"))).getField("value").alias("x")
    )
    zero = norm(F.col("x")) < TINY
    safe = packed.withColumn("x", F.when(zero, F.transform("x", lambda _: F.lit(TINY))).otherwise(F.col("x")))
    length = safe.withColumn("_l", norm(F.col("x")))
    unit = length.withColumn("x", F.zip_with("x", F.array_repeat("_l", F.size("x")), lambda v, s: v / s))
    return unit.groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct("frame", "x"))).getField("x").alias("frames"),
        F.count(F.lit(1)).alias("t"),
    )


def _alignment_cost(a: Column, b: Column) -> Column:
    """Last cell of the warping matrix with steps right, down and diagonal, cosine cost.

    The outer fold carries the previous row; the inner fold builds the next one.
    """
    inf = F.lit(float("inf"))

    def row(previous: Column, corner: Column, x: Column) -> Column:
        start = F.struct(F.array().cast("array<double>").alias("row"), F.lit(0).alias("j"), inf.alias("left"))

        def cell(acc: Column, y: Column) -> Column:
            diagonal = F.when(acc["j"] == 0, corner).otherwise(F.get(previous, acc["j"] - 1))
            best = F.least(diagonal, F.get(previous, acc["j"]), acc["left"])
            d = best + (F.lit(1.0) - dot(x, y))
            return F.struct(
                F.concat(acc["row"], F.array(d)).alias("row"), (acc["j"] + 1).alias("j"), d.alias("left")
            )

        return F.aggregate(b, start, cell, lambda acc: acc["row"])

    first = F.struct(F.array_repeat(inf, F.size(b)).alias("row"), F.lit(0.0).alias("corner"))
    folded = F.aggregate(
        a, first, lambda acc, x: F.struct(row(acc["row"], acc["corner"], x).alias("row"), inf.alias("corner"))
    )
    return F.element_at(folded["row"], -1)


def _alignment_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The same cost for long sequences, along anti-diagonals (two are kept)."""
    for left, right in batches:
        out = []
        for fa, fb in zip(left, right):
            if fa is None or fb is None:
                out.append(0.0)
                continue
            x, y = np.stack([np.asarray(v) for v in fa]), np.stack([np.asarray(v) for v in fb])
            n, m = len(x), len(y)
            before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
            before[0] = 0.0
            for s in range(n + m - 1):
                i = np.arange(max(0, s - m + 1), min(n, s + 1))
                cost = 1.0 - np.einsum("ij,ij->i", x[i], y[s - i])
                now = np.full(n + 1, np.inf)
                now[i + 1] = cost + np.minimum(np.minimum(last[i], last[i + 1]), before[i])
                before, last = last, now
            out.append(float(last[n]))
        yield pd.Series(out)


def melodic_similarity(pairs: DataFrame, frames: DataFrame, path: str = "arrow") -> DataFrame:
    """Warped alignment of two frame sequences: 1 − cost / (n + m), clipped; fewer than two
    frames on a side gives 0.

    Sequences of all lengths are aligned in Arrow batches; ``path`` 'fold' names the same alignment as
    a fold inside the plan.
    """
    joined = both_sides(pairs.select(A, B).distinct(), frame_arrays(frames), ["frames", "t"], "left")
    short = (F.coalesce("t_a", F.lit(0)) < 2) | (F.coalesce("t_b", F.lit(0)) < 2)
    cost_fold = _alignment_cost(F.col("frames_a"), F.col("frames_b"))
    arrow = F.pandas_udf(_alignment_batches, "double")(F.col("frames_a"), F.col("frames_b"))

    def scored(df: DataFrame, cost: Column) -> DataFrame:
        value = clip01(F.lit(1.0) - F.col("_cost") / (F.col("t_a") + F.col("t_b")))
        out = df.withColumn("_cost", cost)
        return out.select(A, B, F.when(short, F.lit(0.0)).otherwise(value).alias("melodic"))

    return scored(joined, cost_fold if path == "fold" else arrow)


def artifact_score(vec: Column) -> Column:
    """Weighted sum of five clipped sub-scores of a 22-number tier-2 vector."""
    at = lambda i: F.element_at(vec, i + 1)
    fourier = reduce(lambda x, y: x + y, [at(i) for i in range(12, 22)]) / 10
    parts = (
        clip01((at(0) - 1.0) / 1.5),
        clip01(F.lit(1.0) - at(7) / 20.0),
        clip01(at(8) * 5.0),
        clip01(F.abs(at(10) - 0.87) / 0.3),
        fourier,
    )
    return clip01(reduce(lambda x, y: x + y, [F.lit(w) * p for w, p in zip(ARTIFACT_WEIGHTS, parts)]))


def _components(df: DataFrame, weights: dict[str, float]) -> dict[str, float]:
    return {k: w for k, w in weights.items() if k in df.columns}


def attribution_score(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of the component columns that are not null, weights re-normalised."""
    used = _components(df, weights or WEIGHTS)
    total = reduce(lambda x, y: x + y, [F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in used.items()])
    blended = reduce(lambda x, y: x + y, [F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in used.items()])
    return df.withColumn("attribution_score", F.when(total > 0, blended / total))


def component_std(df: DataFrame, weights: dict[str, float] | None = None) -> Column:
    """Population deviation of the components that are not null (0 for one)."""
    cols = [F.col(k).cast("double") for k in _components(df, weights or WEIGHTS)]
    count = reduce(lambda x, y: x + y, [c.isNotNull().cast("int") for c in cols])
    mean = reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0.0)) for c in cols]) / count
    spread = reduce(lambda x, y: x + y, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols])
    return F.when(count > 1, F.sqrt(spread / count)).otherwise(F.lit(0.0))


def confidence(df: DataFrame) -> DataFrame:
    """high / medium / low from the distance to 0.5 and the agreement of the components."""
    out = df.withColumn("component_std", component_std(df))
    far = F.abs(F.col("attribution_score") - 0.5)
    label = (
        F.when((far > 0.25) & (F.col("component_std") < 0.15), "high")
        .when((far > 0.12) | (F.col("component_std") < 0.20), "medium")
        .otherwise("low")
    )
    return out.withColumn("confidence", label)


def is_attribution(score: Column, threshold: float = ATTRIBUTION_THRESHOLD) -> Column:
    return score > threshold


def fast_screen(pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Screening by the larger of the two artefact scores; no other table is read.

    ``artifacts`` is (track_id, artifact).
    """
    out = both_sides(pairs, artifacts, ["artifact"])
    score = F.greatest("artifact_a", "artifact_b")
    label = F.when(score > 0.8, "high").when(score > 0.5, "medium").otherwise("low")
    return (
        out.withColumn("attribution_score", score)
        .withColumn("is_likely_attribution", is_attribution(score))
        .withColumn("confidence", label)
        .withColumn("mode", F.lit("fast"))
    )


def result_struct(df: DataFrame, mode: str = "standard") -> DataFrame:
    """Nested result record and its JSON text for scored pairs.

    Expects attribution_score, component_std, confidence, artifact_a, artifact_b and the
    component columns that were computed. With a ``by_kind`` column the record holds the scores of
    all embedding kinds as a map, their mean stays among the component scores.
    """
    used = _components(df, WEIGHTS)
    total = reduce(lambda x, y: x + y, [F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in used.items()])
    present = lambda value: F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(k) for k in used]), F.array(*[value(k, w) for k, w in used.items()])),
        lambda _, v: v.isNotNull(),
    )
    similarity = lambda k: (F.col(k) if k in used else F.lit(None).cast("double"))
    kinds = "by_kind" in df.columns
    record = F.struct(
        F.col("attribution_score"),
        *[(F.col("by_kind") if k == "embedding" and kinds else similarity(k)).alias(f"{k}_similarity") for k in WEIGHTS],
        F.struct(F.col("artifact_a").alias("track_a"), F.col("artifact_b").alias("track_b")).alias("ai_artifact_score"),
        is_attribution(F.col("attribution_score")).alias("is_likely_attribution"),
        F.col("confidence"),
        F.lit(mode).alias("mode"),
        F.struct(
            present(lambda k, w: F.when(F.col(k).isNotNull(), F.lit(w) / total)).alias("weights_used"),
            present(lambda k, w: F.col(k)).alias("component_scores"),
            F.col("component_std").alias("component_agreement_std"),
            F.lit(ATTRIBUTION_THRESHOLD).alias("threshold"),
        ).alias("details"),
    )
    out = df.select(A, B, record.alias("result"))
    return out.withColumn("json", F.to_json("result", {"ignoreNullFields": "false"}))


def window_matrices(chunks: DataFrame) -> DataFrame:
    """(track_id, rows, width): the window vectors of a track behind one another, scaled to length 1 (zeros stay)."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk", to_double(F.col("vector")).alias("v")))).getField("v")
    packed = chunks.groupBy("track_id").agg(ordered.alias("_m"))
    unit = lambda v: F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(v)
    # dealt by track after packing, so that both sides of a pair read one exchange
    return packed.select("track_id", F.flatten(F.transform("_m", unit)).alias("rows"), F.size(F.col("_m")[0]).alias("width")).repartition("track_id")


def _best_matches() -> Column:
    """Mean over the windows of a of the best product with a window of b; windows of length 0 have none."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for x, y, w in zip(a, b, width):
            x, y = np.asarray(x, float).reshape(-1, w), np.asarray(y, float).reshape(-1, w)
            x, y = x[(x != 0).any(1)], y[(y != 0).any(1)]
            out.append(float((x @ y.T).max(1).mean()) if len(x) and len(y) else None)
        return pd.Series(out, dtype="float64")

    return run


def coarse_to_fine(
    pairs: DataFrame, vectors: DataFrame, chunks: DataFrame, threshold: float | None = 0.3
) -> DataFrame:
    """0.3·coarse + 0.7·fine. Coarse is the cosine of the whole vectors; fine is the mean over
    the windows of a of the best cosine with a window of b.

    Pairs under the coarse threshold are rejected before any window is read (None keeps all).
    ``chunks`` is (track_id, chunk, vector). A pair's windows are two matrices and one product: no window pair is a row.
    """
    coarse = pair_cosine(pairs.select(A, B).distinct(), vectors, "coarse", clip=False)
    if threshold is not None:
        coarse = coarse.where(F.col("coarse") >= threshold)
    both = both_sides(coarse, window_matrices(chunks), ["rows", "width"])
    best = _best_matches()("rows_a", "rows_b", "width_a")
    fine = both.select(A, B, "coarse", best.alias("_f")).withColumn("fine", F.when(~F.isnan("_f"), F.col("_f"))).drop("_f")
    return fine.withColumn("score", F.lit(0.3) * F.col("coarse") + F.lit(0.7) * F.col("fine"))


def pair_cosine_by(pairs: DataFrame, vectors: DataFrame, group: str) -> DataFrame:
    """Unclipped cosine of raw vectors, summarised per relation."""
    scored = pair_cosine(pairs, vectors, "score", clip=False)
    return scored.groupBy(group).agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("low"),
        F.max("score").alias("high"),
    )
