"""Window descriptors computed from samples and from the spectrum table.

Every descriptor gives rows (track_id, chunk, slot, value). Frame-level tables are
(track_id, chunk, frame, band, value). Windows and groups are keyed by (track, window), so
none holds more than one window of samples.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators.spectrum import KEYS, array_udf, band_power, frame_rows, is_compact, power

TINY = 1e-10
TOP_DB = 80.0
# fixed values: the number of bands of each descriptor
N_MELS = 128
N_CEPSTRA = 20
N_PITCH = 12
CONTRAST_BANDS = 6
CONTRAST_LOW = 200.0
CONTRAST_SHARE = 0.02
DELTA_HALF = 4
# fixed values: scale and radius of the six tonal axes
TONAL_SCALE = (7 / 6, 7 / 6, 3 / 2, 3 / 2, 2 / 3, 2 / 3)
TONAL_RADIUS = (1.0, 1.0, 1.0, 1.0, 0.5, 0.5)
RATIOS = (2, 4, 8)


def _small(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Constant table built from a rule; a few thousand rows at most."""
    return F.broadcast(spark.createDataFrame(pd.DataFrame(list(rows), columns=list(columns))))


def pool_mean_std(frames: DataFrame, bands: int) -> DataFrame:
    """All means, then all population deviations, over the frames of a window."""
    stats = frames.groupBy(*KEYS, "band").agg(
        F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")
    )
    return stats.select(
        *KEYS,
        F.explode(
            F.array(
                F.struct(F.col("band").cast("int").alias("slot"), F.col("_m").alias("value")),
                F.struct((F.col("band") + bands).cast("int").alias("slot"), F.col("_s").alias("value")),
            )
        ).alias("_r"),
    ).select(*KEYS, "_r.slot", "_r.value")


def zero_crossing(chunks: DataFrame, w: int, n: int, hop: int) -> DataFrame:
    """Share of sign changes per frame; beyond the window's ends the edge sample repeats."""
    order = Window.partitionBy(*KEYS, "frame").orderBy("j")
    change = (F.col("value") < 0) != (F.lag("value").over(order) < 0)
    marked = frame_rows(chunks, w, n, hop).withColumn("_c", F.coalesce(change.cast("int"), F.lit(0)))
    return marked.groupBy(*KEYS, "frame").agg((F.sum("_c") / F.lit(n)).alias("value")).withColumn("band", F.lit(0))


def rms(chunks: DataFrame, w: int, n: int, hop: int) -> DataFrame:
    energy = F.sum(F.col("value") * F.col("value")) / F.lit(n)
    return (
        frame_rows(chunks, w, n, hop)
        .groupBy(*KEYS, "frame")
        .agg(F.sqrt(energy).alias("value"))
        .withColumn("band", F.lit(0))
    )


def mel_table(n: int, sr: int, bands: int = N_MELS) -> list[tuple[int, int, float]]:
    """(bin, band, weight) of triangular filters at equal mel steps; a filter that meets no
    bin keeps one row of weight 0 so that its band exists."""
    mel = lambda f: 2595.0 * math.log10(1.0 + f / 700.0)
    hz = lambda m: 700.0 * (10.0 ** (m / 2595.0) - 1.0)
    top = mel(sr / 2)
    edges = [hz(top * i / (bands + 1)) for i in range(bands + 2)]
    rows = []
    for band in range(bands):
        lo, mid, hi = edges[band : band + 3]
        found = False
        for k in range(n // 2 + 1):
            f = k * sr / n
            weight = min((f - lo) / (mid - lo), (hi - f) / (hi - mid))
            if weight > 0:
                rows.append((k, band, weight))
                found = True
        if not found:
            rows.append((0, band, 0.0))
    return rows


def mel_bands(spec: DataFrame, n: int, sr: int, bands: int = N_MELS) -> DataFrame:
    """Band power in dB, floored 80 dB below the window's maximum."""
    summed = band_power(spec, mel_table(n, sr, bands), n)
    return _floored(summed.withColumn("value", decibel(F.col("value"))), ["value"])


def decibel(x: Column) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(x, F.lit(TINY)))


def _floored(frames: DataFrame, cols: Sequence[str]) -> DataFrame:
    over = Window.partitionBy(*KEYS)
    for c in cols:
        frames = frames.withColumn(c, F.greatest(F.col(c), F.max(c).over(over) - TOP_DB))
    return frames


def cepstrum(mel: DataFrame, bands: int = N_MELS, coefs: int = N_CEPSTRA) -> DataFrame:
    """Orthonormal cosine transform over the bands: one matrix product per batch of frames."""
    band, coef = np.meshgrid(np.arange(bands), np.arange(coefs), indexing="ij")
    matrix = np.cos(math.pi / bands * (band + 0.5) * coef) * math.sqrt(2.0 / bands)
    matrix[:, 0] *= math.sqrt(0.5)
    packed = mel.groupBy(*KEYS, "frame").agg(
        F.array_sort(F.collect_list(F.struct("band", "value"))).getField("value").alias("_m")
    )
    return packed.select(*KEYS, "frame", array_udf(lambda m: m @ matrix)("_m").alias("_c")).select(
        *KEYS, "frame", F.posexplode("_c").alias("band", "value")
    )


def _fit(order: int, half: int) -> Column:
    """Least-squares slope (order 1) or second derivative (order 2) over 2·half+1 frames."""
    offsets = range(-half, half + 1)
    if order == 1:
        weights = {j: j / sum(k * k for k in offsets) for j in offsets if j}
    else:
        mean = sum(k * k for k in offsets) / len(offsets)
        spread = sum((k * k - mean) ** 2 for k in offsets)
        weights = {j: 2.0 * (j * j - mean) / spread for j in offsets}
    over = Window.partitionBy(*KEYS, "band").orderBy("frame")
    terms = [F.lit(w) * (F.lead("value", j) if j > 0 else F.lag("value", -j)).over(over) for j, w in weights.items()]
    return reduce(lambda a, b: a + b, terms)


def cepstrum_features(
    mel: DataFrame, count: int, bands: int = N_MELS, coefs: int = N_CEPSTRA, half: int = DELTA_HALF
) -> DataFrame:
    """Pooled coefficients, first and second deltas, in one pass over the coefficients.

    Near the ends the fit of the first or last full span holds, so its frame counts half+1
    times. With fewer frames than a span the deltas are zero.
    """
    rows = cepstrum(mel, bands, coefs)
    inner = F.col("frame").between(half, count - 1 - half)
    ends = (F.col("frame") == half).cast("int") + (F.col("frame") == count - 1 - half).cast("int")
    enough = count >= 2 * half + 1
    rows = rows.withColumn("_w", F.when(inner, F.lit(1) + F.lit(half) * ends).otherwise(F.lit(0)))
    for order in (1, 2):
        fitted = _fit(order, half) if enough else F.lit(0.0)
        rows = rows.withColumn(f"_d{order}", F.when(inner, fitted).otherwise(F.lit(0.0)))
    total = F.greatest(F.sum("_w"), F.lit(1))
    stats = [F.avg("value").alias("_m0"), F.stddev_pop("value").alias("_s0")]
    for order in (1, 2):
        v = F.col(f"_d{order}")
        mean = F.sum(F.col("_w") * v) / total
        square = F.sum(F.col("_w") * v * v) / total
        stats += [mean.alias(f"_m{order}"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias(f"_s{order}")]
    pooled = rows.groupBy(*KEYS, "band").agg(*stats)
    slots = [
        F.struct((F.col("band") + at * coefs).cast("int").alias("slot"), F.col(c).alias("value"))
        for at, c in enumerate(("_m0", "_s0", "_m1", "_s1", "_m2", "_s2"))
    ]
    return pooled.select(*KEYS, F.explode(F.array(*slots)).alias("_r")).select(*KEYS, "_r.slot", "_r.value")


def pitch_table(n: int, sr: int) -> list[tuple[int, int, float]]:
    """(bin, pitch class, weight): a bell around each bin's pitch, as wide as its distance to the next bin, at least a semitone.

    A bin's weights have length 1 and fall off around the fifth octave; class 0 is C.
    """
    pitch = lambda k: N_PITCH * math.log2(k * sr / n / (440.0 / 16))
    rows = []
    for k in range(n // 2 + 1):
        at = pitch(k) if k else pitch(1) - 1.5 * N_PITCH
        width = max(pitch(k + 1) - at, 1.0)
        apart = [(at - c + 10.5 * N_PITCH) % N_PITCH - N_PITCH / 2 for c in range(N_PITCH)]
        bell = [math.exp(-0.5 * (2.0 * x / width) ** 2) for x in apart]
        length = math.sqrt(sum(x * x for x in bell))
        octave = math.exp(-0.5 * ((at / N_PITCH - 5.0) / 2.0) ** 2)
        rows += [(k, (c - 3) % N_PITCH, x / length * octave) for c, x in enumerate(bell)]
    return rows


def chroma(spec: DataFrame, n: int, sr: int) -> DataFrame:
    """Power per pitch class, each frame scaled by its maximum (silent frames stay zero)."""
    summed = band_power(spec, pitch_table(n, sr), n)
    top = F.max("value").over(Window.partitionBy(*KEYS, "frame"))
    return summed.withColumn("value", F.when(top > 0, F.col("value") / top).otherwise(F.lit(0.0)))


def contrast_table(n: int, sr: int, bands: int = CONTRAST_BANDS) -> list[tuple[int, int, int, int]]:
    """(bin, band, bins in band, k): octave bands from 200 Hz, each with the bin just below."""
    edges = [0.0] + [CONTRAST_LOW * 2.0**i for i in range(bands)] + [sr / 2 + 1.0]
    rows = []
    for band in range(bands + 1):
        members = [k for k in range(n // 2 + 1) if edges[band] <= k * sr / n < edges[band + 1]]
        below = [k for k in range(n // 2 + 1) if k * sr / n < edges[band]]
        if band and below:
            members = [below[-1], *members]
        k = max(1, round(CONTRAST_SHARE * len(members)))
        rows += [(m, band, len(members), k) for m in members]
    return rows


def spectral_contrast(spec: DataFrame, n: int, sr: int, bands: int = CONTRAST_BANDS) -> DataFrame:
    """Mean of the strongest minus mean of the weakest share of bins per band, in dB."""
    table = _small(spec.sparkSession, contrast_table(n, sr, bands), ["bin", "band", "size", "k"])
    order = Window.partitionBy(*KEYS, "frame", "band").orderBy("mag", "bin")
    ranked = power(spec).join(table, "bin").withColumn("_r", F.row_number().over(order))
    ends = ranked.groupBy(*KEYS, "frame", "band").agg(
        F.avg(F.when(F.col("_r") > F.col("size") - F.col("k"), F.col("mag"))).alias("_hi"),
        F.avg(F.when(F.col("_r") <= F.col("k"), F.col("mag"))).alias("_lo"),
    )
    in_db = ends.withColumn("_hi", decibel(F.col("_hi"))).withColumn("_lo", decibel(F.col("_lo")))
    return _floored(in_db, ["_hi", "_lo"]).withColumn("value", F.col("_hi") - F.col("_lo")).drop("_hi", "_lo")


def tonal_table() -> list[tuple[int, int, float]]:
    """(pitch class, axis, weight): circles of fifths, minor and major thirds."""
    rows = []
    for axis, (scale, radius) in enumerate(zip(TONAL_SCALE, TONAL_RADIUS)):
        shift = 0.5 if axis % 2 == 0 else 0.0
        for c in range(N_PITCH):
            rows.append((c, axis, radius * math.cos(math.pi * (scale * c - shift))))
    return rows


def tonal_centroid(chroma_frames: DataFrame) -> DataFrame:
    table = _small(chroma_frames.sparkSession, tonal_table(), ["band", "axis", "w"])
    total = F.sum(F.abs("value"))
    return (
        chroma_frames.join(table, "band").groupBy(*KEYS, "frame", "axis")
        .agg(F.when(total > 0, F.sum(F.col("w") * F.col("value")) / total).otherwise(F.lit(0.0)).alias("value"))
        .withColumnRenamed("axis", "band")
    )


def wrap(x: Column) -> Column:
    """Angle in [-pi, pi)."""
    turn = F.lit(2.0 * math.pi)
    return x - turn * F.floor((x + F.lit(math.pi)) / turn)


def phase_summary(spec: DataFrame, count: int) -> DataFrame:
    """Continuity index, then mean and deviation of: phase spread per bin, instantaneous
    frequency spread per bin, group delay spread per frame."""
    if count < 3:
        return _constant_slots(spec, 7)
    along = Window.partitionBy(*KEYS, "bin").orderBy("frame")
    across = Window.partitionBy(*KEYS, "frame").orderBy("bin")
    ph = spec.select(*KEYS, "frame", "bin", F.atan2("im", "re").alias("ph"))
    steps = (
        ph.withColumn("gd", wrap(F.lag("ph").over(across) - F.col("ph")))
        .withColumn("step", wrap(F.col("ph") - F.lag("ph").over(along)))
        .withColumn("dev", F.abs(wrap(F.abs(F.col("step") - F.lag("step").over(along)))))
    )
    by_bin = (
        steps.groupBy(*KEYS, "bin")
        .agg(
            F.stddev_pop("ph").alias("_ph"), F.stddev_pop("step").alias("_st"),
            F.sum("dev").alias("_dev"), F.count("dev").alias("_n"),
        )
        .groupBy(*KEYS)
        .agg(
            (F.sum("_dev") / F.sum("_n")).alias("s0"),
            F.avg("_ph").alias("s1"), F.stddev_pop("_ph").alias("s2"),
            F.avg("_st").alias("s3"), F.stddev_pop("_st").alias("s4"),
        )
    )
    by_frame = (
        steps.groupBy(*KEYS, "frame").agg(F.stddev_pop("gd").alias("_gd"))
        .groupBy(*KEYS).agg(F.avg("_gd").alias("s5"), F.stddev_pop("_gd").alias("s6"))
    )
    row = by_bin.join(by_frame, list(KEYS))
    return _slots(row, [F.col(f"s{i}") for i in range(7)])


def _slots(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    return df.select(*KEYS, F.posexplode(F.array(*values)).alias("slot", "value"))


def _constant_slots(df: DataFrame, size: int) -> DataFrame:
    return _slots(df.select(*KEYS).distinct(), [F.lit(0.0)] * size)


def hnr_slot(chunks: DataFrame) -> DataFrame:
    """Harmonics-to-noise slot of the fast mode, constant 0."""
    return _constant_slots(chunks, 1)


def flatness(spec: DataFrame) -> DataFrame:
    p = F.greatest(F.col("p"), F.lit(TINY))
    return (
        power(spec).groupBy(*KEYS, "frame")
        .agg((F.exp(F.avg(F.log(p))) / F.avg(p)).alias("value"))
        .withColumn("band", F.lit(0))
    )


def rolloff_ratio(spec: DataFrame, n: int, sr: int) -> DataFrame:
    """Mean frequency below which 85 % of the magnitude lies over the same for 95 %."""
    frame = Window.partitionBy(*KEYS, "frame")
    run = F.sum("mag").over(frame.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cumulated = power(spec).withColumn("_c", run).withColumn("_t", F.sum("mag").over(frame))
    first = lambda share: F.min(F.when(F.col("_c") >= share * F.col("_t"), F.col("bin")))
    per_frame = cumulated.groupBy(*KEYS, "frame").agg(first(0.85).alias("_a"), first(0.95).alias("_b"))
    scale = float(sr) / n
    a, b = F.avg(F.col("_a") * scale), F.avg(F.col("_b") * scale)
    ratio = F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return per_frame.groupBy(*KEYS).agg(ratio.alias("value")).select(*KEYS, F.lit(0).alias("slot"), "value")


def ssm_novelty(chroma_frames: DataFrame, count: int) -> DataFrame:
    """Mean checkerboard novelty along the diagonal of the self-similarity matrix.

    The kernel's signs factor into sign(d)·sign(e), so the sum over the kernel at frame t is
    the squared length of (next k frames − previous k frames): two sliding sums per pitch
    class, no matrix.
    """
    k = min(8, count // 2)
    if count < 4 or k < 2:
        return _constant_slots(chroma_frames, 1)
    order = Window.partitionBy(*KEYS, "band").orderBy("frame")
    ahead = F.sum("value").over(order.rowsBetween(0, k - 1))
    behind = F.coalesce(F.sum("value").over(order.rowsBetween(-k, -1)), F.lit(0.0))
    diff = chroma_frames.withColumn("_d", ahead - behind)
    per_frame = diff.groupBy(*KEYS, "frame").agg(F.sum(F.col("_d") * F.col("_d")).alias("_v"))
    return (
        per_frame.groupBy(*KEYS).agg(F.avg(F.greatest("_v", F.lit(0.0))).alias("value"))
        .select(*KEYS, F.lit(0).alias("slot"), "value")
    )


def second_spectrum(spec: DataFrame, n: int) -> DataFrame:
    """Magnitude of a transform over the bins of each frame, averaged over frames, as one
    array per window (about n/4 values). Takes either form of the spectrum."""
    bins = n // 2 + 1
    if is_compact(spec):
        transform = array_udf(lambda re, im: np.abs(np.fft.rfft(np.hypot(re, im), axis=1)))
        sized = spec.select(*KEYS, "frame", transform("re", "im").alias("_a"))
        size = sized.select(*KEYS, "frame", F.posexplode("_a").alias("q", "size"))
    else:
        rows = [
            (k, q, math.cos(2.0 * math.pi * k * q / bins), math.sin(2.0 * math.pi * k * q / bins))
            for k in range(bins)
            for q in range(bins // 2 + 1)
        ]
        table = _small(spec.sparkSession, rows, ["bin", "q", "c", "s"])
        sums = (
            power(spec).join(table, "bin").groupBy(*KEYS, "frame", "q")
            .agg(F.sum(F.col("mag") * F.col("c")).alias("_c"), F.sum(F.col("mag") * F.col("s")).alias("_s"))
        )
        size = sums.withColumn("size", F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")))
    averaged = size.groupBy(*KEYS, "q").agg(F.avg("size").alias("a"))
    ordered = F.array_sort(F.collect_list(F.struct("q", "a"))).getField("a")
    return averaged.groupBy(*KEYS).agg(ordered.alias("a"))


def peak_regularity(values: Column, threshold: Column) -> Column:
    """1 / (1 + deviation / mean) of the distances between values above the threshold; 0 for
    two peaks or fewer.

    One fold over the array; the threshold sits in its start value, so it is computed once
    and not once per element.
    """
    zero = F.struct(
        threshold.cast("double").alias("t"), F.lit(0).alias("i"), F.lit(-1).alias("last"),
        F.lit(0).alias("n"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"),
    )

    def merge(acc: Column, v: Column) -> Column:
        hit = v > acc["t"]
        step = F.when(hit & (acc["n"] > 0), (acc["i"] - acc["last"]).cast("double")).otherwise(F.lit(0.0))
        return F.struct(
            acc["t"].alias("t"),
            (acc["i"] + 1).alias("i"),
            F.when(hit, acc["i"]).otherwise(acc["last"]).alias("last"),
            (acc["n"] + hit.cast("int")).alias("n"),
            (acc["s1"] + step).alias("s1"),
            (acc["s2"] + step * step).alias("s2"),
        )

    def finish(acc: Column) -> Column:
        gaps = acc["n"] - 1
        mean = acc["s1"] / gaps
        spread = F.sqrt(F.greatest(acc["s2"] / gaps - mean * mean, F.lit(0.0)))
        return F.when(acc["n"] > 2, F.lit(1.0) / (F.lit(1.0) + spread / (mean + F.lit(1e-8)))).otherwise(F.lit(0.0))

    return F.aggregate(values, zero, merge, finish)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def array_mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, array_sum(x) / F.size(x))


def array_median(x: Column) -> Column:
    ordered, size = F.array_sort(x), F.size(x)
    low = F.get(ordered, F.floor((size - 1) / F.lit(2)).cast("int"))
    high = F.get(ordered, F.floor(size / F.lit(2)).cast("int"))
    return (low + high) / F.lit(2.0)


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fourier_artifacts(spec: DataFrame, n: int, count: int) -> DataFrame:
    """Ten numbers from the second spectrum: (peak/background, peaks) at 1/2, 1/4 and 1/8,
    regularity, largest peak, periodicity, share of energy at the three places."""
    m = (n // 2 + 1) // 2 + 1
    if count < 2 or m < 10:
        return _constant_slots(spec, 10)
    rows = second_spectrum(spec, n).withColumn("tail", F.slice("a", 2, m - 1))
    rows = rows.withColumn("bg", F.greatest(array_median(F.col("tail")), F.lit(TINY)))
    mean = array_mean(F.col("tail"))
    # the mean enters as an argument array, not inside the lambda, so it is computed once
    centred = F.zip_with("tail", F.array_repeat(mean, m - 1), lambda v, mu: v - mu)
    rows = rows.withColumn("x", centred)
    # autocorrelation by lag, scaled by lag 0
    lagged = F.transform(
        F.sequence(F.lit(0), F.lit(m - 2)),
        lambda lag: array_sum(
            F.zip_with(
                F.slice("x", F.lit(1), F.lit(m - 1) - lag),
                F.slice("x", lag + 1, F.lit(m - 1) - lag),
                lambda a, b: a * b,
            )
        ),
    )
    rows = rows.withColumn("ac", lagged)
    scale = F.array_repeat(F.element_at("ac", 1) + F.lit(TINY), m - 1)
    rows = rows.withColumn("ac", F.zip_with("ac", scale, lambda v, top: v / top))
    ac, bg = F.col("ac"), F.col("bg")
    slots: list[Column] = []
    energy: list[Column] = []
    for ratio in RATIOS:
        target = m // ratio
        reach = max(1, m // (ratio * 10))
        lo, hi = max(1, target - reach), min(m - 1, target + reach)
        region = F.slice("a", lo + 1, hi - lo + 1)
        slots.append(_clip(F.array_max(region) / bg / F.lit(20.0)))
        slots.append(_clip(F.size(F.filter(region, lambda v: v > bg * F.lit(3.0))) / F.lit(10.0)))
        first, last = max(1, target - 1), min(m, target + 2)
        energy.append(F.slice("a", first + 1, last - first))
    slots.append(peak_regularity(F.col("tail"), bg * F.lit(2.5)))
    slots.append(_clip(F.array_max("tail") / bg / F.lit(30.0)))
    inner = F.filter(
        F.sequence(F.lit(1), F.lit(m - 3)),
        lambda i: (F.get(ac, i) > F.get(ac, i - 1)) & (F.get(ac, i) > F.get(ac, i + 1)),
    )
    best = F.coalesce(F.array_max(F.transform(inner, lambda i: F.get(ac, i))), F.lit(0.0))
    spread = F.sqrt(array_mean(F.transform("x", lambda v: v * v)))
    slots.append(F.when(spread > TINY, _clip(best)).otherwise(F.lit(0.0)))
    squares = lambda x: array_sum(F.transform(x, lambda v: v * v))
    slots.append(_clip(squares(F.concat(*energy)) / (squares(F.col("tail")) + F.lit(TINY))))
    return _slots(rows, slots)


def place(*parts: tuple[DataFrame, int]) -> DataFrame:
    """Descriptors one after another: each part's slots are shifted by the sizes before it."""
    shifted, offset = [], 0
    for df, size in parts:
        shifted.append(df.select(*KEYS, (F.col("slot") + offset).cast("int").alias("slot"), "value"))
        offset += size
    return reduce(lambda a, b: a.unionByName(b), shifted)


def assemble(slots: DataFrame, size: int) -> DataFrame:
    """One array per window; a window with any other number of slots is an error."""
    ordered = F.array_sort(F.collect_list(F.struct("slot", "value"))).getField("value")
    out = slots.groupBy(*KEYS).agg(ordered.alias("features"))
    wrong = F.raise_error(F.concat(F.lit("feature length "), F.size("features").cast("string")))
    return out.withColumn("features", F.when(F.size("features") == size, F.col("features")).otherwise(wrong))
