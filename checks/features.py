"""Window descriptors of each user's event values (windows of 64, frames of 64, hop 8); once at full size."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import r6, table, with_sql
from checks.windows import SERIES_SQL, chunks_sql, series
from pairloom.operators import descriptors as ops
from pairloom.operators import kernels
from pairloom.operators.blocks import block_table, map_windows
from pairloom.operators.ranking import depth_bounds, depth_bucket, exact_rank
from pairloom.operators.spectrum import block_mean_magnitude, frame_count, spectrum
from pairloom.operators.windows import chunk_rows
from pairloom.plans import feature_job

QUERIES: dict = {}
SQL: dict = {}

W, S, N, HOP, SR = 64, 32, 64, 8, 16000
T = frame_count(W, HOP)
BINS = N // 2 + 1
DIGITS = 5


def _chunks(spark, sf):
    return chunk_rows(series(spark, sf), W, S)


def _spec(spark, sf):
    return spectrum(_chunks(spark, sf), W, N, HOP)


def _part(name):
    """A query of one descriptor, made from blocks."""
    return lambda spark, sf: _rounded(feature_job.slot_rows(feature_job.window_parts(series(spark, sf), (name,), W, S, N, HOP, SR)))


def _rounded(df, digits=DIGITS):
    return df.withColumn("value", r6(F.col("value"), digits))


K = "track_id, chunk"
# ---- the same computations as SQL text, one group of CTEs per descriptor
FRAMES = f"""frm AS (SELECT {K}, f AS frame, i - f * {HOP} + {N // 2} AS j, value
  FROM chk, (SELECT unnest(range(0, {T})) AS f) WHERE i - f * {HOP} + {N // 2} BETWEEN 0 AND {N - 1})"""
SPEC = f"""spec0 AS (SELECT {K}, frame, bin,
    round(sum(value * h * cos(2 * pi() * j * bin / {N})), 9) + 0.0 AS re,
    round(-sum(value * h * sin(2 * pi() * j * bin / {N})), 9) + 0.0 AS im
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / {N}) AS h FROM frm),
       (SELECT unnest(range(0, {BINS})) AS bin) GROUP BY {K}, frame, bin),
spec AS (SELECT *, re * re + im * im AS p, sqrt(re * re + im * im) AS mag FROM spec0)"""
# the same over ends that reflect
REFLECTED = f"""mir AS (SELECT {K}, i, value FROM chk
  UNION ALL SELECT {K}, -i, value FROM chk WHERE i BETWEEN 1 AND {N // 2}
  UNION ALL SELECT {K}, {2 * (W - 1)} - i, value FROM chk WHERE i BETWEEN {W - 1 - N // 2} AND {W - 2}),
frr AS (SELECT {K}, f AS frame, i - f * {HOP} + {N // 2} AS j, value
  FROM mir, (SELECT unnest(range(0, {T})) AS f) WHERE i - f * {HOP} + {N // 2} BETWEEN 0 AND {N - 1}),
ref0 AS (SELECT {K}, frame, bin,
    round(sum(value * h * cos(2 * pi() * j * bin / {N})), 9) AS re, round(-sum(value * h * sin(2 * pi() * j * bin / {N})), 9) AS im
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / {N}) AS h FROM frr),
       (SELECT unnest(range(0, {BINS})) AS bin) GROUP BY {K}, frame, bin),
ref AS (SELECT *, re * re + im * im AS p FROM ref0)"""
BASE = with_sql(SERIES_SQL, chunks_sql(W, S), FRAMES)
FULL = with_sql(SERIES_SQL, chunks_sql(W, S), FRAMES, SPEC)


def pool_sql(name: str, source: str, bands: int) -> str:
    return f"""{name} AS (
  SELECT {K}, band AS slot, avg(value) AS value FROM {source} GROUP BY {K}, band
  UNION ALL SELECT {K}, band + {bands}, stddev_pop(value) FROM {source} GROUP BY {K}, band)"""


def final(name: str, digits: int = DIGITS) -> str:
    return f"\nSELECT {K}, slot, round(value, {digits}) + 0.0 AS value FROM {name}"


ZCR = f"""zc AS (SELECT {K}, frame, 0 AS band, sum(CASE WHEN (value < 0) <> (prev < 0) THEN 1 ELSE 0 END) / {N}.0::DOUBLE AS value
  FROM (SELECT *, lag(value) OVER (PARTITION BY {K}, frame ORDER BY j) AS prev FROM frm) GROUP BY {K}, frame)"""
RMS = f"rm AS (SELECT {K}, frame, 0 AS band, sqrt(sum(value * value) / {N}) AS value FROM frm GROUP BY {K}, frame)"
MEL = REFLECTED + f""",
edge AS (SELECT i, 700 * (pow(10::DOUBLE, log10(1 + 8000 / 700.0::DOUBLE) * i / 129) - 1) AS f FROM range(0, 130) t(i)),
fb AS (SELECT bin, a.i AS band,
    greatest(0.0, least((bin * 250 - a.f) / (b.f - a.f), (c.f - bin * 250) / (c.f - b.f))) AS w
  FROM (SELECT unnest(range(0, {BINS})) AS bin), edge a JOIN edge b ON b.i = a.i + 1 JOIN edge c ON c.i = a.i + 2),
mel0 AS (SELECT {K}, frame, band, 10 * log10(greatest(sum(p * w), 1e-10)) AS v FROM ref JOIN fb USING (bin) GROUP BY {K}, frame, band),
mel AS (SELECT {K}, frame, band, greatest(v, max(v) OVER (PARTITION BY {K}) - 80) AS value FROM mel0)"""
CEP = f"""dct AS (SELECT band, coef, cos(pi() / 128 * (band + 0.5) * coef) * sqrt(2.0::DOUBLE / 128)
    * CASE WHEN coef = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END AS w
  FROM (SELECT unnest(range(0, 128)) AS band), (SELECT unnest(range(0, 20)) AS coef)),
cep AS (SELECT {K}, frame, coef AS band, sum(value * w) AS value FROM mel JOIN dct USING (band) GROUP BY {K}, frame, coef),
span AS (SELECT t, least(greatest(t, 4), {T} - 5) AS mid, j FROM (SELECT unnest(range(0, {T})) AS t), (SELECT unnest(range(-4, 5)) AS j)),
dlt AS (SELECT {K}, t AS frame, band, sum(value * j) / 60 AS value,
    sum(value * 2 * (j * j - 60 / 9.0::DOUBLE)) / 308 AS value2
  FROM cep JOIN span ON cep.frame = span.mid + span.j GROUP BY {K}, t, band),
dl2 AS (SELECT {K}, frame, band, value2 AS value FROM dlt),
{pool_sql('pc0', 'cep', 20)}, {pool_sql('pc1', 'dlt', 20)}, {pool_sql('pc2', 'dl2', 20)},
pcep AS (SELECT * FROM pc0 UNION ALL SELECT {K}, slot + 40, value FROM pc1 UNION ALL SELECT {K}, slot + 80, value FROM pc2)"""
CHROMA = f"""pp AS (SELECT bin, 12 * log2(greatest(bin, 1) * 250 / (440 / 16.0::DOUBLE)) - CASE WHEN bin = 0 THEN 18 ELSE 0 END AS x
  FROM (SELECT unnest(range(0, {BINS + 1})) AS bin)),
bell AS (SELECT bin, c, x, exp(-0.5 * pow(2 * (fmod(x - c + 126, 12) - 6) / greatest(next - x, 1), 2)) AS v
  FROM (SELECT *, lead(x) OVER (ORDER BY bin) AS next FROM pp), (SELECT unnest(range(0, 12)) AS c) WHERE bin < {BINS}),
pit AS (SELECT bin, (c + 9) % 12 AS pc, v / sqrt(sum(v * v) OVER (PARTITION BY bin)) * exp(-0.5 * pow((x / 12 - 5) / 2, 2)) AS w FROM bell),
chr1 AS (SELECT {K}, frame, pc AS band, sum(p * w) AS v FROM spec JOIN pit USING (bin) GROUP BY {K}, frame, pc),
chr AS (SELECT {K}, frame, band, CASE WHEN max(v) OVER (PARTITION BY {K}, frame) > 0
    THEN v / max(v) OVER (PARTITION BY {K}, frame) ELSE 0.0 END AS value FROM chr1)"""
CONTRAST = f"""oct AS (SELECT b AS band, CASE WHEN b = 0 THEN 0 ELSE 200 * pow(2, b - 1) END AS lo,
    CASE WHEN b = 6 THEN 8001 ELSE 200 * pow(2, b) END AS hi FROM range(0, 7) t(b)),
mem AS (SELECT band, bin, count(*) OVER (PARTITION BY band) AS size FROM oct, (SELECT unnest(range(0, {BINS})) AS bin)
  WHERE (bin * 250 >= lo AND bin * 250 < hi) OR (band > 0 AND bin = CAST(ceil(lo / 250) AS BIGINT) - 1)),
rnk AS (SELECT {K}, frame, band, mag, size, greatest(1, round(0.02 * size)) AS k,
    row_number() OVER (PARTITION BY {K}, frame, band ORDER BY mag, bin) AS r FROM spec JOIN mem USING (bin)),
con0 AS (SELECT {K}, frame, band, 10 * log10(greatest(avg(mag) FILTER (r > size - k), 1e-10)) AS hi,
    10 * log10(greatest(avg(mag) FILTER (r <= k), 1e-10)) AS lo FROM rnk GROUP BY {K}, frame, band),
con AS (SELECT {K}, frame, band, greatest(hi, max(hi) OVER (PARTITION BY {K}) - 80)
    - greatest(lo, max(lo) OVER (PARTITION BY {K}) - 80) AS value FROM con0)"""
TONAL = f"""axs AS (SELECT a - 1 AS axis, c AS band, [1, 1, 1, 1, 0.5, 0.5][a]
    * cos(pi() * ([7 / 6.0::DOUBLE, 7 / 6.0::DOUBLE, 1.5, 1.5, 2 / 3.0::DOUBLE, 2 / 3.0::DOUBLE][a] * c
                  - CASE WHEN a % 2 = 1 THEN 0.5 ELSE 0 END)) AS w
  FROM range(1, 7) t(a), range(0, 12) u(c)),
ton AS (SELECT {K}, frame, axis AS band, CASE WHEN sum(abs(value)) > 0 THEN sum(w * value) / sum(abs(value)) ELSE 0.0 END AS value
  FROM chr JOIN axs USING (band) GROUP BY {K}, frame, axis)"""
PHASE = f"""ph AS (SELECT {K}, frame, bin, atan2(im, re) AS ph FROM spec),
ph1 AS (SELECT *, lag(ph) OVER (PARTITION BY {K}, frame ORDER BY bin) - ph AS g0,
    ph - lag(ph) OVER (PARTITION BY {K}, bin ORDER BY frame) AS s0 FROM ph),
ph2 AS (SELECT *, g0 - 2 * pi() * floor((g0 + pi()) / (2 * pi())) AS gd,
    s0 - 2 * pi() * floor((s0 + pi()) / (2 * pi())) AS step FROM ph1),
ph3 AS (SELECT *, abs(step - lag(step) OVER (PARTITION BY {K}, bin ORDER BY frame)) AS d0 FROM ph2),
ph4 AS (SELECT *, abs(d0 - 2 * pi() * floor((d0 + pi()) / (2 * pi()))) AS dev FROM ph3),
pb AS (SELECT {K}, bin, stddev_pop(ph) AS a, stddev_pop(step) AS b FROM ph4 GROUP BY {K}, bin),
pf AS (SELECT {K}, frame, stddev_pop(gd) AS g FROM ph4 GROUP BY {K}, frame),
pha AS (SELECT {K}, 0 AS slot, avg(dev) AS value FROM ph4 GROUP BY {K}
  UNION ALL SELECT {K}, 1, avg(a) FROM pb GROUP BY {K} UNION ALL SELECT {K}, 2, stddev_pop(a) FROM pb GROUP BY {K}
  UNION ALL SELECT {K}, 3, avg(b) FROM pb GROUP BY {K} UNION ALL SELECT {K}, 4, stddev_pop(b) FROM pb GROUP BY {K}
  UNION ALL SELECT {K}, 5, avg(g) FROM pf GROUP BY {K} UNION ALL SELECT {K}, 6, stddev_pop(g) FROM pf GROUP BY {K})"""
HNR = f"""tap AS (SELECT j, 0.5 - 0.5 * cos(2 * pi() * j / {N}) AS h FROM (SELECT unnest(range(0, {N})) AS j)),
cen AS (SELECT {K}, frame, sum(value) / {N} AS m FROM frm GROUP BY {K}, frame),
yy AS (SELECT {K}, frame, j, h, (coalesce(value, 0.0) - m) * h AS y FROM cen CROSS JOIN tap LEFT JOIN frm USING (track_id, chunk, frame, j)),
lg AS (SELECT a.track_id, a.chunk, a.frame, b.j - a.j AS lag, sum(a.y * b.y) AS o, sum(a.h * b.h) AS wt
  FROM yy a JOIN yy b USING (track_id, chunk, frame) WHERE b.j - a.j IN (0, {', '.join(str(k) for k in range(26, 33))}) GROUP BY 1, 2, 3, 4),
hr AS (SELECT track_id, chunk, frame, any_value(z.o) AS o0, max(CASE WHEN z.o > 1e-10 THEN l.o / z.o / (l.wt / z.wt) ELSE 0 END) AS r
  FROM lg z JOIN lg l USING (track_id, chunk, frame) WHERE z.lag = 0 AND l.lag > 0 GROUP BY 1, 2, 3),
hv AS (SELECT *, least(greatest(round(r, 9), 0), 1 - 1e-6::DOUBLE) AS c, o0 > 1e-10 AND round(r, 9) > 1e-3 AS voiced FROM hr),
hnr AS (SELECT {K}, 0 AS slot, coalesce(avg(10 * log10(c / (1 - c))) FILTER (voiced), 0.0) AS value FROM hv GROUP BY {K})"""
FLAT = f"""fla AS (SELECT {K}, frame, 0 AS band, exp(avg(ln(greatest(p, 1e-10)))) / avg(greatest(p, 1e-10)) AS value
  FROM spec GROUP BY {K}, frame)"""
ROLL = f"""rl0 AS (SELECT {K}, frame, bin, sum(mag) OVER (PARTITION BY {K}, frame ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c,
    sum(mag) OVER (PARTITION BY {K}, frame) AS t FROM spec),
rl1 AS (SELECT {K}, frame, min(bin) FILTER (c >= 0.85::DOUBLE * t) AS a, min(bin) FILTER (c >= 0.95::DOUBLE * t) AS b FROM rl0 GROUP BY {K}, frame),
rol AS (SELECT {K}, 0 AS slot, CASE WHEN avg(b) = 0 THEN 0.0 ELSE avg(a) / avg(b) END AS value FROM rl1 GROUP BY {K})"""
KERNEL = min(8, T // 2)
NOVELTY = f"""ssm AS (SELECT a.track_id, a.chunk, a.frame AS fa, b.frame AS fb, sum(a.value * b.value) AS s
  FROM chr a JOIN chr b USING (track_id, chunk, band) GROUP BY 1, 2, 3, 4),
nv0 AS (SELECT {K}, t, sum(s * CASE WHEN (fa >= t) = (fb >= t) THEN 1 ELSE -1 END) AS v
  FROM ssm, (SELECT unnest(range(0, {T})) AS t)
  WHERE fa - t BETWEEN -{KERNEL} AND {KERNEL - 1} AND fb - t BETWEEN -{KERNEL} AND {KERNEL - 1} GROUP BY {K}, t),
nov AS (SELECT {K}, 0 AS slot, avg(greatest(v, 0.0)) AS value FROM nv0 GROUP BY {K})"""
M = BINS // 2 + 1


def _ratio_sql(slot: int, ratio: int) -> str:
    target, reach = M // ratio, max(1, M // (ratio * 10))
    lo, hi = max(1, target - reach), min(M - 1, target + reach)
    return f"""SELECT {K}, {2 * slot} AS slot, least(1, max(a) / any_value(bg) / 20) AS value FROM sb WHERE q BETWEEN {lo} AND {hi} GROUP BY {K}
  UNION ALL SELECT {K}, {2 * slot + 1}, least(1, count(*) FILTER (a > 3 * bg) / 10.0::DOUBLE) FROM sb WHERE q BETWEEN {lo} AND {hi} GROUP BY {K}"""


_COUNTED = [q for r in (2, 4, 8) for q in range(max(1, M // r - 1), min(M, M // r + 2))]
_PLACES = " ".join(f"WHEN {q} THEN {_COUNTED.count(q)}" for q in sorted(set(_COUNTED)))
FOURIER = f"""s2 AS (SELECT {K}, frame, q, sqrt(pow(sum(mag * cos(2 * pi() * bin * q / {BINS})), 2)
    + pow(sum(mag * sin(2 * pi() * bin * q / {BINS})), 2)) AS a
  FROM spec, (SELECT unnest(range(0, {M})) AS q) GROUP BY {K}, frame, q),
sa AS (SELECT {K}, q, avg(a) AS a FROM s2 GROUP BY {K}, q),
sg AS (SELECT {K}, greatest(median(a), 1e-10) AS bg, avg(a) AS mean, stddev_pop(a) AS sd FROM sa WHERE q >= 1 GROUP BY {K}),
sb AS (SELECT * FROM sa JOIN sg USING (track_id, chunk)),
pk AS (SELECT {K}, q - lag(q) OVER (PARTITION BY {K} ORDER BY q) AS step FROM sb WHERE q >= 1 AND a > 2.5 * bg),
rg AS (SELECT {K}, CASE WHEN count(*) > 2 THEN 1 / (1 + stddev_pop(step) / (avg(step) + 1e-8)) ELSE 0 END AS v FROM pk GROUP BY {K}),
ac0 AS (SELECT x.track_id, x.chunk, y.q - x.q AS lag, sum((x.a - x.mean) * (y.a - y.mean)) AS v
  FROM sb x JOIN sb y USING (track_id, chunk) WHERE x.q >= 1 AND y.q >= x.q GROUP BY 1, 2, 3),
ac1 AS (SELECT {K}, lag, v / (first_value(v) OVER w + 1e-10) AS v FROM ac0 WINDOW w AS (PARTITION BY {K} ORDER BY lag)),
ac2 AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM ac1 WINDOW w AS (PARTITION BY {K} ORDER BY lag)),
ac3 AS (SELECT {K}, max(v) AS v FROM ac2 WHERE v > before AND v > after GROUP BY {K}),
fou AS ({_ratio_sql(0, 2)}
  UNION ALL {_ratio_sql(1, 4)}
  UNION ALL {_ratio_sql(2, 8)}
  UNION ALL SELECT {K}, 6, coalesce(rg.v, 0) FROM sg LEFT JOIN rg USING (track_id, chunk)
  UNION ALL SELECT {K}, 7, least(1, max(a) / any_value(bg) / 30) FROM sb WHERE q >= 1 GROUP BY {K}
  UNION ALL SELECT {K}, 8, CASE WHEN sd > 1e-10 THEN least(1, greatest(0, coalesce(ac3.v, 0))) ELSE 0 END
    FROM sg LEFT JOIN ac3 USING (track_id, chunk)
  UNION ALL SELECT {K}, 9, least(1, sum(a * a * CASE q {_PLACES} ELSE 0 END) / (sum(a * a) + 1e-10))
    FROM sb WHERE q >= 1 GROUP BY {K})"""

# ---- registered queries
QUERIES["e01_pool_mean_std"] = lambda spark, sf: _rounded(
    ops.pool_mean_std(
        chunk_rows(series(spark, sf), W, S).select(
            "track_id", "chunk", F.floor(F.col("i") / 4).alias("frame"), (F.col("i") % 4).alias("band"), "value"
        ),
        4,
    ),
    8,
)
SQL["e01_pool_mean_std"] = (
    with_sql(SERIES_SQL, chunks_sql(W, S), f"fr4 AS (SELECT {K}, i % 4 AS band, value FROM chk)", pool_sql("out", "fr4", 4))
    + final("out", 8)
)

QUERIES["e02_spectrum"] = lambda spark, sf: spectrum(_chunks(spark, sf), W, N, HOP, "join").withColumn(
    "re", r6(F.col("re"), 4)
).withColumn("im", r6(F.col("im"), 4))
SQL["e02_spectrum"] = FULL + f"SELECT {K}, frame, bin, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM spec"


def _fft(spark, sf):
    out = spectrum(_chunks(spark, sf), W, N, HOP, "fft")
    return out.withColumn("re", r6(F.col("re"), 4)).withColumn("im", r6(F.col("im"), 4))


QUERIES["e02_spectrum_fft"] = _fft
SQL["e02_spectrum_fft"] = SQL["e02_spectrum"]

def _crossings(spark, sf):
    """The values are positive: whole windows are lowered, zeros behind the end included."""
    lowered = lambda samples: kernels.window_slots(samples - 50.0, N, HOP, SR, ("zcr",), {})
    return _rounded(feature_job.slot_rows(map_windows(block_table(series(spark, sf)), W, S, lambda: lowered)))


QUERIES["e03_zero_crossing"] = _crossings
SQL["e03_zero_crossing"] = (
    with_sql(
        SERIES_SQL, chunks_sql(W, S).replace("chk AS (", "chk9 AS ("),
        "chk AS (SELECT track_id, chunk, i, value - 50.0 AS value FROM chk9)", FRAMES, ZCR, pool_sql("out", "zc", 1),
    )
    + final("out")
)
QUERIES["e04_rms"] = _part("rms")
SQL["e04_rms"] = BASE + "," + RMS + "," + pool_sql("out", "rm", 1) + final("out")

QUERIES["e05_cepstrum"] = _part("cepstrum")
SQL["e05_cepstrum"] = FULL + "," + MEL + "," + CEP + final("pcep")
QUERIES["e06_mel_bands"] = _part("mel")
SQL["e06_mel_bands"] = FULL + "," + MEL + "," + pool_sql("out", "mel", 128) + final("out")
QUERIES["e07_chroma"] = _part("chroma")
SQL["e07_chroma"] = FULL + "," + CHROMA + "," + pool_sql("out", "chr", 12) + final("out")
QUERIES["e08_spectral_contrast"] = _part("contrast")
SQL["e08_spectral_contrast"] = FULL + "," + CONTRAST + "," + pool_sql("out", "con", 7) + final("out")
QUERIES["e09_tonal_centroid"] = _part("tonal")
SQL["e09_tonal_centroid"] = FULL + "," + CHROMA + "," + TONAL + "," + pool_sql("out", "ton", 6) + final("out")
QUERIES["e10_phase_summary"] = _part("phase")
SQL["e10_phase_summary"] = FULL + "," + PHASE + final("pha")
QUERIES["e11_harmonics_to_noise"] = _part("hnr")
SQL["e11_harmonics_to_noise"] = BASE + "," + HNR + final("hnr")
QUERIES["e11_hnr_slot"] = _part("no_hnr")
SQL["e11_hnr_slot"] = with_sql(SERIES_SQL, chunks_sql(W, S)) + (
    f"SELECT DISTINCT {K}, 0 AS slot, 0.0::DOUBLE AS value FROM chk"
)
QUERIES["e12_flatness"] = _part("flatness")
SQL["e12_flatness"] = FULL + "," + FLAT + "," + pool_sql("out", "fla", 1) + final("out")
QUERIES["e13_rolloff_ratio"] = _part("rolloff")
SQL["e13_rolloff_ratio"] = FULL + "," + ROLL + final("rol")
QUERIES["e14_ssm_novelty"] = _part("novelty")
SQL["e14_ssm_novelty"] = FULL + "," + CHROMA + "," + NOVELTY + final("nov")
QUERIES["e15_fourier_artifacts"] = _part("fourier")
SQL["e15_fourier_artifacts"] = FULL + "," + FOURIER + final("fou")


def _vectors(tiers=(1, 2), **settings):
    def run(spark, sf):
        out = feature_job.window_vectors(series(spark, sf), tiers, w=W, s=S, n=N, hop=HOP, sr=SR, **settings)
        return _rounded(feature_job.slot_rows(out))

    return run


_PARTS = {
    1: [("pcep", 120), ("pmel", 256), ("pchr", 24), ("pcon", 14), ("pton", 12), ("pzc", 2), ("prm", 2)],
    2: [("pha", 7), ("hnr", 1), ("pfla", 2), ("rol", 1), ("nov", 1), ("fou", 10)],
}


def _assembled_sql(tiers, hnr=HNR) -> str:
    offset, parts = 0, []
    for tier in tiers:
        for name, size in _PARTS[tier]:
            parts.append(f"SELECT {K}, slot + {offset} AS slot, value FROM {name}")
            offset += size
    body = [
        FULL.rstrip(), MEL, CEP, CHROMA, CONTRAST, TONAL, ZCR, RMS, PHASE, FLAT, ROLL, NOVELTY, FOURIER,
        hnr,
        pool_sql("pmel", "mel", 128), pool_sql("pchr", "chr", 12), pool_sql("pcon", "con", 7),
        pool_sql("pton", "ton", 6), pool_sql("pzc", "zc", 1), pool_sql("prm", "rm", 1), pool_sql("pfla", "fla", 1),
        "everything AS (" + "\n UNION ALL ".join(parts) + ")",
    ]
    return ",\n".join(body) + final("everything")


QUERIES["e16_assemble_tier1"] = _vectors((1,))
SQL["e16_assemble_tier1"] = _assembled_sql((1,))
QUERIES["e16_assemble_tier2"] = _vectors((2,))
SQL["e16_assemble_tier2"] = _assembled_sql((2,))
QUERIES["e16_assemble_combined"] = _vectors()
SQL["e16_assemble_combined"] = _assembled_sql((1, 2))


def _by_join(path):
    return lambda spark, sf: _rounded(feature_job.slot_rows(feature_job.window_vectors_by_join(series(spark, sf), W, S, N, HOP, SR, path)))


QUERIES["e16_assemble_by_join"] = _by_join("join")
QUERIES["e16_assemble_by_aggregates"] = _by_join(None)
for name in ("e16_assemble_by_join", "e16_assemble_by_aggregates"):
    SQL[name] = _assembled_sql((1, 2), f"hnr AS (SELECT DISTINCT {K}, 0 AS slot, 0.0 AS value FROM chk)")


def full_size_series(spark, sf):
    """Prices of the line items as one signal per line number, in order of their orders."""
    items = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("track_id"), F.col("l_orderkey").alias("at"), F.col("l_extendedprice").cast("double").alias("value"))
    ranked = exact_rank(items, ["track_id"], [F.col("at"), F.col("value")], depth_bucket(F.col("at"), depth_bounds(items, F.col("at"))), total="n")
    return ranked.select("track_id", (F.col("rn") - 1).alias("pos"), F.col("value") / 1e5 - 0.5, "n").toDF("track_id", "pos", "value", "n")


def _full_size(spark, sf):
    """Windows of 160 000 samples, frames of 2048, hop 512: the settings of the feature store."""
    return _rounded(feature_job.slot_rows(feature_job.window_vectors(full_size_series(spark, sf))))


QUERIES["e16_full_size_windows"] = _full_size
QUERIES["e17_mean_magnitude"] = lambda spark, sf: _rounded(block_mean_magnitude(block_table(series(spark, sf)), W, S, N, HOP))
SQL["e17_mean_magnitude"] = FULL + (
    f"SELECT {K}, bin, round(avg(mag), {DIGITS}) AS value FROM spec GROUP BY {K}, bin"
)


def _regularity(spark, sf):
    values = _chunks(spark, sf).groupBy("track_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("i", "value"))).getField("value").alias("v")
    )
    floor = F.greatest(ops.array_median(F.col("v")), F.lit(ops.TINY)) * F.lit(1.5)
    return values.select("track_id", "chunk", r6(ops.peak_regularity(F.col("v"), floor)).alias("value"))


QUERIES["e18_peak_regularity"] = _regularity
SQL["e18_peak_regularity"] = with_sql(SERIES_SQL, chunks_sql(W, S)) + f""",
bg AS (SELECT {K}, greatest(median(value), 1e-10) * 1.5 AS t FROM chk GROUP BY {K}),
pk AS (SELECT {K}, i - lag(i) OVER (PARTITION BY {K} ORDER BY i) AS step FROM chk JOIN bg USING (track_id, chunk) WHERE value > t),
rg AS (SELECT {K}, CASE WHEN count(*) > 2 THEN 1 / (1 + stddev_pop(step) / (avg(step) + 1e-8)) ELSE 0 END AS v FROM pk GROUP BY {K})
SELECT {K}, round(coalesce(v, 0), 6) AS value FROM bg LEFT JOIN rg USING (track_id, chunk)"""
