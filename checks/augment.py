"""Augmentation steps over each user's event values, in blocks of 16 samples, and windows of augmented tracks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.base import int_sql, r6, unit_sql, with_sql
from checks.features import FRAMES, HOP, K, N, RMS, SR, SPEC, FLAT, W, _chunks, pool_sql
from checks.windows import SERIES_SQL, chunks_sql, series
from pairloom.operators import augment as ops
from pairloom.operators import block_augment as block
from pairloom.operators.blocks import block_table
from pairloom.operators.spectrum import block_spectrum, long_spectrum
from pairloom.plans import feature_job

QUERIES: dict = {}
SQL: dict = {}

KERNEL = [(0, 1.0), (1, 0.6), (3, -0.35), (7, 0.2)]
LONG_KERNEL = ops.decay_kernel(100, 7)
SIZE = 16


def _rounded(df, digits=6):
    return df.withColumn("value", r6(F.col("value"), digits))


def _blocks(spark, sf):
    return block_table(series(spark, sf), SIZE)


def _in_blocks(step, digits=6):
    """A query of one step over blocks."""
    return lambda spark, sf: _rounded(block.sample_rows(step(_blocks(spark, sf))), digits)


def _resample_sql(length: str) -> str:
    return with_sql(SERIES_SQL) + f""",
len AS (SELECT track_id, pos, value, n, greatest(1, CAST(round_even({length}, 0) AS BIGINT)) AS m FROM ser),
tgt AS (SELECT track_id, pos AS t, n, m, CASE WHEN pos < m THEN
    least(n - 1.0::DOUBLE, greatest(0.0::DOUBLE, (pos + 0.5) * (n::DOUBLE / m) - 0.5)) END AS src FROM len),
two AS (SELECT t.track_id, t.t, t.n, t.src, a.value AS va, coalesce(b.value, a.value) AS vb
  FROM tgt t LEFT JOIN ser a ON a.track_id = t.track_id AND a.pos = floor(t.src)
  LEFT JOIN ser b ON b.track_id = t.track_id AND b.pos = floor(t.src) + 1)
SELECT track_id, t AS pos, n, round(CASE WHEN src IS NULL THEN 0.0
  ELSE va + (vb - va) * (src - floor(src)) END, 9) + 0.0 AS value FROM two"""


QUERIES["j01_pitch_shift_up"] = _in_blocks(lambda b: block.pitch_shift(b, 1.5, SIZE), 9)
SQL["j01_pitch_shift_up"] = _resample_sql("n / pow(2::DOUBLE, 1.5 / 12)")
QUERIES["j01_pitch_shift_down"] = _in_blocks(lambda b: block.pitch_shift(b, -1.5, SIZE), 9)
SQL["j01_pitch_shift_down"] = _resample_sql("n / pow(2::DOUBLE, -1.5 / 12)")
QUERIES["j02_time_stretch"] = _in_blocks(lambda b: block.time_stretch(b, 0.83, SIZE), 9)
SQL["j02_time_stretch"] = _resample_sql("n * 0.83::DOUBLE")
QUERIES["j03_gain"] = lambda spark, sf: _rounded(ops.gain(series(spark, sf), -4.5))
SQL["j03_gain"] = with_sql(SERIES_SQL) + (
    "SELECT track_id, pos, n, round(value * pow(10::DOUBLE, -4.5 / 20), 6) AS value FROM ser"
)


def normal_sql(seed: str, *cols: str) -> str:
    u = f"(({int_sql(seed + '|u', *cols)} + 1) / 1152921504606846976.0::DOUBLE)"
    v = f"({int_sql(seed + '|v', *cols)} / 1152921504606846976.0::DOUBLE)"
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


QUERIES["j04_add_noise"] = lambda spark, sf: _rounded(ops.add_noise(series(spark, sf), 30.0))
SQL["j04_add_noise"] = with_sql(SERIES_SQL) + f"""
SELECT track_id, pos, n, round(value + {normal_sql('42|white', 'track_id', 'pos')}
  * sqrt(avg(value * value) OVER (PARTITION BY track_id) / pow(10::DOUBLE, 3)), 6) + 0.0 AS value FROM ser"""


def mix_sql(col: str, source: str) -> str:
    """``source`` with the 32-bit hash of a column as ``{col}_m``."""
    return f"""(SELECT * EXCLUDE (m4), xor(m4, m4 >> 16) AS {col}_m FROM (
  SELECT * EXCLUDE (m3), m3 * 3266489909::UBIGINT % 4294967296 AS m4 FROM (
  SELECT * EXCLUDE (m2), xor(m2, m2 >> 13) AS m3 FROM (
  SELECT * EXCLUDE (m1), m1 * 2246822507::UBIGINT % 4294967296 AS m2 FROM (
  SELECT *, xor({col}, {col} >> 16) AS m1 FROM {source})))))"""


def normals_sql(key: str, source: str) -> str:
    """``source`` (track_id, pos, …) with a normal number z of the key and the position."""
    keyed = mix_sql("key", f"(SELECT *, ({key} % 4294967296)::UBIGINT AS key FROM {source})")
    drawn = f"(SELECT *, xor((2 * pos)::UBIGINT, key_m) AS u, xor((2 * pos + 1)::UBIGINT, key_m) AS v FROM {keyed})"
    both = mix_sql("v", mix_sql("u", drawn))
    return f"(SELECT * EXCLUDE (key, key_m, u, v, u_m, v_m), sqrt(-2 * ln((u_m + 1) / 4294967296.0::DOUBLE)) * cos(2 * pi() * (v_m / 4294967296.0::DOUBLE)) AS z FROM {both})"


def filter_sql(name: str, source: str, f: str, q: str, db: str, on: str | None = None) -> str:
    """A peaking filter in time by its impulse response; f, q and db may be columns of par."""
    clip = f"CASE WHEN {on} THEN least(greatest(y, -1), 1) ELSE y END" if on else "y"
    return f"""{name}_p AS MATERIALIZED (SELECT track_id, 2 * pi() * {f} / {SR} AS w0, sin(2 * pi() * {f} / {SR}) / (2 * {q}) AS al, pow(10::DOUBLE, {db} / 40.0::DOUBLE) AS a FROM par),
{name}_c AS MATERIALIZED (SELECT track_id, (1 + al * a) / (1 + al / a) AS b0, -2 * cos(w0) / (1 + al / a) AS c1, (1 - al * a) / (1 + al / a) AS b2,
  (1 - al / a) / (1 + al / a) AS c2 FROM {name}_p),
{name}_h AS (SELECT track_id, b0, c1, b2, c2, 0 AS k, b0 AS h, 0.0::DOUBLE AS g FROM {name}_c
  UNION ALL SELECT track_id, b0, c1, b2, c2, k + 1, CASE k WHEN 0 THEN c1 WHEN 1 THEN b2 ELSE 0 END - c1 * h - c2 * g, h FROM {name}_h
  WHERE k < (SELECT max(n) FROM ser)),
{name} AS MATERIALIZED (SELECT track_id, pos, n, {clip} AS value FROM (
  SELECT s.track_id, s.pos, s.n, sum(x.value * h.h) AS y FROM {source} s JOIN {source} x ON x.track_id = s.track_id AND x.pos <= s.pos
  JOIN {name}_h h ON h.track_id = s.track_id AND h.k = s.pos - x.pos GROUP BY 1, 2, 3) JOIN par USING (track_id))"""


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


TRACKS_SQL = "par AS (SELECT DISTINCT track_id FROM ser)"
for _name, _args in {
    "j05_eq_peak": (1200.0, 0.9, 5.0),
    "j09_band_reject": (2500.0, 3.0, -9.0),
    "j10_bass_shift": (180.0, 0.7, 6.0),
}.items():
    QUERIES[_name] = _in_blocks(lambda b, args=_args: block.equalise(b, SR, *args, SIZE))
    SQL[_name] = recursive(SERIES_SQL, TRACKS_SQL, filter_sql("eq", "ser", *map(str, _args))) + "SELECT track_id, pos, n, round(value, 6) + 0.0 AS value FROM eq"


def _convolve_sql(kernel, wet: float) -> str:
    rows = ", ".join(f"({k}, {h!r}::DOUBLE)" for k, h in kernel)
    return with_sql(SERIES_SQL, f"ker(k, h) AS (VALUES {rows})") + f""",
cnv AS (SELECT s.track_id, s.pos + k AS pos, sum(s.value * h) AS y FROM ser s, ker WHERE s.pos + k < s.n GROUP BY 1, 2)
SELECT s.track_id, s.pos, s.n, round({1 - wet} * s.value + {wet} * coalesce(y, 0), 6) + 0.0 AS value
FROM ser s LEFT JOIN cnv c USING (track_id, pos)"""


QUERIES["j06_convolve_taps"] = lambda spark, sf: _rounded(ops.convolve(series(spark, sf), KERNEL, 0.25))
SQL["j06_convolve_taps"] = _convolve_sql(KERNEL, 0.25)
def _long_kernel() -> np.ndarray:
    h = 0.25 * np.array([v for _, v in LONG_KERNEL])
    h[0] += 0.75
    return h


QUERIES["j06_convolve_blocks"] = _in_blocks(lambda b: block.convolve(b, _long_kernel, {}, SIZE))
SQL["j06_convolve_blocks"] = _convolve_sql(LONG_KERNEL, 0.25)

QUERIES["j07_crop"] = lambda spark, sf: ops.crop(series(spark, sf), 10, 40)
SQL["j07_crop"] = with_sql(SERIES_SQL) + f""",
cr AS (SELECT *, 10 + {int_sql('42|len', 'track_id')} % (least(40, n) - 10 + 1) AS len FROM ser),
cs AS (SELECT *, {int_sql('42|off', 'track_id')} % (n - len + 1) AS st FROM cr)
SELECT track_id, pos - st AS pos, value, n FROM cs WHERE n > 10 AND pos BETWEEN st AND st + len - 1
UNION ALL SELECT track_id, pos, 0.0, n FROM cs WHERE n > 10 AND pos >= len
UNION ALL SELECT track_id, pos, value, n FROM cs WHERE n <= 10"""

QUERIES["j08_add_coloured_noise"] = _in_blocks(lambda b: block.add_coloured_noise(b, 20.0))
SQL["j08_add_coloured_noise"] = with_sql(SERIES_SQL) + f""",
wk AS (SELECT *, sum(z) OVER (PARTITION BY track_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS w FROM {normals_sql(int_sql('42|colour', 'track_id'), 'ser')})
SELECT track_id, pos, n, round(value + (w - avg(w) OVER t) * (sqrt(avg(value * value) OVER t / pow(10::DOUBLE, 2))
  / (stddev_pop(w) OVER t + 1e-8)), 6) + 0.0 AS value FROM wk WINDOW t AS (PARTITION BY track_id)"""

QUERIES["j11_perturb"] = lambda spark, sf: _rounded(
    ops.perturb(_chunks(spark, sf).withColumnRenamed("i", "dim"), 0.1, 0.2)
)
SQL["j11_perturb"] = with_sql(SERIES_SQL, chunks_sql(W, 32)) + f"""
SELECT {K}, i AS dim, round((value + 0.1 * {normal_sql('42|feat', K, 'i')})
  * CASE WHEN {unit_sql('42|drop', K, 'i')} > 0.2 THEN 1 ELSE 0 END, 6) + 0.0 AS value FROM chk"""


# ---- the whole chain: a plan over blocks, and the same steps as SQL
CHAIN = {"variants": 2, "p": 0.5, "taps": 20, "piece": (10, 40)}


def _draw(step: str, lo: float, hi: float) -> str:
    return f"({lo} + ({hi} - {lo}) * {unit_sql(f'42|{step}', 'track_id')})"


def _on(step: str) -> str:
    return f"(track_id NOT LIKE '%#0' AND {unit_sql(f'42|on|{step}', 'track_id')} < {CHAIN['p']})"


_SETTINGS = {
    "semitones": f"CASE WHEN {_on('pitch')} THEN {_draw('pitch', -2.0, 2.0)} ELSE 0.0 END",
    "rate": f"CASE WHEN {_on('stretch')} THEN {_draw('stretch', 0.8, 1.2)} ELSE 1.0 END",
    "gain": f"CASE WHEN {_on('gain')} THEN {_draw('gain', -6.0, 6.0)} ELSE 0.0 END",
    "white": f"CASE WHEN {_on('white')} THEN {_draw('white', 20.0, 40.0)} END",
    "wet": f"CASE WHEN {_on('reverb')} THEN {_draw('reverb', 0.1, 0.4)} ELSE 0.0 END",
    "colour": f"CASE WHEN {_on('colour')} THEN {_draw('colour', 15.0, 35.0)} END",
    "crop": _on("crop"),
    "eqf": _draw("eq|f", 200.0, 4000.0), "eqq": _draw("eq|q", 0.5, 2.0),
    "eqdb": f"CASE WHEN {_on('eq')} THEN {_draw('eq|db', -6.0, 6.0)} ELSE 0.0 END", "eqon": _on("eq"),
    "cutf": _draw("cut|f", 500.0, 4000.0), "cutq": _draw("cut|q", 1.0, 5.0),
    "cutdb": f"CASE WHEN {_on('cut')} THEN {_draw('cut|db', -12.0, -3.0)} ELSE 0.0 END", "cuton": _on("cut"),
    "shiftf": f"CASE WHEN {unit_sql('42|side', 'track_id')} < 0.5 THEN {_draw('bass', 80.0, 300.0)} ELSE {_draw('treble', 4000.0, 8000.0)} END",
    "shiftq": _draw("shift|q", 0.5, 1.5),
    "shiftdb": f"CASE WHEN {_on('shift')} THEN {_draw('shift|db', -6.0, 6.0)} ELSE 0.0 END", "shifton": _on("shift"),
}


def _stretched_sql(name: str, source: str, length: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT t.track_id, t.pos, t.n, CASE WHEN src IS NULL THEN 0.0 ELSE a.value + (coalesce(b.value, a.value) - a.value) * (src - floor(src)) END AS value
  FROM (SELECT track_id, pos, n, CASE WHEN pos < m THEN least(n - 1.0::DOUBLE, greatest(0.0::DOUBLE, (pos + 0.5) * (n::DOUBLE / m) - 0.5)) END AS src
    FROM (SELECT *, greatest(1, CAST(round_even({length}, 0) AS BIGINT)) AS m FROM {source} JOIN par USING (track_id))) t
  LEFT JOIN {source} a ON a.track_id = t.track_id AND a.pos = floor(t.src)
  LEFT JOIN {source} b ON b.track_id = t.track_id AND b.pos = floor(t.src) + 1)"""


def _chain_ctes(scale: float) -> list[str]:
    """The augmented series as ``out`` (track_id, pos, value, n)."""
    low, high = CHAIN["piece"]
    taps = CHAIN["taps"]
    return [
        SERIES_SQL.replace("ser AS (", "ser0 AS (", 1),
        f"ser AS MATERIALIZED (SELECT track_id || '#' || v AS track_id, pos, value / {scale} - 0.5 AS value, n FROM ser0, (SELECT unnest(range(0, {CHAIN['variants'] + 1})) AS v))",
        "par AS MATERIALIZED (SELECT track_id, " + ", ".join(f"{x} AS {k}" for k, x in _SETTINGS.items()) + " FROM (SELECT DISTINCT track_id FROM ser))",
        _stretched_sql("st1", "ser", "n / pow(2::DOUBLE, semitones / 12)"),
        _stretched_sql("st2", "st1", "n * rate"),
        "st3 AS MATERIALIZED (SELECT track_id, pos, n, value * pow(10::DOUBLE, gain / 20) AS value FROM st2 JOIN par USING (track_id))",
        f"""st4 AS MATERIALIZED (SELECT track_id, pos, n, value + coalesce(z * sqrt(avg(value * value) OVER (PARTITION BY track_id) / pow(10::DOUBLE, white / 10)), 0) AS value
  FROM {normals_sql(int_sql('42|white', 'track_id'), 'st3')} JOIN par USING (track_id))""",
        filter_sql("st5", "st4", "eqf", "eqq", "eqdb", "eqon"),
        f"""room AS MATERIALIZED (SELECT track_id, pos AS k, z * exp(-5.0::DOUBLE * pos / {taps - 1}) AS h
  FROM {normals_sql(int_sql('42|room', 'track_id'), f'(SELECT track_id, unnest(range(0, {taps})) AS pos FROM par)')}),
imp AS MATERIALIZED (SELECT track_id, k, wet * h / (max(abs(h)) OVER (PARTITION BY track_id) + 1e-8) + CASE WHEN k = 0 THEN 1 - wet ELSE 0 END AS h FROM room JOIN par USING (track_id)),
st6 AS MATERIALIZED (SELECT s.track_id, s.pos + k AS pos, s.n, sum(s.value * h) AS value FROM st5 s JOIN imp USING (track_id) WHERE s.pos + k < s.n GROUP BY 1, 2, 3)""",
        f"""cr AS MATERIALIZED (SELECT st6.*, crop AND n > {low} AS hit, {low} + {int_sql('42|len', 'track_id')} % (least({high}, n) - {low} + 1) AS len FROM st6 JOIN par USING (track_id)),
cs AS MATERIALIZED (SELECT *, CASE WHEN hit THEN {int_sql('42|off', 'track_id')} % (n - len + 1) END AS st FROM cr),
st7 AS MATERIALIZED (SELECT track_id, pos - st AS pos, n, value FROM cs WHERE hit AND pos BETWEEN st AND st + len - 1
  UNION ALL SELECT track_id, pos, n, 0.0 FROM cs WHERE hit AND pos >= len UNION ALL SELECT track_id, pos, n, value FROM cs WHERE NOT hit)""",
        f"""wlk AS MATERIALIZED (SELECT *, sum(z) OVER (PARTITION BY track_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS w FROM {normals_sql(int_sql('42|colour', 'track_id'), 'st7')}),
st8 AS MATERIALIZED (SELECT track_id, pos, n, value + coalesce((w - avg(w) OVER t) * sqrt(avg(value * value) OVER t / pow(10::DOUBLE, colour / 10)) / (stddev_pop(w) OVER t + 1e-8), 0) AS value
  FROM wlk JOIN par USING (track_id) WINDOW t AS (PARTITION BY track_id))""",
        filter_sql("st9", "st8", "cutf", "cutq", "cutdb", "cuton"),
        filter_sql("out", "st9", "shiftf", "shiftq", "shiftdb", "shifton"),
    ]


def _augmented(spark, sf):
    values = series(spark, sf).withColumn("value", F.col("value") / 100.0 - 0.5)
    return block.augment(block_table(values, SIZE), sr=SR, size=SIZE, **CHAIN)


QUERIES["j12_augment_chain"] = lambda spark, sf: _rounded(block.sample_rows(_augmented(spark, sf)))
SQL["j12_augment_chain"] = recursive(*_chain_ctes(100.0)) + "SELECT track_id, pos, n, round(value, 6) + 0.0 AS value FROM out"


def _augmented_features(spark, sf):
    """From augmented blocks to window features without a row per sample."""
    found = feature_job.window_parts(_augmented(spark, sf), ("rms", "flatness"), W, 32, N, HOP, SR)
    return _rounded(feature_job.slot_rows(found), 5)


def _augmented_spectrum(spark, sf):
    """From augmented blocks to bins without a row per sample."""
    spec = long_spectrum(block_spectrum(_augmented(spark, sf), W, 32, N, HOP))
    return spec.withColumns({c: r6(F.col(c), 4) for c in ("re", "im")})


QUERIES["j13_augmented_spectrum"] = _augmented_spectrum
SQL["j13_augmented_spectrum"] = recursive(*_chain_ctes(100.0), chunks_sql(W, 32, "out"), FRAMES, SPEC) + (
    f"SELECT {K}, frame, bin, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM spec"
)
QUERIES["j13_augmented_features"] = _augmented_features
SQL["j13_augmented_features"] = recursive(
    *_chain_ctes(100.0), chunks_sql(W, 32, "out"), FRAMES, SPEC, RMS, FLAT, pool_sql("prm", "rm", 1), pool_sql("pfl", "fla", 1)
) + f"SELECT {K}, slot, round(value, 5) + 0.0 AS value FROM prm UNION ALL SELECT {K}, slot + 2, round(value, 5) + 0.0 FROM pfl"
