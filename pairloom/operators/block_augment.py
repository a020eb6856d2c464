"""Augmentation of series in blocks: no sample is a row, every step keeps the length of its track.

Tables are block tables (track_id, start, samples, n) on a grid of ``size`` samples. A step's settings are numbers or
columns of the track, so that every variant draws its own. Random numbers are hashes of a key and a position:
the same on every engine and on every retry. Where a step needs samples of other blocks, slices of blocks or the tails of
convolved blocks travel to the block that needs them, in groups of a bounded number of samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_between, hash_int, hash_unit
from pairloom.operators.blocks import BLOCK
from pairloom.session import cut_lineage

_MASK = 0xFFFFFFFF
#: samples of a block, at least, where whole steps run; numbers of an outgoing batch; products up to which sums are quicker than transforms
WORK, TOGETHER, DIRECT = 8192, 1 << 20, 1 << 16
#: a filter's impulse response ends where it has fallen below this share
FADED = 1e-16


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


# ---- random numbers of a key and a position
def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 32-bit hash on whole numbers below 2**32."""
    x = x ^ x >> np.uint64(16)
    x = x * np.uint64(0x85EBCA6B) & np.uint64(_MASK)
    x = x ^ x >> np.uint64(13)
    x = x * np.uint64(0xC2B2AE35) & np.uint64(_MASK)
    return x ^ x >> np.uint64(16)


def normals(key: int, start: int, count: int) -> np.ndarray:
    """Normal numbers of the positions from ``start`` on."""
    at = np.arange(start, start + count, dtype=np.uint64) * np.uint64(2)
    high = mixed(at >> np.uint64(32) ^ np.uint64(key & _MASK))
    u, v = (mixed((at + np.uint64(k) & np.uint64(_MASK)) ^ high) for k in (0, 1))
    return np.sqrt(-2 * np.log((u + np.uint64(1)) / 2.0**32)) * np.cos(2 * np.pi * (v / 2.0**32))


def noise_key(seed: str, track: Column) -> Column:
    return hash_int(seed, track) % F.lit(1 << 32)


# ---- plumbing
def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column, as views of one array."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _lists(rows: Sequence[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0), *rows])))


def _batches(rows: Iterable[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Blocks (track, start, samples, n) in batches of about ``TOGETHER`` samples."""
    held, size = [], 0
    made = lambda: pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in held], kind), pa.array([r[1] for r in held], pa.int64()), _lists([r[2] for r in held]), pa.array([r[3] for r in held], pa.int64())],
        ["track_id", "start", "samples", "n"],
    )
    for row in rows:
        held.append(row)
        size += len(row[2]) + 1
        if size >= TOGETHER:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _kind(blocks: DataFrame) -> str:
    return dict(blocks.dtypes)["track_id"]


def _lists_of(columns: Iterable[pa.Array]) -> list[list]:
    return [c.to_pylist() for c in columns]


def joined_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks on a grid of ``size`` samples, a multiple of the given grid: neighbours become one block."""
    whole = F.flatten(F.array_sort(F.collect_list(F.struct("start", "samples"))).getField("samples"))
    at = (F.floor(F.col("start") / F.lit(size)) * size).cast("long")
    return blocks.groupBy("track_id", at.alias("_at")).agg(whole.alias("samples"), F.first("n").alias("n")).select(
        "track_id", F.col("_at").alias("start"), "samples", "n"
    )


def cut_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks on a grid of ``size`` samples, which divides the given grid; no shuffle."""
    places = F.sequence(F.lit(0), F.greatest(F.size("samples") - 1, F.lit(0)), F.lit(size))
    return blocks.withColumn("_at", F.explode(places)).select(
        "track_id", (F.col("start") + F.col("_at")).alias("start"), F.slice("samples", F.col("_at") + 1, F.lit(size)).alias("samples"), "n"
    )


def work_size(size: int) -> int:
    """The grid to work on: the multiple of ``size`` that reaches ``WORK``."""
    return size * -(-WORK // size)


def map_blocks(blocks: DataFrame, function: Callable, settings: dict[str, Column | float]) -> DataFrame:
    """Blocks with ``function(samples, start, n, *settings)`` for samples."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        tracks, starts, counts, *given = _lists_of([*batch.columns[:2], *batch.columns[3:]])
        for k, x in enumerate(_arrays(batch.column(2))):
            yield tracks[k], starts[k], function(x, starts[k], counts[k], *(g[k] for g in given)), counts[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(rows(batch), batch.column(0).type)

    columns = [_col(v).alias(f"_{k}") for k, v in settings.items()]
    given = blocks.select("track_id", F.col("start").cast("long"), "samples", F.col("n").cast("long"), *columns)
    return given.mapInArrow(run, f"track_id {_kind(blocks)}, start long, samples array<double>, n long")


def block_sums(blocks: DataFrame, function: Callable, names: Sequence[str], settings: dict[str, Column | float]) -> DataFrame:
    """(track_id, start, n, names): ``function`` gives so many numbers for a block; a row is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, counts, *given = _lists_of([batch.column(1), *batch.columns[3:]])
            rows = [
                [float(v) for v in function(x, starts[k], counts[k], *(g[k] for g in given))] for k, x in enumerate(_arrays(batch.column(2)))
            ]
            sums = [pa.array(c, pa.float64()) for c in (zip(*rows) if rows else [[] for _ in names])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *sums], ["track_id", "start", "n", *names])

    columns = [_col(v).alias(f"_{k}") for k, v in settings.items()]
    given = blocks.select("track_id", F.col("start").cast("long"), "samples", F.col("n").cast("long"), *columns)
    return given.mapInArrow(run, f"track_id {_kind(blocks)}, start long, n long, " + ", ".join(f"{x} double" for x in names))


def _rerouted(
    blocks: DataFrame, size: int, first: Column, last: Column, low: Callable[[Column], Column], high: Callable[[Column], Column],
    function: Callable, settings: dict[str, Column | float],
) -> DataFrame:
    """Blocks made by ``function(source, source_start, start, count, n, *settings)`` from the slices of blocks that they need.

    A block serves the target positions ``first``..``last`` (none if in disorder); the target block from a on needs the source from ``low(a)``
    to before ``high(a)``. Every block also sends nothing to its own place, so that all places are there.
    """
    names = list(settings)
    rows = blocks.select("track_id", F.col("start").cast("long"), "samples", F.col("n").cast("long"), *[_col(settings[k]).alias(f"_{k}") for k in names])
    lo, hi = (F.floor(x / F.lit(size)) * size for x in (first, last))
    reach = F.when(first <= last, F.sequence(lo.cast("long"), hi.cast("long"), F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_to", F.explode(F.array_distinct(F.concat(F.array(F.col("start")), reach))))
    begin = F.greatest(F.col("start"), low(F.col("_to"))).cast("long")
    end = F.least(F.col("start") + F.size("samples"), high(F.col("_to"))).cast("long")
    cut = F.slice("samples", (begin - F.col("start") + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
    cut = F.when(begin < end, cut).otherwise(F.array().cast("array<double>"))
    rows = rows.select("track_id", "_to", "n", *[f"_{k}" for k in names], F.struct(begin.alias("at"), cut.alias("samples")).alias("_p"))
    grouped = rows.groupBy("track_id", "_to").agg(F.first("n").alias("n"), *[F.first(f"_{k}").alias(f"_{k}") for k in names], F.collect_list("_p").alias("_parts"))

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        tracks, starts, counts, *rest = _lists_of(batch.columns[:-1])
        ends = batch.columns[-1].offsets.to_pylist()
        places, slices = batch.columns[-1].values.field("at").to_pylist(), _arrays(batch.columns[-1].values.field("samples"))
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            parts = sorted((places[i], i) for i in range(a, b) if len(slices[i]))
            source = np.concatenate([np.empty(0), *(slices[i] for _, i in parts)])
            start, n = starts[k], counts[k]
            yield tracks[k], start, function(source, parts[0][0] if parts else 0, start, min(size, n - start), n, *(c[k] for c in rest)), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(rows(batch), batch.column(0).type)

    return grouped.mapInArrow(run, f"track_id {_kind(blocks)}, start long, samples array<double>, n long")


# ---- steps
def _interpolated(source: np.ndarray, first: int, start: int, count: int, n: int, m: float) -> np.ndarray:
    out, used = np.zeros(count), int(max(0, min(count, m - start)))
    if used:
        at = np.clip((np.arange(start, start + used) + 0.5) * (n / m) - 0.5, 0, n - 1)
        low = np.floor(at).astype(np.int64)
        high = np.minimum(low + 1, n - 1)
        out[:used] = source[low - first] + (source[high - first] - source[low - first]) * (at - low)
    return out


def resample(blocks: DataFrame, new_length: Column, size: int = BLOCK) -> DataFrame:
    """Linear resampling to ``new_length`` samples, then cut or zero-padded to the old length.

    Target t reads source (t + 0.5)·n/new − 0.5 between its two neighbours.
    """
    m = new_length.cast("double")
    scale = F.col("n") / m
    target = lambda p: (p + F.lit(0.5)) / scale - F.lit(0.5)
    stop = F.col("start") + F.size("samples")
    last = F.least(m, F.col("n").cast("double")) - 1
    first = F.when(F.col("start") == 0, F.lit(0.0)).otherwise(F.greatest(F.floor(target(F.col("start") - 1)), F.lit(0)).cast("double"))
    # the neighbours' formula may differ in the last bit: one sample more on either side
    reach = F.when(stop >= F.col("n"), last).otherwise(F.least(F.ceil(target(stop)).cast("double"), last))
    step = F.col("n") / F.col("_m")
    low = lambda a: F.floor((a + F.lit(0.5)) * step - F.lit(1.5))
    high = lambda a: F.ceil((a + F.lit(size)) * step + F.lit(2.5))
    return _rerouted(blocks, size, first, reach, low, high, _interpolated, {"m": m})


def pitch_shift(blocks: DataFrame, semitones: Column | float, size: int = BLOCK) -> DataFrame:
    ratio = F.pow(F.lit(2.0), _col(semitones) / F.lit(12.0))
    return resample(blocks, F.greatest(F.lit(1.0), F.rint(F.col("n") / ratio)), size)


def time_stretch(blocks: DataFrame, rate: Column | float, size: int = BLOCK) -> DataFrame:
    return resample(blocks, F.greatest(F.lit(1.0), F.rint(F.col("n") * _col(rate))), size)


def gain(blocks: DataFrame, db: Column | float) -> DataFrame:
    return map_blocks(blocks, lambda x, start, n, db: x * 10 ** (db / 20), {"db": db})


def add_noise(blocks: DataFrame, snr: Column | float, seed: str | int = 42, on: Column | None = None) -> DataFrame:
    """White noise at a signal-to-noise ratio in dB; ``on`` limits it to some tracks."""
    sums = block_sums(blocks, lambda x, start, n: [x @ x], ["square"], {})
    power = sums.groupBy("track_id").agg((F.sum("square") / F.first("n")).alias("power"))
    scale = F.sqrt(F.col("power") / F.pow(F.lit(10.0), _col(snr) / F.lit(10.0)))
    scale = scale if on is None else F.when(on, scale).otherwise(F.lit(0.0))
    noisy = lambda x, start, n, key, scale: x + scale * normals(int(key), start, len(x)) if scale else x
    return map_blocks(blocks.join(power, "track_id"), noisy, {"key": noise_key(f"{seed}|white", F.col("track_id")), "scale": scale})


def add_coloured_noise(blocks: DataFrame, snr: Column | float, seed: str | int = 42, on: Column | None = None) -> DataFrame:
    """Running sum of white noise, centred and scaled to the target level.

    A block knows its own running sum; what lies before it comes from the sums of the earlier blocks, a row each.
    """
    key = noise_key(f"{seed}|colour", F.col("track_id"))

    def local(x: np.ndarray, start: int, n: int, key: int) -> list[float]:
        walk = np.cumsum(normals(int(key), start, len(x)))
        return [x @ x, walk[-1] if len(x) else 0.0, walk.sum(), walk @ walk, len(x)]

    sums = cut_lineage(block_sums(blocks, local, ["square", "total", "s1", "s2", "length"], {"key": key}))
    earlier = Window.partitionBy("track_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    shifted = placed.withColumns({
        "t1": F.col("before") * F.col("length") + F.col("s1"),
        "t2": F.col("before") * F.col("before") * F.col("length") + 2 * F.col("before") * F.col("s1") + F.col("s2"),
    })
    track = shifted.groupBy("track_id").agg(*((F.sum(c) / F.first("n")).alias(c) for c in ("square", "t1", "t2")))
    spread = F.sqrt(F.greatest(F.col("t2") - F.col("t1") * F.col("t1"), F.lit(0.0))) + F.lit(1e-8)
    scale = F.sqrt(F.col("square") / F.pow(F.lit(10.0), _col(snr) / F.lit(10.0))) / spread
    scale = scale if on is None else F.when(on, scale).otherwise(F.lit(0.0))
    both = blocks.join(placed.select("track_id", "start", "before"), ["track_id", "start"]).join(track, "track_id")

    def noisy(x: np.ndarray, start: int, n: int, key: int, before: float, mean: float, scale: float) -> np.ndarray:
        return x + scale * (before - mean + np.cumsum(normals(int(key), start, len(x)))) if scale else x

    return map_blocks(both, noisy, {"key": key, "before": F.col("before"), "mean": F.col("t1"), "scale": scale})


def convolve(
    blocks: DataFrame, kernel: Callable[..., np.ndarray], settings: dict[str, Column | float], size: int = BLOCK, limit: float | None = None,
) -> DataFrame:
    """x * h, cut to the length of x, with h = ``kernel(*settings)`` of the track; ``limit`` clips the result to ±limit.

    Overlap-add: a block is convolved, the tail behind it is sent to the blocks that follow. Short blocks are joined to
    ``WORK`` samples first and cut again, so that a response of thousands of samples does not send a row for every few.
    """
    if size < WORK:
        return cut_blocks(convolve(joined_blocks(blocks, work_size(size)), kernel, settings, work_size(size), limit), size)

    def tails(batch: pa.RecordBatch) -> Iterator[tuple]:
        tracks, starts, counts, *rest = _lists_of([*batch.columns[:2], *batch.columns[3:]])
        known: tuple = (None, None)
        for k, x in enumerate(_arrays(batch.column(2))):
            given, n = [c[k] for c in rest], counts[k]
            if known[0] != given:
                known = (given, kernel(*given))
            h = known[1][:n]
            reach = min(len(x) + len(h) - 1, n - starts[k])
            if len(h) > 1 and len(x) * len(h) > DIRECT:
                width = 1 << (len(x) + len(h) - 2).bit_length()
                y = np.fft.irfft(np.fft.rfft(x, width) * np.fft.rfft(h, width), width)[:reach]
            else:
                y = np.convolve(x, h)[:reach] if len(h) > 1 and len(x) else x * known[1][0]
            for at in range(0, len(y), size):
                yield tracks[k], starts[k] + at, y[at : at + size], n

    def added(batch: pa.RecordBatch) -> Iterator[tuple]:
        tracks, starts, counts = _lists_of(batch.columns[:3])
        ends, slices = batch.column(3).offsets.to_pylist(), _arrays(batch.column(3).values)
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            parts = sorted(slices[a:b], key=len)
            y = np.zeros(len(parts[-1]))
            for part in parts:
                y[: len(part)] += part
            yield tracks[k], starts[k], y if limit is None else np.clip(y, -limit, limit), counts[k]

    def each(rows: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _batches(rows(batch), batch.column(0).type)

        return run

    columns = [_col(v).alias(f"_{k}") for k, v in settings.items()]
    schema = f"track_id {_kind(blocks)}, start long, samples array<double>, n long"
    given = blocks.select("track_id", F.col("start").cast("long"), "samples", F.col("n").cast("long"), *columns)
    pieces = given.mapInArrow(each(tails), schema).groupBy("track_id", "start").agg(F.first("n").alias("n"), F.collect_list("samples").alias("_parts"))
    return pieces.mapInArrow(each(added), schema)


def filter_response(sr: float, centre: float, q: float, db: float, most: float = math.inf) -> np.ndarray:
    """Impulse response of a second-order peaking filter, as far as it can be told from 0, of at most ``most`` numbers."""
    if db == 0:
        return np.ones(1)
    a, w0 = 10 ** (db / 40), 2 * math.pi * centre / sr
    alpha, middle = math.sin(w0) / (2 * q), -2 * math.cos(w0)
    top = 1 + alpha / a
    b, c1, c2 = [(1 + alpha * a) / top, middle / top, (1 - alpha * a) / top], middle / top, (1 - alpha / a) / top
    apart = c1 * c1 / 4 - c2
    radius = math.sqrt(c2) if apart < 0 else abs(c1) / 2 + math.sqrt(apart)
    length = 3 + int(math.ceil(math.log(FADED) / math.log(radius))) if 0 < radius < 1 else 3
    length = int(max(1, min(length, most)))
    h = [0.0, 0.0]
    for k in range(length):
        h.append((b[k] if k < 3 else 0.0) - c1 * h[-1] - c2 * h[-2])
    return np.array(h[2:])


def equalise(
    blocks: DataFrame, sr: float, centre: Column | float, q: Column | float, db: Column | float, size: int = BLOCK, limit: float | None = None,
) -> DataFrame:
    """Peaking filter in time; a negative ``db`` rejects the band, a low or high ``centre`` shifts bass or treble."""
    return convolve(blocks, filter_response, {"sr": sr, "centre": centre, "q": q, "db": db, "most": F.col("n").cast("double")}, size, limit)


def reverb_response(key: float, taps: float, wet: float) -> np.ndarray:
    """Dry signal and decaying noise, scaled by its largest value."""
    if wet == 0:
        return np.ones(1)
    h = normals(int(key), 0, int(taps)) * np.exp(-np.linspace(0.0, 5.0, int(taps)))
    h = wet * h / (np.abs(h).max() + 1e-8)
    h[0] += 1 - wet
    return h


def reverb(blocks: DataFrame, taps: int, wet: Column | float, seed: str | int = 42, size: int = BLOCK) -> DataFrame:
    """(1 − wet)·x + wet·(x * response), with a response of its own for every track."""
    key = noise_key(f"{seed}|room", F.col("track_id"))
    return convolve(blocks, reverb_response, {"key": key.cast("double"), "taps": taps, "wet": wet}, size)


def crop(blocks: DataFrame, low: int, high: int, seed: str | int = 42, on: Column | None = None, size: int = BLOCK) -> DataFrame:
    """A hashed piece of low..high samples moved to the front, zeros behind it; tracks not longer than ``low`` stay."""
    span = F.least(F.lit(high), F.col("n")) - F.lit(low) + 1
    applies = (F.col("n") > low) if on is None else (F.col("n") > low) & on
    length = F.when(applies, F.lit(low) + hash_int(f"{seed}|len", F.col("track_id")) % span).otherwise(F.col("n")).cast("long")
    off = F.when(applies, hash_int(f"{seed}|off", F.col("track_id")) % (F.col("n") - length + 1)).otherwise(F.lit(0)).cast("long")

    def moved(source: np.ndarray, first: int, start: int, count: int, n: int, off: float, length: float) -> np.ndarray:
        out, used = np.zeros(count), int(max(0, min(count, length - start)))
        if used:
            at = start + int(off) - first
            out[:used] = source[at : at + used]
        return out

    first = F.greatest(F.col("start") - off, F.lit(0))
    last = F.least(F.col("start") + F.size("samples") - off, length) - 1
    settings = {"off": off.cast("double"), "length": length.cast("double")}
    return _rerouted(blocks, size, first, last, lambda a: a + F.col("_off"), lambda a: a + F.col("_off") + size, moved, settings)


def augment(
    blocks: DataFrame, variants: int, p: float = 0.3, seed: str | int = 42, sr: int = 16000, enabled: bool = True,
    size: int = BLOCK, limit: float | None = 1.0, taps: int | None = None, piece: tuple[int, int] | None = None,
) -> DataFrame:
    """Variants 0..n of each track (0 is the raw one); steps run in a fixed order, each on the variants whose hash falls under ``p``.

    The variant becomes part of the track key (``track#v``). Steps that are off for a variant use neutral settings, so
    each step is one plan for all variants. Order: pitch, stretch, gain, white noise, equaliser, reverb, crop, coloured
    noise, band rejection, bass or treble. ``limit`` is the range to which filters clip, ``taps`` the length of the reverb
    (0.3 s), ``piece`` the lengths of a crop (5 to 30 s). Blocks on a grid ``size`` below ``WORK`` are joined once for all
    steps and cut again.
    """
    if not enabled:
        return blocks
    if size < WORK:
        joined = joined_blocks(blocks, work_size(size))
        return cut_blocks(augment(joined, variants, p, seed, sr, enabled, work_size(size), limit, taps, piece), size)
    variant = F.explode(F.sequence(F.lit(0), F.lit(variants)))
    keyed = blocks.withColumn("_v", variant).select(
        F.concat(F.col("track_id").cast("string"), F.lit("#"), F.col("_v")).alias("track_id"), "start", "samples", "n"
    )
    track = F.col("track_id")
    on = lambda step: ~track.endswith("#0") & (hash_unit(f"{seed}|on|{step}", track) < p)
    draw = lambda step, lo, hi: hash_between(f"{seed}|{step}", lo, hi, track)
    pick = lambda step, lo, hi, off: F.when(on(step), draw(step, lo, hi)).otherwise(F.lit(off))
    level = lambda step, lo, hi: F.when(on(step), draw(f"{step}|db", lo, hi)).otherwise(F.lit(0.0))
    clip = lambda df, step: df if limit is None else map_blocks(df, lambda x, start, n, hit: np.clip(x, -limit, limit) if hit else x, {"hit": on(step).cast("double")})
    out = pitch_shift(keyed, pick("pitch", -2.0, 2.0, 0.0), size)
    out = time_stretch(out, pick("stretch", 0.8, 1.2, 1.0), size)
    # both noise steps read their input twice (level, then samples): materialise it once
    out = add_noise(cut_lineage(gain(out, pick("gain", -6.0, 6.0, 0.0))), draw("white", 20.0, 40.0), seed, on("white"))
    out = clip(equalise(out, sr, draw("eq|f", 200.0, 4000.0), draw("eq|q", 0.5, 2.0), level("eq", -6.0, 6.0), size), "eq")
    out = reverb(out, taps or int(0.3 * sr), pick("reverb", 0.1, 0.4, 0.0), seed, size)
    low, high = piece or (5 * sr, 30 * sr)
    out = cut_lineage(crop(out, low, high, seed, on("crop"), size))
    out = add_coloured_noise(out, draw("colour", 15.0, 35.0), seed, on("colour"))
    out = clip(equalise(out, sr, draw("cut|f", 500.0, 4000.0), draw("cut|q", 1.0, 5.0), level("cut", -12.0, -3.0), size), "cut")
    bass = hash_unit(f"{seed}|side", track) < 0.5
    centre = F.when(bass, draw("bass", 80.0, 300.0)).otherwise(draw("treble", 4000.0, 8000.0))
    return clip(equalise(out, sr, centre, draw("shift|q", 0.5, 1.5), level("shift", -6.0, 6.0), size), "shift")


def sample_rows(blocks: DataFrame) -> DataFrame:
    """Long series (track_id, pos, value, n) of a block table."""
    return blocks.select("track_id", "start", "n", F.posexplode("samples").alias("_i", "value")).select(
        "track_id", (F.col("start") + F.col("_i")).alias("pos"), "value", "n"
    )
