"""Removal of long repeated strings from lyrics by longest previous factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.storage import bounded_batches, stored

#: bytes of a repeated string, bytes of the gram that names a window, window starts handled at once
MATCH, GRAM, CHUNK = 100, 24, 1 << 20
#: different segments of one gram that are put in suffix order together; window rows of one suffix array
LARGE, ARRAY_ROWS = 2048, 200_000
_RND = np.random.default_rng(29)
_VALUE = _RND.integers(0, 1 << 63, 256).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SIZE = CHUNK + MATCH
_POWER = np.cumprod(np.r_[np.uint64(1), np.full(_SIZE, _BASE, np.uint64)])
_INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(_SIZE, pow(_BASE, -1, 1 << 64), np.uint64)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def segments(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gram, content, first window, windows): the windows of a text, split into runs that share their gram.

    A window of ``MATCH`` bytes is named by the leftmost of its ``GRAM``-byte grams with the smallest hash, so equal
    windows have equal names wherever they lie. ``content`` hashes all bytes of a run.
    """
    for base in range(0, len(text) - MATCH + 1, CHUNK):
        raw = np.frombuffer(text, np.uint8, min(CHUNK + MATCH - 1, len(text) - base), base)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * _POWER[: len(raw)])])
        least = _mixed((sums[GRAM:] - sums[:-GRAM]) * _INVERSE[: len(raw) - GRAM + 1])
        grams, at, width = least, np.arange(len(least)), 1
        grams_of_window = MATCH - GRAM + 1
        while width < grams_of_window:
            shift = min(width, grams_of_window - width)
            right = least[shift:] < least[:-shift]
            least = np.where(right, least[shift:], least[:-shift])
            at = np.where(right, at[shift:], at[:-shift])
            width += shift
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[first, len(at)])
        last = first + count + MATCH - 1
        content = _mixed((sums[last] - sums[first]) * _INVERSE[first])
        yield grams[at[first]].view(np.int64), content.view(np.int64), first + base, count


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def taken() -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    for batch in batches:
        for text in batch.column(1):
            for gram, *_ in segments(text.as_py() or b""):
                held.append(gram)
                size += len(gram)
            if size > 500_000:
                yield taken()
                size = 0
    yield taken()


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def taken() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)] or [np.empty(0, np.int64)] * 5
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "content", "first", "windows", "track_id"])

    for batch in batches:
        for track, text in zip(batch.column(0), batch.column(1)):
            for part in segments(text.as_py() or b""):
                held.append((*part, np.full(len(part[0]), track.as_py(), np.int64)))
                size += len(part[0])
            if size > 200_000:
                yield taken()
                size = 0
    yield taken()


def longest_previous_factors(windows: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The window's length where it also lies at a smaller position, 0 where its longest earlier match is shorter.

    Windows are put in suffix order; of all earlier windows the longest match is with the previous or
    the next one in that order whose position is smaller. These are found by jumping over larger positions
    as long as the match stays complete.
    """
    width = windows.shape[1]
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{width}").ravel(), kind="stable")
    rows, pos = np.ascontiguousarray(windows[order]).view(f"S{width}").ravel(), position[order]
    common = np.where(rows[1:] == rows[:-1], width, 0)

    def nearest_smaller(pos: np.ndarray, common: np.ndarray) -> np.ndarray:
        near, match = np.arange(len(pos)) - 1, np.r_[0, common]
        while True:
            on = np.flatnonzero((near >= 0) & (match >= width) & (pos[near] >= pos))
            if not len(on):
                return np.where(near >= 0, match, 0)
            over = near[on]
            match[on] = np.where(near[over] >= 0, np.minimum(match[on], match[over]), 0)
            near[on] = near[over]

    factors = np.empty(len(pos), np.int64)
    factors[order] = np.maximum(nearest_smaller(pos, common), nearest_smaller(pos[::-1], common[::-1])[::-1])
    return factors


def _windows(raw: bytes, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), MATCH)[:n]


def _repeated_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram; suffix arrays take whole grams."""
    held: list[tuple] = []
    size = 0

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        out = ([], [], [])
        if rows:
            windows = np.concatenate([_windows(raw, n) for _, _, _, n, raw in rows])
            number = np.unique([t for _, t, *_ in rows], return_inverse=True)[1]  # tracks in order, places within
            position = np.concatenate([(k << 40) + np.arange(f, f + n) for k, (_, _, f, n, _) in zip(number.tolist(), rows)])
            gone = longest_previous_factors(windows, position) >= MATCH
            at = 0
            for _, track, first, n, _ in rows:
                hit = np.flatnonzero(np.diff(np.r_[False, gone[at : at + n], False].astype(np.int8)))
                at += n
                for a, b in hit.reshape(-1, 2).tolist():
                    for column, value in zip(out, (track, first + a, first + b - 1 + MATCH)):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["track_id", "start", "stop"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > ARRAY_ROWS and row[0] != held[-1][0]:
                yield spans(held)
                held, size = [], 0
            held.append(row)
            size += row[3]
    yield spans(held)


def _content(raw: bytes) -> int:
    """The hash of a run's bytes, as in ``segments``."""
    values = _VALUE[np.frombuffer(raw, np.uint8)]
    total = sum(((values[k : k + _SIZE] * _POWER[: len(values[k : k + _SIZE])]).sum(dtype=np.uint64) * _POWER[k] for k in range(0, len(values), _SIZE)), np.uint64(0))
    return int(_mixed(np.array([total], np.uint64)).view(np.int64)[0])


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs; where an id has several texts, only of those that hold the run at its place."""
    names = ["large", "gram", "track_id", "first", "windows", "raw"]
    kinds = (pa.bool_(), *(pa.int64(),) * 4, pa.binary())
    opened = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for track, packed, wanted, several in zip(*batch.columns):
            text = opened.decompress(packed.as_py())
            for w in wanted.as_py():
                first, n = w["first"], w["windows"]
                raw = text[first : first + n - 1 + MATCH]
                if several.as_py() and (len(raw) < n - 1 + MATCH or _content(raw) != w["content"]):
                    continue
                out.append((w["large"], w["gram"], track.as_py(), first, n, raw))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        columns = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("track_id", "first", "windows", "raw")]
        for track, first, n, raw in zip(*columns):
            digests = [xxhash.xxh3_128_digest(raw[k : k + MATCH]) for k in range(n)]
            arrays = [pa.array(digests, pa.binary()), pa.array([track] * n, pa.int64()), pa.array(range(first, first + n), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "track_id", "at"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([packer.compress(t.as_py() or b"") for t in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["track_id", "packed"])


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(track_id, start, stop) byte spans of ``rows`` (track_id, text as binary) that also start earlier; they may overlap.

    1. Grams that name a window in more than one run are found from counts summed in the tasks.
    2. Runs of equal bytes (equal gram, length and 64-bit hash) keep their earliest place, all others are removed whole.
    3. Among the different runs of one gram, suffix arrays give the previous factors of all windows. A gram
       with more than ``LARGE`` different runs is dealt by window instead, whose earliest place is an aggregate.
    """
    named = rows.where("track_id is not null")
    grams = named.mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = stored(grams.where("n > 1").select("gram"))
    runs = named.mapInArrow(_segment_rows, "gram long, content long, first long, windows long, track_id long")
    runs = stored(runs.join(grams, "gram"))
    earliest = F.min(F.struct("track_id", "first")).alias("kept")
    kept = stored(runs.groupBy("gram", "content", "windows").agg(earliest, F.count(F.lit(1)).alias("n")))
    places = kept.where("n > 1").select("gram", "content", "windows", F.col("kept.track_id").alias("t"), F.col("kept.first").alias("f"))
    copies = runs.join(stored(places), ["gram", "content", "windows"]).where((F.col("track_id") != F.col("t")) | (F.col("first") != F.col("f")))
    whole = copies.select("track_id", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (MATCH - 1)).alias("stop"))
    mixed = stored(kept.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", (F.col("n") > LARGE).alias("large")))
    wanted = kept.select("gram", "content", "windows", "kept.*").join(mixed, "gram").groupBy("track_id").agg(F.collect_list(F.struct("large", "gram", "first", "windows", "content")).alias("wanted"))
    texts = named.select("track_id", F.xxhash64("text").alias("h")).groupBy("track_id").agg((F.min("h") != F.max("h")).alias("several"))
    wanted = wanted.join(texts, "track_id")
    packed = named.mapInArrow(_packed, "track_id long, packed binary")
    cut = packed.join(wanted, "track_id").select("track_id", "packed", "wanted", "several")
    cut = stored(cut.mapInArrow(_cut_segments, "large boolean, gram long, track_id long, first long, windows long, raw binary"))
    dealt = cut.where("not large").select("gram", "track_id", "first", "windows", "raw").repartition("gram").sortWithinPartitions("gram")
    partly = dealt.mapInArrow(_repeated_spans, "track_id long, start long, stop long")
    windows = cut.where("large").mapInArrow(_window_rows, "digest binary, track_id long, at long")
    windows = stored(windows)
    firsts = stored(windows.groupBy("digest").agg(F.min(F.struct("track_id", "at")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "m.track_id", "m.at").toDF("digest", "t", "a"))
    again = windows.join(firsts, "digest").where((F.col("track_id") != F.col("t")) | (F.col("at") != F.col("a")))
    again = again.select("track_id", F.col("at").alias("start"), (F.col("at") + MATCH).alias("stop"))
    return whole.unionAll(partly).unionAll(again)


def without_repeats(tracks: DataFrame, text: str = "lyrics") -> DataFrame:
    """(track_id, n_bytes, spans, kept): every track with the bytes that stay.

    A byte goes if a string of ``MATCH`` bytes that covers it also starts earlier: in a track with a
    smaller id, or before in the same track. Strings are judged on the input, matches do not cross tracks.
    ``spans`` are the maximal removed runs (start, stop), ``kept`` the other bytes. A null text is empty. Rows
    without track_id take no part and stay whole. Rows that share an id count as one track: equal places
    are no earlier ones, and spans are pooled, also of texts that differ; a span ends where a text does.
    """
    bounded_batches(tracks.sparkSession)
    rows = tracks.select(F.col("track_id").cast("long"), F.col(text).cast("binary").alias("text"))
    by_track = repeated_spans(rows).groupBy("track_id").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    joined = rows.mapInArrow(_packed, "track_id long, packed binary").join(by_track, "track_id", "left").select("track_id", "packed", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, sizes, spans, kept = batch.slice(at, 500), [], [], []
                for packed, found in zip(part.column(1), part.column(2)):
                    raw, runs = opened.decompress(packed.as_py()), []
                    for start, stop in sorted((s["start"], min(s["stop"], len(raw))) for s in found.as_py() or ()):
                        if runs and start <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], stop)
                        elif start < stop:
                            runs.append([start, stop])
                    ends = [0, *(x for run in runs for x in run), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])))
                    sizes.append(len(raw))
                    spans.append([{"start": a, "stop": b} for a, b in runs])
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["track_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, "track_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
