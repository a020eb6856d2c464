"""Series as blocks of samples, and windows cut from them.

A block table has (track_id, start, samples, n): ``samples`` are the values from position ``start`` on, ``n`` is the length of
the track. Blocks may have any length and need not be equally long; they do not overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.windows import window_count

#: samples of a block and, at least, of a tile of windows
BLOCK = 65536
#: samples of windows that are handled at once, at least
TOGETHER = 1 << 17


def block_table(series: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of a long series (track_id, pos, value, n): the only step in which a sample is a row."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value"))).getField("value")
    grouped = series.groupBy("track_id", F.floor(F.col("pos") / size).alias("_b")).agg(ordered.alias("samples"), F.first("n").alias("n"))
    return grouped.select("track_id", (F.col("_b") * size).alias("start"), "samples", "n")


def tile_width(w: int, s: int) -> int:
    """Windows of a tile: neighbours that are cut from one array of about ``BLOCK`` samples or twice a window."""
    return max(0, (max(BLOCK, 2 * w) - w) // s) + 1


def tiles(blocks: DataFrame, w: int, s: int) -> DataFrame:
    """(track_id, tile, n, parts): what a tile of windows needs, as slices of blocks.

    A block sends every tile the samples that lie in it: itself and, where windows overlap a tile's end, the
    head of the next. One shuffle on (track, tile), groups of a bounded number of samples.
    """
    g = tile_width(w, s)
    stride, span = g * s, (g - 1) * s + w
    last = F.ceil(window_count(F.col("n"), w, s) / F.lit(g)) - 1
    stop = F.col("start") + F.size("samples")
    low = F.greatest(F.lit(0), F.ceil((F.col("start") - span + 1) / F.lit(stride)))
    # the last block also opens tiles that lie behind it
    high = F.when(stop >= F.col("n"), last).otherwise(F.least(last, F.floor((stop - 1) / F.lit(stride))))
    spread = blocks.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).where("_low <= _high")
    spread = spread.withColumn("tile", F.explode(F.sequence("_low", "_high")))
    begin = F.greatest(F.col("start"), F.col("tile") * stride)
    end = F.least(stop, F.col("tile") * stride + span)
    piece = F.slice("samples", (begin - F.col("start") + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
    part = F.struct((begin - F.col("tile") * stride).alias("at"), piece.alias("samples"))
    return spread.select("track_id", "tile", "n", part.alias("_p")).groupBy("track_id", "tile").agg(F.first("n").alias("n"), F.collect_list("_p").alias("parts"))


def tile_windows(batches: Iterator[pa.RecordBatch], w: int, s: int, g: int) -> Iterator[tuple[list, pa.DataType, np.ndarray, np.ndarray]]:
    """(tracks, their type, chunks, windows x w) of rows of ``tiles`` of g windows, small tiles together up to ``TOGETHER`` samples."""
    tracks, chunks, held, size = [], [], [], 0
    for batch in batches:
        track, tile, n, parts = batch.columns
        ends, cut = parts.offsets.to_pylist(), parts.values
        places, inside = cut.field("at").to_pylist(), cut.field("samples").offsets.to_pylist()
        values = cut.field("samples").values.to_numpy(zero_copy_only=False)
        for k, (name, at, length) in enumerate(zip(track.to_pylist(), tile.to_pylist(), n.to_pylist())):
            first = at * g
            total = 1 if length <= w else -(-(length - w) // s) + 1
            here = min(g, total - first)
            x = np.zeros((here - 1) * s + w)
            for i in range(ends[k], ends[k + 1]):
                piece = values[inside[i] : inside[i + 1]][: max(0, len(x) - places[i])]
                x[places[i] : places[i] + len(piece)] = piece
            tracks += [name] * here
            chunks.append(np.arange(first, first + here, dtype=np.int32))
            held.append(np.lib.stride_tricks.sliding_window_view(x, w)[::s])
            size += here * w
            if size >= TOGETHER:
                yield tracks, track.type, np.concatenate(chunks), held[0] if len(held) == 1 else np.concatenate(held)
                tracks, chunks, held, size = [], [], [], 0
        if held:
            yield tracks, track.type, np.concatenate(chunks), held[0] if len(held) == 1 else np.concatenate(held)
            tracks, chunks, held, size = [], [], [], 0


def map_windows(
    blocks: DataFrame, w: int, s: int, make: Callable[[], Callable[[np.ndarray], np.ndarray]], name: str = "features",
) -> DataFrame:
    """(track_id, chunk, name): ``make()``, called once per task, gives a function from windows (windows x w) to rows of numbers.

    Windows are those of ``chunk_rows``: w samples every s, zeros beyond the end of the track. The function gets windows of
    several tracks at a time.
    """

    g = tile_width(w, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for tracks, kind, chunks, windows in tile_windows(batches, w, s, g):
            rows = function(windows)
            made = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(tracks, kind), pa.array(chunks), made], ["track_id", "chunk", name])

    kind = dict(blocks.dtypes)["track_id"]
    return tiles(blocks, w, s).mapInArrow(run, f"track_id {kind}, chunk int, {name} array<double>")
