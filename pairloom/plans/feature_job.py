"""Series -> blocks -> windows -> feature vector (430 + 22 = 452 numbers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import descriptors as d
from pairloom.operators import kernels
from pairloom.operators.blocks import block_table, map_windows
from pairloom.operators.spectrum import FRAME, HOP, frame_count, joined_windows, long_spectrum, spectrum, spectrum_frames, window_arrays
from pairloom.operators.windows import chunk_rows
from pairloom.session import cut_lineage

RATE = 16000
WINDOW = 10 * RATE
STRIDE = 5 * RATE
#: windows of rows that are handled at once
ROWS = 1024
# fixed values: the descriptors of either tier in their order
TIER1 = ("cepstrum", "mel", "chroma", "contrast", "tonal", "zcr", "rms")
TIER2 = ("phase", "hnr", "flatness", "rolloff", "novelty", "fourier")
TIER1_SIZE = sum(kernels.SIZES[name] for name in TIER1)
TIER2_SIZE = sum(kernels.SIZES[name] for name in TIER2)


def window_parts(
    series: DataFrame, parts: tuple[str, ...], w: int = WINDOW, s: int = STRIDE, n: int = FRAME, hop: int = HOP, sr: int = RATE,
) -> DataFrame:
    """(track_id, chunk, features): the named descriptors of every window, one after another.

    ``series`` is a block table, or a long one that becomes one. Windows are cut from tiles of blocks and reduced
    to their slots in one task: no sample, frame or bin is a row.
    """
    blocks = block_table(series) if "pos" in series.columns else series

    def make():
        shared: dict = {}
        return lambda samples: kernels.window_slots(samples, n, hop, sr, parts, shared)

    return map_windows(blocks, w, s, make)


def window_vectors(series: DataFrame, tiers: tuple[int, ...] = (1, 2), skip_hnr: bool = False, **settings) -> DataFrame:
    """One row per window with its feature array; ``skip_hnr`` leaves the harmonics-to-noise slot at 0."""
    names = (TIER1 if 1 in tiers else ()) + (TIER2 if 2 in tiers else ())
    return window_parts(series, tuple("no_hnr" if skip_hnr and name == "hnr" else name for name in names), **settings)


def slot_rows(vectors: DataFrame) -> DataFrame:
    """Long feature table (track_id, chunk, slot, value)."""
    return vectors.select("track_id", "chunk", F.posexplode("features").alias("slot", "value"))


def tier1_parts(
    chunks: DataFrame, mel: DataFrame, chroma: DataFrame, spec: DataFrame, w: int, n: int, hop: int, sr: int
) -> list[tuple[DataFrame, int]]:
    return [
        (d.cepstrum_features(mel, frame_count(w, hop)), 120),
        (d.pool_mean_std(mel, d.N_MELS), 256),
        (d.pool_mean_std(chroma, d.N_PITCH), 24),
        (d.pool_mean_std(d.spectral_contrast(spec, n, sr), d.CONTRAST_BANDS + 1), 14),
        (d.pool_mean_std(d.tonal_centroid(chroma), 6), 12),
        (d.pool_mean_std(d.zero_crossing(chunks, w, n, hop), 1), 2),
        (d.pool_mean_std(d.rms(chunks, w, n, hop), 1), 2),
    ]


def tier2_parts(
    chunks: DataFrame, chroma: DataFrame, compact: DataFrame, spec: DataFrame, w: int, n: int, hop: int, sr: int
) -> list[tuple[DataFrame, int]]:
    count = frame_count(w, hop)
    return [
        (d.phase_summary(spec, count), 7),
        (d.hnr_slot(chunks), 1),
        (d.pool_mean_std(d.flatness(spec), 1), 2),
        (d.rolloff_ratio(spec, n, sr), 1),
        (d.ssm_novelty(chroma, count), 1),
        (d.fourier_artifacts(compact, n, count), 10),
    ]


def window_vectors_by_join(
    series: DataFrame, w: int, s: int, n: int, hop: int, sr: int, path: str | None = None
) -> DataFrame:
    """The vectors of ``window_vectors(skip_hnr=True)`` from rows of samples, for short windows.

    Samples are gathered to windows by an aggregate; ``path`` "join" also makes both spectra by a join with a basis and sums.
    One exchange of samples, then a window is one row.
    """
    chunks = chunk_rows(series, w, s)
    windows = joined_windows(chunks, w, n, hop) if path == "join" else window_arrays(chunks)
    parts = tuple("no_hnr" if name == "hnr" else name for name in TIER1 + TIER2)
    shape = (-1, frame_count(w, hop), n // 2 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared: dict = {}
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                numbers = lambda column: column.flatten().to_numpy(zero_copy_only=False)
                spectra = {}
                for ends in batch.schema.names[3:]:
                    re, im = (numbers(part[ends].field(kind)).reshape(shape) for kind in ("re", "im"))
                    spectra[ends] = (re + 0.0) + 1j * (im + 0.0)
                rows = kernels.window_slots(numbers(part["samples"]).reshape(-1, w), n, hop, sr, parts, shared, spectra)
                made = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([part["track_id"], part["chunk"], made], ["track_id", "chunk", "features"])

    types = dict(windows.dtypes)
    return windows.mapInArrow(run, f"track_id {types['track_id']}, chunk {types['chunk']}, features array<double>")


def window_vectors_by_rows(
    series: DataFrame, w: int, s: int, n: int, hop: int, sr: int, path: str | None = None
) -> DataFrame:
    """The vectors of ``window_vectors(skip_hnr=True)`` with samples, bins and bands as rows: the definitions of the descriptors.

    For few and short windows, as a check of the kernels: a window of 64 samples becomes thousands of rows. Windows and
    spectra are read by every descriptor, so they are checkpointed; ``path`` "join" also makes the spectra by a join with a basis.
    """
    chunks = cut_lineage(chunk_rows(series, w, s).repartition("track_id", "chunk"))
    if path == "join":
        compact = spec = cut_lineage(spectrum(chunks, w, n, hop, path))
        reflected = spectrum(chunks, w, n, hop, path, "reflect")
    else:
        compact = cut_lineage(spectrum_frames(chunks, w, n, hop))
        spec, reflected = long_spectrum(compact), spectrum_frames(chunks, w, n, hop, "reflect")
    mel = cut_lineage(d.mel_bands(reflected, n, sr))
    chroma = cut_lineage(d.chroma(compact, n, sr))
    parts = tier1_parts(chunks, mel, chroma, spec, w, n, hop, sr) + tier2_parts(chunks, chroma, compact, spec, w, n, hop, sr)
    return d.assemble(d.place(*parts), sum(size for _, size in parts))
