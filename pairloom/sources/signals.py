"""WAV files as a table of blocks, read by ranges, and header-only reads for validation."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.sources import schemas
from pairloom.sources.catalogue import list_files, spread
from pairloom.sources.stores import opens, store_of

BLOCK = 65536
# fixed values: format tags of the file header
INTEGER, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass
class Wave:
    """What the header of a file says; ``data`` is where the samples begin."""

    tag: int
    channels: int
    rate: int
    width: int
    data: int
    size: int

    @property
    def frames(self) -> int:
        return self.size // (self.channels * self.width)


def wave_header(f: BinaryIO) -> Wave:
    """Walks the chunks up to the samples, however far behind they lie; no sample is read."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a WAVE file")
    layout = None
    while len(chunk := f.read(8)) == 8:
        name, size = struct.unpack("<4sI", chunk)
        if name == b"data":
            if layout is None:
                raise ValueError("samples before their format")
            return Wave(*layout, f.tell(), size)
        body = f.read(min(size, 40)) if name == b"fmt " else b""
        if body:
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            tag = struct.unpack("<H", body[24:26])[0] if tag == EXTENSIBLE and len(body) >= 26 else tag
            if tag not in (INTEGER, FLOAT) or not channels or not rate or bits not in (8, 16, 24, 32, 64):
                raise ValueError(f"unknown sample format (tag {tag}, {bits} bits, {channels} channels)")
            layout = (tag, channels, rate, bits // 8)
        f.seek(size + size % 2 - len(body), io.SEEK_CUR)
    raise ValueError("no samples")


def _decoded(found: Wave, raw: bytes) -> np.ndarray:
    raw = raw[: len(raw) - len(raw) % (found.channels * found.width)]
    if found.tag == FLOAT:
        values = np.frombuffer(raw, f"<f{found.width}").astype(np.float64)
    elif found.width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        values = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    elif found.width == 1:
        values = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128.0) / 128.0
    else:
        values = np.frombuffer(raw, f"<i{found.width}") / 2.0 ** (8 * found.width - 1)
    return values.reshape(-1, found.channels).mean(axis=1)


def _block_rows(path: str, starts: list[int], samples: list[np.ndarray], n: int, error: str | None) -> pd.DataFrame:
    return pd.DataFrame({"track_id": path, "start": starts, "samples": [list(x) for x in samples], "n": n, "error": error})


def _read_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row asks for one block of one file: the header is walked, then only the block's bytes are read."""
    for batch in batches:
        for path, start in zip(batch["path"], batch["start"]):
            try:
                system, inside = store_of(path)
                with system.open_input_file(inside) as f:
                    found = wave_header(f)
                    frame = found.channels * found.width
                    f.seek(found.data + start * frame)
                    values = _decoded(found, f.read(min(BLOCK, found.frames - start) * frame))
                yield _block_rows(path, [start], [values], found.frames, None)
            except Exception as problem:  # one bad file never stops the job
                yield _block_rows(path, [0], [np.zeros(0)], 0, f"corrupt ({problem})")


def _decode_contents(sr: int):
    """The same from whole contents that Spark has brought."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                try:
                    found = wave_header(io.BytesIO(bytes(data)))
                    if found.rate != sr:
                        yield _block_rows(path, [0], [np.zeros(0)], 0, f"wrong sample rate ({found.rate} Hz, expected {sr})")
                        continue
                    values = _decoded(found, bytes(data)[found.data : found.data + found.size])
                    values = values if len(values) else np.zeros(sr)
                    starts = list(range(0, len(values), BLOCK))
                    yield _block_rows(path, starts, [values[s : s + BLOCK] for s in starts], len(values), None)
                except Exception as problem:
                    yield _block_rows(path, [0], [np.zeros(0)], 0, f"corrupt ({problem})")

    return run


_BLOCKS = "track_id string, start long, samples array<double>, n long, error string"


def read_signal_blocks(spark: SparkSession, folder: str, sr: int = 16000) -> DataFrame:
    """(track_id, start, samples, n, error): stereo is averaged, an empty file is one second
    of zeros, a wrong rate or unreadable file carries its error and no samples.

    Headers tell the blocks of every file; blocks are dealt over the tasks, which seek to theirs, so a long file
    is read by many tasks. Of a store that only Spark opens, whole contents are decoded.
    """
    if not opens(folder):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
        return files.select("path", "content").mapInPandas(_decode_contents(sr), _BLOCKS)
    heads = read_headers(spark, folder)
    wrong = F.concat(F.lit("wrong sample rate ("), F.col("sample_rate").cast("string"), F.lit(f" Hz, expected {sr})"))
    broken = F.when(F.col("size") == 0, F.lit("corrupt (empty file)")).when(~F.col("readable"), F.concat(F.lit("corrupt ("), "error", F.lit(")")))
    judged = heads.select(
        F.col("path").alias("track_id"), F.rint(F.col("duration") * F.col("sample_rate")).cast("long").alias("n"),
        F.when(broken.isNotNull(), broken).when(F.col("sample_rate") != sr, wrong).alias("error"),
    )
    blank = F.array().cast("array<double>")
    refused = judged.where("error is not null").select("track_id", F.lit(0).cast("long").alias("start"), blank.alias("samples"), F.lit(0).cast("long").alias("n"), "error")
    silent = judged.where("error is null and n = 0").select(
        "track_id", F.lit(0).cast("long").alias("start"), F.array_repeat(F.lit(0.0), sr).alias("samples"), F.lit(sr).cast("long").alias("n"), "error"
    )
    asked = judged.where("error is null and n > 0").select(F.col("track_id").alias("path"), F.explode(F.expr(f"sequence(0L, n - 1, {BLOCK}L)")).alias("start"))
    read = spread(asked, "path", "start").mapInPandas(_read_ranges, _BLOCKS)
    return read.unionAll(silent).unionAll(refused)


def write_signals(blocks: DataFrame, folder: str, sr: int = 16000) -> DataFrame:
    """One mono WAV file of 64-bit floats per track; (track_id, path, n) of the files, which are written as the rows are read.

    Blocks come to a file in order and are written one by one. The name is the track's, so a task that runs again
    writes the same file.
    """
    ordered = blocks.select("track_id", "start", "samples", "n").repartition("track_id").sortWithinPartitions("track_id", "start")
    kind = dict(blocks.dtypes)["track_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = store_of(folder)
        system.create_dir(root, recursive=True)
        held, out, done = None, None, []
        for batch in batches:
            for track, samples, n in zip(batch["track_id"], batch["samples"], batch["n"]):
                if held is None or track != held:
                    if out is not None:
                        out.close()
                    held, name = track, f"{track}.wav"
                    out = system.open_output_stream(f"{root.rstrip('/')}/{name}")
                    size = 8 * int(n)
                    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", min(36 + size, 0xFFFFFFFF), b"WAVE", b"fmt ", 16, FLOAT, 1, sr, sr * 8, 8, 64, b"data", size))
                    done.append((track, f"{folder.rstrip('/')}/{name}", n))
                out.write(np.asarray(samples, "<f8").tobytes())
        if out is not None:
            out.close()
        yield pd.DataFrame(done, columns=["track_id", "path", "n"])

    return ordered.mapInPandas(run, f"track_id {kind}, path string, n long")


def ingest_signals(blocks: DataFrame) -> DataFrame:
    """Long signal table (track_id, pos, value, n) of the readable files."""
    return blocks.where(F.col("error").isNull()).select(
        "track_id", "start", "n", F.posexplode("samples").alias("i", "value")
    ).select("track_id", (F.col("start") + F.col("i")).alias("pos"), "value", "n")


def quarantine(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("error").isNotNull()).select("track_id", "error")


def _parse_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        contents = batch["content"] if "content" in batch else [None] * len(batch)
        for path, size, content in zip(batch["path"], batch["size"], contents):
            row = {
                "path": path, "size": size, "readable": False, "error": None,
                "sample_rate": None, "channels": None, "duration": None,
            }
            try:
                if content is not None:
                    found = wave_header(io.BytesIO(bytes(content)))
                elif size:
                    system, inside = store_of(path)
                    with system.open_input_file(inside) as f:
                        found = wave_header(f)
                else:
                    rows.append(row)
                    continue
                row.update(
                    readable=True, sample_rate=found.rate, channels=found.channels,
                    duration=found.frames / found.rate,
                )
            except Exception as problem:
                row["error"] = str(problem) or type(problem).__name__
            rows.append(row)
        out = pd.DataFrame(rows, columns=[f.name for f in schemas.HEADERS.fields])
        yield out.astype({"sample_rate": "Int32", "channels": "Int32"})


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Header facts per file; tasks open each file and seek from chunk to chunk, contents are not read.

    Of a store that only Spark opens, the headers are walked in the contents.
    """
    if not opens(folder):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
        return files.select("path", F.col("length").alias("size"), "content").mapInPandas(_parse_headers, schemas.HEADERS)
    files = list_files(spark, folder).select("path", F.col("length").alias("size"))
    return spread(files, "path").mapInPandas(_parse_headers, schemas.HEADERS)
