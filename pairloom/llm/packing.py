"""Packing of tokenised lyrics into training sequences by the sum-of-squares rule."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.storage import bounded_batches

#: tokens of a sequence, id that ends a text, tokens that may lie in open sequences of one task
LENGTH, END_ID, OPEN_TOKENS = 2048, 1, 4_000_000
SCHEMA = "track_id long, start long, length long, ids_crc32 long, track_tokens long, sequence_id long, offset long"


def byte_bpe(ranks_file: str, pattern: str, specials: dict[str, int]) -> Callable[[str], np.ndarray]:
    """Ids of a byte-level BPE as the ``tokenizers`` library gives them, by its table of ranks.

    The look-ahead of the split pattern only matters in runs of white space; texts without such runs
    take the same pattern without it, which the regex engine runs much faster.
    """
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    exact = tiktoken.Encoding("exact", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
    plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens=specials)
    runs = re.compile(r"\s\s")

    def encode(text: str) -> np.ndarray:
        coder = exact if runs.search(text) else plain
        return np.asarray(coder.encode_to_numpy(text, allowed_special="all"), np.uint32)

    return encode


def public_byte_bpe() -> Callable[[str], np.ndarray]:
    """The byte-level BPE of 50,257 ids; its file lies where the ``public_tokenizers`` package says."""
    import public_tokenizers

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


class LevelPacker:
    """Online packing with a level array: counts[h] sequences are filled up to h tokens.

    A text's full sequences are cut off first. The rest of s tokens goes to the level h <= length - s
    for which the sum of squared counts becomes smallest (h = 0 opens a sequence), ties to the
    fullest. ``close`` cuts what is left open: pieces move into a row of full sequences, and the
    final rest becomes sequences whose lengths are powers of two, so that nothing is padded.
    """

    def __init__(self, first_sequence: int, length: int = LENGTH, open_tokens: int = OPEN_TOKENS) -> None:
        self.length, self.open_tokens, self.next_id, self.held = length, open_tokens, first_sequence, 0
        self.counts = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.out: list[tuple] = []

    def add(self, track: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.length
        for start in range(0, whole, self.length):
            self._emit([(track, start, ids[start : start + self.length], len(ids))])
        if whole < len(ids):
            self._place((track, whole, ids[whole:], len(ids)))
        if self.held > self.open_tokens:
            self.close()

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        room = self.length - size
        change = 2 * self.counts[size : self.length + 1] - 2 * self.counts[: room + 1] + 2
        change[0] = 2 * self.counts[size] + 1
        change[room] = -2 * self.counts[room] + 1 if room else change[0]
        free = np.flatnonzero((self.counts[: room + 1] > 0) | (np.arange(room + 1) == 0))
        level = int(free[::-1][np.argmin(change[free][::-1])])
        window = self.open[level].pop() if level else []
        self.counts[level] -= level > 0
        window.append(piece)
        if level + size == self.length:
            self.held -= level
            self._emit(window)
        else:
            self.held += size
            self.counts[level + size] += 1
            self.open.setdefault(level + size, []).append(window)

    def close(self) -> None:
        window, filled = [], 0
        for level in sorted(self.open, reverse=True):
            for pieces in self.open[level]:
                for track, start, ids, total in pieces:
                    while len(ids):
                        take = min(len(ids), self.length - filled)
                        window.append((track, start, ids[:take], total))
                        start, ids, filled = start + take, ids[take:], filled + take
                        if filled == self.length:
                            self._emit(window)
                            window, filled = [], 0
        while filled:
            size, part = 1 << (filled.bit_length() - 1), []
            filled -= size
            while size:
                track, start, ids, total = window.pop(0)
                take = min(len(ids), size)
                part.append((track, start, ids[:take], total))
                size -= take
                if take < len(ids):
                    window.insert(0, (track, start + take, ids[take:], total))
            self._emit(part)
        self.open, self.held = {}, 0
        self.counts[:] = 0

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for track, start, ids, total in pieces:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
            self.out.append((track, start, len(ids), crc, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def taken(self) -> pa.RecordBatch:
        names = [column.split()[0] for column in SCHEMA.split(", ")]
        columns = list(zip(*self.out)) or [()] * len(names)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack_tracks(
    tracks: DataFrame, text: str = "lyrics", tokenizer: Callable = public_byte_bpe,
    length: int = LENGTH, end_id: int = END_ID, open_tokens: int = OPEN_TOKENS,
) -> DataFrame:
    """One row per piece: where a piece of a track's ids lies in which sequence.

    ``tokenizer`` is called once in every task and gives a function from a text to ids. Every partition
    is packed on its own, so nothing is shuffled; a sequence's number holds the partition's, so
    a task that runs again gives the same rows for the same input. Memory is bounded by
    ``open_tokens``: beyond it the open sequences are closed, as at the end. A null text is empty
    and has the end id only. Rows without track_id and repeated rows are packed like others.
    """
    bounded_batches(tracks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer()
        packer = LevelPacker(TaskContext.get().partitionId() << 33, length, open_tokens)
        for batch in batches:
            for k, (track, words) in enumerate(zip(batch.column(0), batch.column(1))):
                packer.add(track.as_py(), np.append(encode(words.as_py() or ""), np.uint32(end_id)))
                if k % 512 == 511:
                    yield packer.taken()
            yield packer.taken()
        packer.close()
        yield packer.taken()

    return tracks.select(F.col("track_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
