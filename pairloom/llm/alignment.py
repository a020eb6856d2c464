"""Alignment of two tokenizers over lyrics, with corpus-wide counts of the id pairs that overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.packing import byte_bpe
from pairloom.llm.storage import Scratch, bounded_batches, stored

#: bytes of text whose links are coded together, id pairs in a row
BLOCK_BYTES, PART_PAIRS = 4 << 20, 8192
#: one-to-one tokens after which windows are compared
NEAR = 8
NUMBERS = ("track_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
SCHEMA = ", ".join(f"{c} long" for c in NUMBERS) + ", groups string"


@dataclass
class Tokenizer:
    """``encode`` gives a text's ids, ``entries`` the bytes of every id."""

    encode: Callable[[str], list[int]]
    entries: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(e) for e in self.entries], np.int64)


def public_tokenizer_pair() -> tuple[Tokenizer, Tokenizer]:
    """The byte-level BPE of 50 257 ids, given a space before the text, and the piece BPE of 32 000, which adds one.

    Their files lie where the ``public_tokenizers`` package says. Special tokens are plain text.
    """
    import base64

    import public_tokenizers
    import sentencepiece

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = byte_bpe(ranks, public_tokenizers.PATTERN, {})
    with open(ranks, "rb") as lines:
        entry = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(k: int) -> bytes:
        name = pieces.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if pieces.is_byte(k) else name.replace("▁", " ").encode()

    return (
        Tokenizer(lambda text: coder(" " + text).tolist(), [entry.get(k, b"") for k in range(max(entry) + 1)]),
        Tokenizer(lambda text: pieces.encode(text, num_threads=1), [piece(k) for k in range(pieces.get_piece_size())]),
    )


def aligned(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Tokens before each group's end on either side.

    While both end arrays agree at the current shift between their indices, tokens are one to one. After ``NEAR`` of
    them, windows of doubling length are compared, and the first disagreement is closed in on by halving down to that
    length. An irregular group is walked token by token to the next common end, which gives the new shift.
    """
    upto_a, upto_b = [], []
    i = j = run = 0
    n = len(ends_a)
    while i < n:
        x, y = ends_a[i], ends_b[j]
        if x == y:
            run += 1
        else:
            run = 0
            while x != y:
                if x < y:
                    i += 1
                    x = ends_a[i]
                else:
                    j += 1
                    y = ends_b[j]
        i += 1
        j += 1
        upto_a.append(i)
        upto_b.append(j)
        if run == NEAR:
            first, step, grows = i, NEAR, True
            while step >= NEAR and i < n:
                if ends_a[i : i + step] == ends_b[j : j + step]:
                    i, j = min(i + step, n), j + step
                else:
                    grows = False
                step = step * 2 if grows else step // 2
            upto_a += range(first + 1, i + 1)
            upto_b += range(j - (i - first) + 1, j + 1) if i < n else range(len(ends_b) - (i - first) + 1, len(ends_b) + 1)
            run = 0
    return upto_a, upto_b


def linked_tokens(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked tokens of either side: between neighbouring ends of both lies one link."""
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class GroupsText:
    """Groups as ``a1,a2|b1;a3|b2,b3``: decimal ids in order, each id's text with its sign made once."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.texts = [f"{k}{sign}" for k in range(n_a) for sign in ",|"] + [f"{k}{sign}" for k in range(n_b) for sign in ",;"]
        self.first_b = 2 * n_a

    def __call__(self, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> str:
        codes = np.empty(len(a) + len(b), np.int64)
        for ids, upto, other, base in ((a, upto_a, np.r_[0, upto_b[:-1]], 0), (b, upto_b, upto_a, self.first_b)):
            last = np.zeros(len(ids), np.int64)
            last[upto - 1] = 1
            # a token stands behind its own side's tokens and those of the other side's groups before it
            codes[np.arange(len(ids)) + other[np.cumsum(last) - last]] = base + 2 * ids + last
        texts = self.texts
        return "".join([texts[k] for k in codes.tolist()])[:-1]


def _coded(tokenizers: Callable, finish: Callable[[str], str] | None, block_bytes: int):
    """Per text its numbers and the coded pairs of its links; per block of texts its pairs in rows of ``PART_PAIRS``."""
    names = ["block", "track_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "first", "part"]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.int64(), pa.binary()]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one, other = tokenizers()
        groups_text = GroupsText(len(one.entries), len(other.entries))
        block, size, pack = TaskContext.get().partitionId() << 33, 0, zstandard.ZstdCompressor(level=3).compress
        held: list[tuple] = []

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, block
            pairs, times = np.unique(np.concatenate([np.empty(0, np.int64), *(h[1] for h in held)]), return_counts=True)
            for at in range(0, len(held), 256):
                out = []
                for row, linked in held[at : at + 256]:
                    code, n = np.unique(np.searchsorted(pairs, linked), return_counts=True)
                    coded = np.stack([np.diff(code, prepend=0), n]).astype(np.uint32)
                    out.append((block, *row, pack(coded.tobytes()), None, None))
                yield rows(out)
            for at in range(0, len(pairs), PART_PAIRS):
                part = np.stack([pairs[at : at + PART_PAIRS], times[at : at + PART_PAIRS]])
                yield rows([(block, *(None,) * 7, at, part.tobytes())])
            held, size, block = [], 0, block + 1

        for batch in batches:
            for track, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                a, b = (one.encode(text), other.encode(text)) if text else ([], [])
                whole = b" " + text.encode()
                if any(b"".join(map(t.entries.__getitem__, ids)) != whole for t, ids in ((one, a), (other, b))):
                    a, b = [], []
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                ends_a, ends_b = np.cumsum(one.sizes[a]), np.cumsum(other.sizes[b])
                upto_a, upto_b = (np.array(u, np.int64) for u in aligned(ends_a.tolist(), ends_b.tolist()))
                link_a, link_b = linked_tokens(ends_a, ends_b)
                groups = groups_text(a, b, upto_a, upto_b) if len(a) else ""
                linked = a[link_a] << 32 | b[link_b]
                held.append(((track.as_py(), len(a), len(b), len(upto_a), len(linked), finish(groups) if finish else groups), linked))
                size += len(whole)
                if size > block_bytes:
                    yield from closed()
        yield from closed()

    return run, "block long, track_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, first long, part binary"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, first, part in zip(*(c.to_pylist() for c in batch.columns)):
            pair, times = np.frombuffer(part, np.int64).reshape(2, -1)
            columns = [np.full(len(pair), block), np.arange(first, first + len(pair)), pair, times]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "code", "pair", "times"])


def _summed(texts: pa.Table, counts: pa.Table) -> pa.Table:
    count, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, bool)
    code = counts.column("code").to_numpy()
    count[code], best[code] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    opened, sums = zstandard.ZstdDecompressor(), []
    for packed in texts.column("links"):
        step, n = np.frombuffer(opened.decompress(packed.as_py()), np.uint32).reshape(2, -1).astype(np.int64)
        at = np.cumsum(step)
        sums.append((int(n[best[at]].sum()), int(n @ count[at])))
    columns = [*(texts.column(c) for c in NUMBERS[:5]), *(pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)), texts.column("groups")]
    return pa.table(columns, [*NUMBERS, "groups"])


def token_alignments(
    tracks: DataFrame, text: str = "lyrics", tokenizers: Callable = public_tokenizer_pair,
    finish: Callable[[str], str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(track_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every track's whole ``text``.

    ``tokenizers`` is called once in every task and gives tokenizers A and B. Where both end at one byte, tokens are
    cut into groups; a link is a token of A and one of B whose bytes overlap. An id pair counts as often as it is
    linked in all tracks: ``count_sum`` adds the counts of a track's links, ``n_best`` counts its links whose pair
    is the commonest of its B id, ties included. ``groups`` lists the groups (``GroupsText``), or what
    ``finish`` makes of that in the task, so that it need not move. Null and empty texts, and those whose bytes a tokenizer
    changes, have no tokens: zeros and an empty list. Rows without track_id and repeated rows stay and count; other
    columns are ignored.

    Texts are tokenised once. A block of about ``block_bytes`` of texts codes its distinct pairs; only these meet
    the corpus counts, and go back to their block.
    """
    spark = tracks.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    run, schema = _coded(tokenizers, finish, block_bytes)
    coded = scratch.keep(tracks.select(F.col("track_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, schema))
    pairs = coded.where("part is not null").select("block", "first", "part").mapInArrow(_pairs, "block long, code long, pair long, times long")
    totals = scratch.keep(pairs.groupBy("pair").agg(F.sum("times").alias("count"), F.max(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b")))
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    scored = totals.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    counts = pairs.drop("times").join(scored, "pair").select("block", "code", "count", "best")
    texts = coded.where("part is null").drop("first", "part")
    out = stored(texts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_summed, SCHEMA))
    scratch.drop()
    return out
