"""Near-duplicate lyrics by SimHash, matched through segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.graph import connected_components
from pairloom.llm.storage import bounded_batches, stored

#: words in a shingle, differing bits of a link, seed of the shingle hash
WORDS, RADIUS, SEED = 3, 2, 42
#: members of a cell that are compared directly; a larger cell is split exactly
CELL_ROWS = 512
#: splits of a large cell; after the last one at most 2**13 fingerprints agree on the fixed bits
LEVELS = 4
#: the low bit of every 2-bit segment of a half
LOW_BITS = 0x55555555


def fingerprint(text: bytes | None) -> int:
    """Majority bits of the hashed 3-word shingles; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[WORDS - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return majority_bits(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(stops)))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, repeats included."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(text.as_py()) for text in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints, pa.int64())], ["track_id", "text_key", "fp"])


def fingerprints(tracks: DataFrame, text: str = "lyrics") -> DataFrame:
    """(track_id, text_key, fp): a 64-bit fingerprint of every whole text; text_key is a hash of its bytes."""
    rows = tracks.select(F.col("track_id").cast("long"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "track_id long, text_key long, fp long")


def _bits(mask: int) -> Column:
    """An unsigned 64-bit mask as a signed constant."""
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def grid_cells(prints: DataFrame) -> DataFrame:
    """(cell, fp): the unit-grid cells in which a fingerprint meets all others within 2 bits.

    A fingerprint is embedded as the bit counts of its 32 two-bit segments; the Manhattan
    distance of two embeddings never exceeds their Hamming distance. Within distance 2, one half
    of the segments is within distance 1: the counts of that half are equal, or differ by one
    in one segment. Every fingerprint lies in its own cell of either half; of two neighbouring
    cells one has an even total, and only its fingerprints visit the cells around them.
    """
    halves = F.explode(
        F.array(
            F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(_bits(0xFFFFFFFF)).alias("bits")),
            F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("bits")),
        )
    )
    counts = F.col("h.bits") - F.shiftright("h.bits", 1).bitwiseAND(_bits(LOW_BITS))
    at = prints.select("fp", halves.alias("h")).select("fp", "h.half", "h.bits", counts.alias("own"))
    segment = "(shiftright(own, 2 * d) & 3)"
    around = F.expr(
        f"""filter(flatten(transform(sequence(0, 15), d -> array(
            if({segment} < 2, own + shiftleft(1L, 2 * d), null),
            if({segment} > 0, own - shiftleft(1L, 2 * d), null)))), x -> x is not null)"""
    )
    own = F.array(F.col("own"))
    cells = F.explode(F.when(F.bit_count("bits") % 2 == 0, F.concat(own, around)).otherwise(own))
    return at.select("fp", "half", cells.alias("at")).select(
        (F.col("half").cast("long") * F.lit(1 << 32) + F.col("at")).alias("cell"), "fp"
    )


def split_cells(cells: DataFrame, level: int) -> DataFrame:
    """Cells split by exact bits: of three bit classes one has no difference within distance 2.

    The classes are the base-3 digits ``level`` of the bit numbers, so that every level fixes
    other bits.
    """
    parts = [sum(1 << i for i in range(64) if i // 3**level % 3 == t) for t in range(RADIUS + 1)]
    keys = [F.xxhash64("cell", F.lit(level * 3 + t), F.col("fp").bitwiseAND(_bits(m))) for t, m in enumerate(parts)]
    return cells.select(F.explode(F.array(*keys)).alias("cell"), "fp")


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the members within 2 bits of each other."""
    members = np.unique(members)
    links, waiting = [], np.arange(len(members))
    while len(waiting):
        reached, waiting = [waiting[0]], waiting[1:]
        while reached and len(waiting):
            here = members[reached.pop()]
            near = np.bitwise_count((members[waiting] ^ here).view(np.uint64)) <= RADIUS
            links += [(int(here), int(x)) for x in members[waiting[near]]]
            reached += waiting[near].tolist()
            waiting = waiting[~near]
    return links


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches are sorted by cell; the last cell of a batch waits for the next one."""
    held = (np.empty(0, np.int64), np.empty(0, np.int64))

    def links(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
        size = np.diff(np.r_[start, len(cell)])
        length = np.repeat(size, size)
        out = [np.empty((0, 2), np.int64)]
        for d in range(1, 16):  # short runs, all at once
            i = np.flatnonzero((length[:-d] > d) & (length[:-d] <= 16) & (cell[:-d] == cell[d:])) if len(cell) > d else []
            if not len(i):
                break
            i = i[np.bitwise_count((fp[i] ^ fp[i + d]).view(np.uint64)) <= RADIUS]
            out.append(np.stack([fp[i], fp[i + d]], 1))
        for s, n in zip(start[size > 16].tolist(), size[size > 16].tolist()):
            if found := _forest(fp[s : s + n]):
                out.append(np.array(found, np.int64))
        pairs = np.concatenate(out)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        cell, fp = (np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held))
        if not len(cell):
            continue
        last = int(np.searchsorted(cell, cell[-1]))
        held = (cell[last:], fp[last:])
        yield links(cell[:last], fp[:last])
    yield links(*held)


def _links_in(cells: DataFrame) -> DataFrame:
    ordered = cells.repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(_cell_links, "a long, b long")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b) links that connect distinct fingerprints exactly as all pairs within 2 bits do."""
    cells, found = grid_cells(prints), []
    for level in range(LEVELS + 1):
        if level == LEVELS:  # the fixed bits leave a bounded number of members
            found.append(_links_in(cells))
            break
        large = stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS).select("cell"))
        if large.isEmpty():
            found.append(_links_in(cells))
            break
        found.append(_links_in(cells.join(large, "cell", "left_anti")))
        cells = split_cells(cells.join(large, "cell", "left_semi"), level)
    links = found[0]
    for more in found[1:]:
        links = links.unionAll(more)
    return links


def _grouped(tracks: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The tracks' fingerprints, and per distinct one (fp, first track_id, root: the smallest that it can reach)."""
    bounded_batches(tracks.sparkSession)
    prints = stored(fingerprints(tracks, text))
    distinct = stored(prints.groupBy("fp").agg(F.min("track_id").alias("first")))
    roots = connected_components(fingerprint_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return prints, stored(placed)


def near_duplicate_groups(tracks: DataFrame, text: str = "lyrics") -> DataFrame:
    """(track_id, fingerprint, component_id) of every track by its whole ``text``.

    Fingerprints within 2 bits are linked; ``component_id`` is the smallest track_id that can be
    reached. Equal fingerprints are one node, so a group of copies costs one row. A null text is
    an empty one; texts without words share fingerprint 0 and are linked like any other. Rows
    without track_id get the component of their fingerprint, null if no row of the component has an id.
    Repeated rows stay. Extra columns are ignored.
    """
    prints, placed = _grouped(tracks, text)
    least = stored(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    named = stored(placed.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        "track_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
