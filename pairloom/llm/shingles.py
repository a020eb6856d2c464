"""Near-duplicate lyrics: SimHash and rare shingles propose pairs, the shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.graph import connected_components
from pairloom.llm.simhash import fingerprint_links, majority_bits
from pairloom.llm.storage import Scratch, bounded_batches, stored

#: words in a shingle, tenths of the shingles of two texts that near-duplicates share, seed of the shingle hash
WORDS, TENTHS, SEED = 5, 8, 42
#: one in so many sets is read for frequent shingles, which are those of so many of these sets, at most so many
SAMPLED, FREQUENT, LISTED = 16, 3, 1 << 18
#: sets of a shingle that all its sets are compared with first: one alone, then the others
STARS = 4
#: rows of a shingle from which its rows carry their sketches into the last comparison
CROWD = 32
#: bits of a sketch, which differ in two sets at no more places than the sets have shingles apart
SKETCH = 512
DESCRIBED = "track_id long, text_key long, node long, size int, fp long, sketch binary, text binary"


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the shingles in text order; texts of fewer words are one shingle, also without words."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[WORDS - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(stops))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text).view(np.int64))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set's name (a hash of it), size, SimHash fingerprint and sketch beside every text."""
    for batch in batches:
        nodes, sizes, prints, sketches = [], [], [], []
        for text in batch.column(2):
            hashes = shingle_hashes(text.as_py())
            shingles = np.unique(hashes.view(np.int64))
            nodes.append(int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64)))
            sizes.append(len(shingles))
            prints.append(majority_bits(hashes))
            sketches.append(np.packbits(np.bincount(shingles & (SKETCH - 1), minlength=SKETCH) & 1).tobytes())
        made = (pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(sketches, pa.binary()))
        names = [column.split()[0] for column in DESCRIBED.split(", ")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made, batch.column(2)], names)


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text.as_py()) for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], ["shingle"])


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, how often) of the most frequent shingles of a sample, at most ``LISTED``.

    They order the shingles, where any order gives the same pairs and a good one few candidates, and they
    name the shingles whose rows need no counting.
    """
    sample = sets.where(F.pmod("node", F.lit(SAMPLED)) == 0).select("text").mapInArrow(_each_shingle, "shingle long")
    counted = sample.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    found = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(LISTED).toArrow()
    shingles, n = (found.column(k).to_numpy() for k in ("shingle", "n"))
    order = np.argsort(shingles)
    return shingles[order], n[order]


def prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a set, so many that two near-duplicates have one of them in common; which of them are frequent."""
    listed, n = frequent
    often = np.zeros(len(shingles), np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, shingles), len(listed) - 1)
        often = np.where(listed[at] == shingles, n[at], 0)
    size = len(shingles)
    first = np.lexsort((shingles, often))[: size + 1 - -(-TENTHS * size // 10)]
    return shingles[first], often[first] > 0


def _prefixes(frequent: tuple[np.ndarray, np.ndarray]):
    """Rows (shingle, node, bounds): bounds holds the set's size, how many shingles follow from this one on, and whether it is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [(node.as_py(), shingle_set(text.as_py())) for node, text in zip(*batch.slice(at, 256).columns)]
                rows = [np.empty((3, 0), np.int64)]
                for node, shingles in found:
                    rare, known = prefix(shingles, frequent)
                    size, rest = len(shingles), len(shingles) - np.arange(len(rare))
                    rows.append(np.stack([rare, np.full(len(rare), node), (size << 32) | (rest << 1) | known]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(rows, 1)], ["shingle", "node", "bounds"])

    return run


def _in_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle those whose shingle is frequent or stands in a row beside."""
    held, before = np.empty((3, 0), np.int64), None

    def judged(rows: np.ndarray, before: int | None, after: int | None) -> pa.RecordBatch:
        key = rows[0]
        same = key[1:] == key[:-1]
        keep = np.r_[key[:1] == before, same] | np.r_[same, key[-1:] == after] | (rows[2] & 1 > 0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, keep]], ["shingle", "node", "bounds"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns])
        if held.shape[1]:
            yield judged(held, before, rows[0, 0])
            before = held[0, -1]
        held = rows
    if held.shape[1]:
        yield judged(held, before, None)


def _size(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.bounds"), 32)


def _near_pairs(joined: DataFrame) -> DataFrame:
    """Distinct (a, b) of joined rows x, y of one shingle whose sizes and places allow near-duplicates.

    At the rarest shingle of both, the shingles from there on bound what the sets share.
    """
    rest = [F.shiftright(F.col(f"{s}.bounds").bitwiseAND(F.lit(0xFFFFFFFF)), 1) for s in "xy"]
    sizes = _size("x") + _size("y")
    near = (F.least(*rest) * (10 + TENTHS) >= sizes * TENTHS) & (F.least(_size("x"), _size("y")) * 10 >= F.greatest(_size("x"), _size("y")) * TENTHS)
    return joined.where(near & (F.col("x.node") != F.col("y.node"))).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, held = [], (None, np.empty(0, np.int64))
        for k, (a, of_a, of_b) in enumerate(zip(*(batch.column(c) for c in (0, 2, 3)))):
            if a != held[0]:  # a set's pairs often stand together
                held = (a, shingle_set(of_a.as_py()))
            other = shingle_set(of_b.as_py())
            shared = len(np.intersect1d(held[1], other, assume_unique=True))
            if shared * (10 + TENTHS) >= (len(held[1]) + len(other)) * TENTHS:
                kept.append(k)
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def _words(sketch: str) -> list[Column]:
    """A sketch as whole numbers."""
    return [F.conv(F.hex(F.substring(sketch, 8 * k + 1, 8)), 16, -10).cast("long") for k in range(SKETCH // 64)]


def _apart(one: str, other: str) -> Column:
    """Bits in which two sketches differ: no more than the shingles that only one of the sets has."""
    return sum((F.bit_count(F.col(one)[k].bitwiseXOR(F.col(other)[k])) for k in range(SKETCH // 64)), F.lit(0))


def _links(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The proposed pairs of sets that share ``TENTHS`` tenths of their shingles: first by sketches, then by the sets.

    Only the texts of proposed sets move; both joins are of stored tables, so a set with very many proposals is split.
    """
    pairs = scratch.keep(pairs.distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = scratch.keep(sets.join(ends, "node").select("node", "size", "sketch", "text"))
    brief = known.select("node", "size", F.array(*_words("sketch")).alias("odd"))
    both = pairs.join(brief.toDF("a", "size_a", "odd_a"), "a").join(brief.toDF("b", "size_b", "odd_b"), "b")
    near = scratch.keep(both.where(_apart("odd_a", "odd_b") * (10 + TENTHS) <= (F.col("size_a") + F.col("size_b")) * (10 - TENTHS)).select("a", "b"))
    texts = known.select("node", "text")
    full = near.join(texts.toDF("a", "of_a"), "a").join(texts.toDF("b", "of_b"), "b").select("a", "b", "of_a", "of_b")
    links = scratch.keep(full.mapInArrow(_similar, "a long, b long"))
    scratch.drop(pairs, known, near)
    return links


def simhash_pairs(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) pairs of sets that SimHash proposes: equal fingerprints meet one set, fingerprints within 2 bits each other's."""
    first = scratch.keep(sets.groupBy("fp").agg(F.min("node").alias("node")))
    same = sets.select("fp", F.col("node").alias("b")).join(first.withColumnRenamed("node", "a"), "fp").where("a <> b").select("a", "b")
    links = fingerprint_links(first.select("fp")).join(first.toDF("a", "na"), "a").join(first.toDF("b", "nb"), "b")
    return same.unionAll(links.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")))


def near_duplicate_sets(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the shingle sets that have near-duplicates: root is the smallest that can be reached.

    Two sets that share ``TENTHS`` tenths of their shingles share one of their rarest ones (prefix filter, exact).
    First every set meets what SimHash proposes, then one set of each of its rare shingles, then a few more, unless both
    are in one component by then: a large group of near copies takes a few comparisons for each of its sets. Last, under
    each shingle, the sets outside its largest component meet the sets of the other components; where they are many, their
    sketches go with them, so that only pairs which may be near-duplicates leave the join.
    """
    rare = sets.select("node", "text").mapInArrow(_prefixes(frequent_shingles(sets)), "shingle long, node long, bounds long")
    # a frequent shingle's rows are dealt by both columns: they are kept without looking at each other
    dealt = F.when(F.col("bounds").bitwiseAND(F.lit(1)) == 1, F.xxhash64("shingle", "node")).otherwise(F.col("shingle"))
    ordered = rare.repartition(dealt).sortWithinPartitions("shingle")
    members = scratch.bucketed(ordered.mapInArrow(_in_several, "shingle long, node long, bounds long"), "shingle")
    links = _links(simhash_pairs(sets, scratch), sets, scratch)
    for turns in (range(min(STARS, 1)), range(1, STARS)):
        if not turns:
            continue
        centre = lambda turn: F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("at"), "node", "bounds"))
        stars = members.groupBy("shingle").agg(F.array(*map(centre, turns)).alias("c")).select("shingle", F.explode("c").alias("c"))
        proposed = _near_pairs(stars.select("shingle", "c.node", "c.bounds").alias("x").join(members.alias("y"), "shingle")).distinct()
        roots = connected_components(links)
        for side in "ab":
            proposed = proposed.join(roots.toDF(side, f"root_{side}"), side, "left")
        proposed = proposed.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        links = links.unionAll(_links(proposed, sets, scratch))
    roots = connected_components(links)
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = scratch.bucketed(placed.select("shingle", "node", "bounds", "root"), "shingle")
    scratch.drop(members)
    by_root = placed.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = by_root.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("rows")).where("roots > 1")
    mixed = scratch.bucketed(placed.join(largest.select("shingle", F.col("m.root").alias("main"), "rows"), "shingle"), "shingle")
    scratch.drop(placed)
    once = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    met = lambda rows: rows.where("root <> main").alias("x").join(rows.alias("y"), "shingle").where(once)
    few, many = mixed.where(F.col("rows") < CROWD), mixed.where(F.col("rows") >= CROWD)
    many = scratch.keep(many.join(sets.select("node", F.array(*_words("sketch")).alias("odd")), "node"))
    alike = _apart("x.odd", "y.odd") * (10 + TENTHS) <= (_size("x") + _size("y")) * (10 - TENTHS)
    more = _links(_near_pairs(met(few)).unionAll(_near_pairs(met(many).where(alike))), sets, scratch)
    return connected_components(links.unionAll(more))


def first_of_near_duplicates(tracks: DataFrame, text: str = "lyrics") -> DataFrame:
    """(track_id, text_key) of the one track that stays of every group of near-duplicates.

    Near-duplicates have a Jaccard similarity of 5-word shingles of 0.8 or more; groups are what such pairs
    connect. The one with the smallest track_id stays, one without id only where the group has no other; of rows
    that share it, the one with the smallest hash of its text. Texts without words are alike. Equal
    sets are one row from the first step on, dealt by their name with their text; tables are deleted after
    their last reader.
    """
    spark = tracks.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    rows = tracks.select(F.col("track_id").cast("long"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary").alias("text"))
    first = F.min(F.struct(F.col("track_id").isNull().alias("nameless"), "track_id", "text_key")).alias("kept")
    same = [F.first(c).alias(c) for c in ("size", "fp", "sketch", "text")]
    sets = scratch.bucketed(rows.mapInArrow(_described, DESCRIBED).groupBy("node").agg(first, *same), "node")
    roots = near_duplicate_sets(sets, scratch)
    best = sets.select("node", "kept").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("kept").alias("kept"))
    out = stored(best.select("kept.track_id", "kept.text_key"))
    scratch.drop()
    return out
