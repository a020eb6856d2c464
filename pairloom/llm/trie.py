"""Prefix trie of tracks by their sections, rolled up by centroid decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.storage import Scratch, stored
from pairloom.operators.ranking import depth_bounds, depth_bucket, exact_rank

#: sections of a track that are folded in one task, nodes of a component that one task splits to its end, ids of a digest's chunk
SLICE, LOCAL, CHUNK = 4096, 4096, 1024
NODE = "track_id long, depth long, n_leaves long, saved long"
_ACTIVE = ("track_id", "depth", "parent_id", "size", "leaf", "saving", "leaves_below", "saved_below", "top_id", "top_depth")


@dataclass
class Trie:
    """``nodes``: (track_id, depth, parent_id, n_tracks, n_children, n_leaves, saved); ``ends``: (track_id, node_id, depth)."""

    nodes: DataFrame
    ends: DataFrame


def prefix_keys(sections: DataFrame, scratch: Scratch, track: str, position: str, label: str, text: str) -> DataFrame:
    """(track_id, depth, a, b, length): a 128-bit name of the first ``depth`` sections, the code points of the last one.

    A section's two hashes depend on its depth, label and text; a sequence's name is their running exclusive or, taken
    in slices of ``SLICE`` sections, so that a track with very many sections is folded by many tasks.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = sections.where(F.col(track).isNotNull()).select(
        F.col(track).cast("long").alias("track_id"), F.col(position).alias("at"), blank(label).alias("label"), blank(text).alias("text")
    )
    bucket = depth_bucket(F.col("at"), depth_bounds(rows, F.col("at")))
    ranked = exact_rank(rows, ["track_id"], [F.col("at").asc_nulls_first(), F.col("label"), F.col("text")], bucket, name="depth")
    steps = scratch.keep(ranked.select(
        "track_id", "depth", F.floor(F.col("depth") / SLICE).alias("slice"), F.char_length("text").cast("long").alias("length"),
        *(F.xxhash64(F.lit(seed), "depth", "label", "text").alias(name) for seed, name in ((1, "a"), (2, "b"))),
    ))
    by_slice = steps.groupBy("track_id", "slice").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb"))
    before = Window.partitionBy("track_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_slice.select("track_id", "slice", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("sa", "sb")))
    inside = Window.partitionBy("track_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    folded = steps.select("track_id", "slice", "depth", "length", *(F.bit_xor(c).over(inside).alias(c) for c in ("a", "b")))
    joined = folded.join(starts, ["track_id", "slice"])
    return joined.select("track_id", "depth", F.col("a").bitwiseXOR(F.col("sa")).alias("a"), F.col("b").bitwiseXOR(F.col("sb")).alias("b"), "length")


def split_at_centroids(parent: np.ndarray, size: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Subtree sums of ``weights`` (rows x sums) of a forest, given ``parent`` rows (-1: none) and subtree sizes.

    The rows of a component whose subtree holds half of it or more form a path from its top; the lowest one is
    its centroid. It is cut out; the totals of the components below it are its sum, which is added to
    the path above it, and every part is split in its turn.
    """
    n = len(parent)
    parent, size, below, sums = parent.copy(), size.copy(), np.zeros_like(weights), np.zeros_like(weights)
    alive, here = np.ones(n, bool), np.arange(n)

    def tops() -> np.ndarray:
        top = np.where(parent < 0, here, parent)
        while True:
            up = top[top]
            if np.array_equal(up, top):
                return top
            top = up

    top = tops()
    while alive.any():
        heavy = alive & (2 * size >= size[top])
        inner = np.zeros(n, bool)
        inner[parent[heavy & (parent >= 0)]] = True
        centre = np.flatnonzero(heavy & ~inner)
        centre_of = np.zeros(n, np.int64)
        centre_of[top[centre]] = centre
        is_centre = np.zeros(n, bool)
        is_centre[centre] = True
        child = np.flatnonzero(alive & (parent >= 0) & is_centre[parent])
        child_of = parent[child]
        parent[child] = -1
        parent[centre] = -1
        alive[centre] = False
        above = np.flatnonzero(heavy & alive)
        of = centre_of[top[above]]
        top = tops()
        total = np.zeros_like(weights)
        np.add.at(total, top[alive], weights[alive])
        found = np.zeros_like(weights)
        found[centre] = weights[centre]
        np.add.at(found, child_of, total[child])
        sums[centre] = below[centre] + found[centre]
        below[above] += found[of]
        size[above] -= size[of]
    return sums


def _split_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by component; whole components are split together."""
    names = [column.split()[0] for column in NODE.split(", ")]

    def rolled(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        order = np.lexsort((c["track_id"], c["depth"]))
        key = np.stack([c["depth"], c["track_id"]], 1)
        wanted = np.stack([c["depth"] - 1, c["parent_id"]], 1)
        is_top = (c["track_id"] == c["top_id"]) & (c["depth"] == c["top_depth"])
        both, which = np.unique(np.concatenate([key, wanted]), axis=0, return_inverse=True)
        row = np.full(len(both), -1, np.int64)
        row[which[: len(order)]] = np.arange(len(order))
        parent = np.where(is_top, -1, row[which[len(order) :]])
        sums = split_at_centroids(parent, c["size"], np.stack([c["leaf"], c["saving"]], 1))
        arrays = (c["track_id"], c["depth"], sums[:, 0] + c["leaves_below"], sums[:, 1] + c["saved_below"])
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 65_536:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        tops = [table.column(k).to_numpy() for k in ("top_id", "top_depth")]
        last = int(np.flatnonzero((tops[0] != tops[0][-1]) | (tops[1] != tops[1][-1]))[-1:].sum() + 1) if len(tops[0]) else 0
        if last > 1:
            yield rolled({k: table.column(k).to_numpy()[:last] for k in _ACTIVE})
            held = table.slice(last).to_batches()
            size = table.num_rows - last
    if size:
        table = pa.Table.from_batches(held)
        yield rolled({k: table.column(k).to_numpy() for k in _ACTIVE})


def rollup(nodes: DataFrame, steps: DataFrame, scratch: Scratch) -> DataFrame:
    """(track_id, depth, n_leaves, saved): sums of ``leaf`` and ``saving`` over every node's subtree.

    ``nodes`` (track_id, depth, parent_id, size, leaf, saving) form trees, ``size`` counts a subtree's nodes;
    ``steps`` (track_id, depth, node_id, parent_id) has every track's path. Components of more than ``LOCAL`` nodes
    lose their centroid in a round of joins, each at least halved; the others are split to their end in the tasks.
    Which part a node falls to is told by the step of its track that follows the centroid.
    """
    node, top, mid = ["track_id", "depth"], ["top_id", "top_depth"], ["c_id", "c_depth"]
    roots = F.col("parent_id").isNull()
    first = nodes.where(roots).agg(F.min("track_id")).first()[0]
    active = nodes.withColumns({"leaves_below": F.lit(0).cast("long"), "saved_below": F.lit(0).cast("long"), "top_id": F.lit(first).cast("long"), "top_depth": F.lit(0).cast("long")})
    done, small = [], []
    while True:
        counted = active.join(active.groupBy(*top).agg(F.count(F.lit(1)).alias("n")), top)
        counted = scratch.keep(counted.select(*_ACTIVE, "n"))
        small.append(counted.where(F.col("n") <= LOCAL).drop("n"))
        large = counted.where(F.col("n") > LOCAL)
        if large.isEmpty():
            break
        heavy = F.col("size") * 2 >= F.col("n")
        lowest = F.max(F.struct("depth", "track_id", "size")).alias("c")
        centres = large.where(heavy).groupBy(*top).agg(lowest).select(*top, F.col("c.track_id").alias("c_id"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size"))
        centres = scratch.keep(centres)
        below = centres.select(F.col("c_id").alias("parent_id"), (F.col("c_depth") + 1).alias("depth"))
        onward = steps.join(below, ["parent_id", "depth"]).select("track_id", F.col("parent_id").alias("c_id"), (F.col("depth") - 1).alias("c_depth"), F.col("node_id").alias("next_id"))
        placed = large.join(centres, top).join(onward, ["track_id", *mid], "left")
        placed = placed.withColumn("next_id", F.when(F.col("depth") > F.col("c_depth"), F.col("next_id")))
        centre = (F.col("track_id") == F.col("c_id")) & (F.col("depth") == F.col("c_depth"))
        placed = scratch.keep(placed.withColumns({"is_centre": centre, "heavy": heavy}))
        totals = placed.where("is_centre or next_id is not null").groupBy(*mid).agg(F.sum("leaf").alias("c_leaves"), F.sum("saving").alias("c_saved"))
        moved = placed.join(totals, mid)
        found = {"leaves_below": F.col("leaves_below") + F.col("c_leaves"), "saved_below": F.col("saved_below") + F.col("c_saved")}
        done.append(scratch.keep(moved.where("is_centre").select(*node, found["leaves_below"].alias("n_leaves"), found["saved_below"].alias("saved"))))
        inside = F.col("next_id").isNotNull()
        on_path = {c: F.when(F.col("heavy"), x).otherwise(F.col(c)) for c, x in {**found, "size": F.col("size") - F.col("c_size")}.items()}
        parts = {"top_id": F.when(inside, F.col("next_id")).otherwise(F.col("top_id")), "top_depth": F.when(inside, F.col("c_depth") + 1).otherwise(F.col("top_depth"))}
        active = scratch.keep(moved.where("not is_centre").withColumns({**on_path, **parts}).select(*_ACTIVE))
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionAll(more)
    out = rest.repartition(*top).sortWithinPartitions(*top).mapInArrow(_split_here, NODE)
    for more in done:
        out = out.unionAll(more)
    return out


def prefix_trie(
    sections: DataFrame, tracks: DataFrame | None = None, track: str = "track_id", position: str = "position", label: str = "label", text: str = "lyrics",
) -> Trie:
    """The trie of all openings that ``tracks`` have, and where each track ends.

    ``sections`` holds a track's parts in the order of ``position`` (null first; ties by label and text): a label
    such as verse or chorus and its lyrics, null ones count as empty. The library has no transcripts of its own,
    so any such rows will do. ``tracks`` (track_id) also lists tracks without sections; else those of ``sections``
    count. Rows without track id take no part, repeated sections are sections of their own, other columns are ignored.

    A node is a distinct sequence of a track's first ``depth`` sections, named by the smallest track that opens with
    it; the root (depth 0) has no sections and all tracks. ``parent_id`` names the parent (root: null), ``n_tracks`` counts the
    tracks that open with it, ``n_leaves`` the nodes without children in its subtree, ``saved`` sums up, over its
    subtree, the code points of a node's last section times the tracks beyond the first. ``ends`` names the node where each
    track ends. No tracks give no rows.

    Every step of a track is one row; hot openings and long tracks are split: see ``prefix_keys`` and ``rollup``.
    """
    spark = sections.sparkSession
    scratch = Scratch(spark)
    listed = (sections if tracks is None else tracks).select(F.col(track).cast("long").alias("track_id")).where("track_id is not null").distinct()
    listed = scratch.keep(listed)
    paths = scratch.keep(prefix_keys(sections, scratch, track, position, label, text))
    if tracks is not None:
        paths = paths.join(listed, "track_id", "left_semi")
    root = listed.agg(F.min("track_id")).first()[0]
    named = paths.groupBy("depth", "a", "b").agg(F.min("track_id").alias("node_id"), F.count(F.lit(1)).alias("n_tracks"), F.max("length").alias("length"))
    steps = scratch.keep(paths.drop("length").join(scratch.keep(named), ["depth", "a", "b"]).drop("a", "b"))
    before = steps.select("track_id", (F.col("depth") + 1).alias("depth"), F.col("node_id").alias("parent_id"))
    parent = F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("parent_id")).alias("parent_id")
    steps = scratch.keep(steps.join(before, ["track_id", "depth"], "left").select("track_id", "depth", "node_id", parent, "n_tracks", "length"))
    own = F.col("node_id") == F.col("track_id")
    # a track names the nodes from some depth to its end: so many of them lie below each of its steps
    spread = scratch.keep(steps.groupBy("track_id").agg(F.max("depth").alias("last"), F.min(F.when(own, F.col("depth"))).alias("first")))
    named_below = F.when(F.col("first").isNotNull(), F.col("last") - F.greatest("first", "depth") + 1).otherwise(0)
    sizes = steps.join(spread, "track_id").groupBy(F.col("node_id").alias("track_id"), "depth").agg(F.sum(named_below).alias("size"))
    children = steps.where(own).groupBy(F.col("parent_id").alias("track_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    inner = steps.where(own).select("track_id", "depth", "parent_id", "n_tracks", "length").join(sizes, ["track_id", "depth"])
    n_tracks, n_nodes = listed.count(), steps.where(own).count()
    top = [(root, 0, None, n_tracks, 0, n_nodes + 1)] if n_tracks else []
    nodes = inner.unionAll(spark.createDataFrame(top, inner.schema)).join(children, ["track_id", "depth"], "left").fillna(0, ["n_children"])
    nodes = scratch.keep(nodes)
    weights = {"leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_tracks") - 1) * F.col("length")}
    sums = rollup(nodes.withColumns(weights).select("track_id", "depth", "parent_id", "size", "leaf", "saving"), steps, scratch)
    out = stored(nodes.join(sums, ["track_id", "depth"]).select("track_id", "depth", "parent_id", "n_tracks", "n_children", "n_leaves", "saved"))
    at_end = steps.join(spread.select("track_id", F.col("last").alias("depth")), ["track_id", "depth"]).select("track_id", "node_id", "depth")
    nowhere = listed.join(spread, "track_id", "left_anti").select("track_id", F.lit(root).cast("long").alias("node_id"), F.lit(0).cast("long").alias("depth"))
    ends = stored(at_end.unionAll(nowhere))
    scratch.drop()
    return Trie(out, ends)


def digest_of_lists(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): SHA-256 (lowercase hex) of a key's whole numbers ``value`` in ascending order, comma-joined.

    Numbers are joined in chunks of a range of ``CHUNK``; a task only runs over a key's chunks, so a key with very
    many rows needs no more memory than any other.
    """
    place = F.shiftright(value, CHUNK.bit_length() - 1)
    joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string"))).alias("_part")
    chunks = rows.groupBy(*keys, place.alias("_chunk")).agg(joined)
    ordered = chunks.repartition(*keys).sortWithinPartitions(*keys, "_chunk").select(*keys, "_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            found = []
            for *key, part in zip(*(c.to_pylist() for c in batch.columns)):
                if key != held:
                    if state:
                        found.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
            yield made(found)
        if state:
            yield made([(*held, state.hexdigest())])

    def made(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * (len(keys) + 1)
        kinds = [pa.int64()] * len(keys) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*keys, name])

    return ordered.mapInArrow(run, ", ".join([*(f"{k} long" for k in keys), f"{name} string"]))
