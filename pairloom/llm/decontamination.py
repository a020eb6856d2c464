"""Passages of held-out items in lyrics, found by an edit-distance embedding and sampled hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.storage import bounded_batches, stored

#: similarity (1 - edits / item length) of a passage, items in a block that is sent to all tasks
SIMILARITY, ITEM_BLOCK = 0.8, 5000
#: by the item's length in bytes, the largest first: shortest item, steps of a walk, walks, samplings of a walk, places in a sampling
CLASSES = ((72, 48, 5, 2, 16), (36, 32, 4, 2, 16))
PAD = 64
#: places of every sampling after which windows that no item window equals so far are left; windows that walk together
EARLY, TOGETHER = 5, 1 << 15
BUFFER = 4 << 20
#: shortest piece of an item that is looked for unchanged
PIECE = 5
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SCHEMA = "track_id long, text_key long, item_id long, first_word long, edits long, item_length long"


def plain(text: bytes | None) -> bytes:
    """A-Z lowered, ASCII punctuation and white space as single spaces."""
    return b" ".join((text or b"").translate(_PLAIN).split())


class Walks:
    """CGK embeddings of windows: at step j the walk writes a character and moves on if bit (j, character) is set.

    Two strings within k edits get embeddings within about k*k places; a sampling keeps some places and
    hashes them, so that close windows share a hash with a fixed probability.
    """

    def __init__(self, steps: int, walks: int, samplings: int, places: int, seed: int = 17) -> None:
        rnd = np.random.default_rng(seed)
        self.steps, self.walks, self.samplings = steps, walks, samplings
        self.moves = rnd.integers(0, 2, (walks, steps, 256)).astype(np.uint8)
        self.kept = np.zeros((walks, samplings, steps), bool)
        for walk in range(walks):
            for sampling in range(samplings):
                self.kept[walk, sampling, rnd.choice(steps, places, replace=False)] = True
        self.factor = (rnd.integers(1 << 61, 1 << 62, walks * samplings).astype(np.uint64) << np.uint64(1)) | np.uint64(1)

    def early(self, walk: int) -> int:
        """Steps until every sampling has ``EARLY`` places."""
        return int(np.flatnonzero((self.kept[walk].cumsum(1) >= EARLY).all(0))[0]) + 1

    def steps_of(self, walk: int) -> int:
        return int(np.flatnonzero(self.kept[walk].any(0))[-1]) + 1

    def go(self, buffer: np.ndarray, at: np.ndarray, keys: np.ndarray, walk: int, low: int, high: int) -> None:
        """Steps ``low`` to ``high`` of a walk, in place, for few windows at a time so that they stay in the cache."""
        for cut in range(0, len(at), TOGETHER):
            places, part = at[cut : cut + TOGETHER], keys[:, cut : cut + TOGETHER]
            for step in range(low, high):
                here = buffer.take(places)
                for sampling in np.flatnonzero(self.kept[walk, :, step]).tolist():
                    key = part[sampling]
                    key *= self.factor[walk * self.samplings + sampling]
                    key += here
                    key ^= key >> np.uint64(29)
                places += self.moves[walk, step].take(here)

    def begin(self, buffer: np.ndarray, starts: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
        """(where every walk is, samplings x windows hashes) after the early steps."""
        at, keys = starts.astype(np.int64), np.zeros((self.samplings, len(starts)), np.uint64)
        self.go(buffer, at, keys, walk, 0, self.early(walk))
        return at, keys

    def finish(self, buffer: np.ndarray, at: np.ndarray, keys: np.ndarray, walk: int) -> None:
        self.go(buffer, at, keys, walk, self.early(walk), self.steps_of(walk))


def _word_starts(buffer: np.ndarray) -> np.ndarray:
    """Starts of words in plain texts that are kept apart by zero bytes."""
    gap = (buffer == 32) | (buffer == 0)
    return np.flatnonzero(gap[:-1] & ~gap[1:]) + 1


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with all texts, each after zero bytes that no window crosses; (buffer, first bytes)."""
    pad = bytes(PAD)
    starts = np.cumsum([0] + [len(t) + len(pad) for t in texts])[:-1] + len(pad)
    return np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8), starts


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low..high, and which range each is of."""
    times = high - low
    of = np.repeat(np.arange(len(low)), times)
    return np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times), of


def _early_marks(keys: np.ndarray) -> np.ndarray:
    """20 bits of an early hash, whose last places have not reached its high bits."""
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


class ClassIndex:
    """Hashes of the windows at all word starts of the items of one length class, per walk and sampling."""

    def __init__(self, texts: list[bytes], numbers: np.ndarray, steps: int, walks: int, samplings: int, places: int) -> None:
        self.walks, self.tables, self.early = Walks(steps, walks, samplings, places), [], []
        buffer, first = _laid_out(texts)
        last = first + np.array([len(t) for t in texts], np.int64)
        starts = _word_starts(buffer)
        item = np.searchsorted(first, starts, "right") - 1
        for walk in range(walks):
            ends, keys = self.walks.begin(buffer, starts, walk)
            begun = keys.copy()
            self.walks.finish(buffer, ends, keys, walk)
            whole = ends <= last[item]
            for sampling in range(samplings):
                marks = np.zeros(1 << 20, bool)
                marks[_early_marks(begun[sampling][whole])] = True
                self.early.append(marks)
                order = np.argsort(keys[sampling][whole], kind="stable")
                key = keys[sampling][whole][order]
                marks = np.zeros(1 << 20, bool)
                marks[key >> np.uint64(44)] = True
                self.tables.append((key, numbers[item[whole][order]], (starts - first[item])[whole][order], marks))

    def hits(self, buffer: np.ndarray, first: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """(row, byte at which the item would begin, item) of the windows that share a hash.

        Equal hashes are equal after the early steps too, so the other windows need not walk to their end.
        """
        found = []
        for walk in range(self.walks.walks):
            at, keys = self.walks.begin(buffer, starts, walk)
            open_ = np.zeros(len(starts), bool)
            for sampling in range(self.walks.samplings):
                open_ |= self.early[walk * self.walks.samplings + sampling].take(_early_marks(keys[sampling]))
            left = np.flatnonzero(open_)
            at, keys, begun = at[left], keys[:, left], starts[left]
            self.walks.finish(buffer, at, keys, walk)
            for sampling in range(self.walks.samplings):
                key, item, offset, marks = self.tables[walk * self.walks.samplings + sampling]
                near = np.flatnonzero(marks[keys[sampling] >> np.uint64(44)])
                low, high = (np.searchsorted(key, keys[sampling][near], side) for side in ("left", "right"))
                entry, of = _spread(low, high)
                opened = begun[near][of]
                row = np.searchsorted(first, opened, "right") - 1
                found.append(np.stack([row, opened - offset[entry] - first[row], item[entry]], 1))
        return found


class ItemIndex:
    """The items of a block by length class; items shorter than all classes by the hash of their whole bytes."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        size, self.classes, below = np.array([len(t) for t in self.texts], np.int64), [], 1 << 62
        for shortest, *settings in CLASSES:
            chosen = np.flatnonzero((size >= shortest) & (size < below))
            below = shortest
            if len(chosen):
                self.classes.append(ClassIndex([self.texts[k] for k in chosen], chosen, *settings))
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for k in np.flatnonzero(size < below).tolist():
            self.short.setdefault(len(self.texts[k]), {}).setdefault(self.texts[k], []).append(k)

    def hits(self, texts: list[bytes]) -> np.ndarray:
        """Distinct (text, item, byte at which the item would begin), in order, of all windows that share a hash."""
        buffer, first = _laid_out(texts)
        starts = _word_starts(buffer)
        found = [np.empty((0, 3), np.int64)]
        for index in self.classes:
            found += index.hits(buffer, first, starts)
        for length, known in self.short.items():
            # windows that end with a word, as whole items do
            fit = starts[starts + length <= len(buffer) - 1]
            fit = fit[(buffer[np.minimum(fit + length, len(buffer) - 1)] == 32) | (buffer[np.minimum(fit + length, len(buffer) - 1)] == 0)]
            raw = buffer.tobytes()
            equal = [(at, k) for at in fit.tolist() for k in known.get(raw[at : at + length], ())]
            if equal:
                at, item = np.array(equal).T
                row = np.searchsorted(first, at, "right") - 1
                found.append(np.stack([row, at - first[row], item], 1))
        return np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)


def edits_of_best_passage(item: bytes, text: bytes) -> tuple[int, int]:
    """(fewest edits, end) of any passage of ``text`` against the whole ``item``, by bit vectors."""
    full, high, peq = (1 << len(item)) - 1, 1 << (len(item) - 1), {}
    for k, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << k
    up, down, edits = full, 0, len(item)
    best = (edits, 0)
    for end, c in enumerate(text, 1):
        same = peq.get(c, 0) | down
        diagonal = (((same & up) + up) ^ up) | same
        raised, lowered = down | (full & ~(diagonal | up)), up & diagonal
        edits += bool(raised & high) - bool(lowered & high)
        raised = raised << 1 & full
        up, down = (lowered << 1 & full) | (full & ~(diagonal | raised)), raised & diagonal
        if edits < best[0]:
            best = (edits, end)
    return best


def fewest_edits(item: bytes, text: bytes, known: int) -> tuple[int, int]:
    """``edits_of_best_passage`` of a text in which some passage is known to have at most ``known`` edits.

    Of ``known`` + 1 pieces of the item such a passage holds one unchanged, so only the text around equal pieces is
    looked at, all of it where pieces are short or frequent.
    """
    at = text.find(item)
    if at >= 0:
        return 0, at + len(item)
    cuts = [k * len(item) // (known + 1) for k in range(known + 2)]
    if len(item) < PIECE * (known + 1):
        return edits_of_best_passage(item, text)
    zones, limit = [], len(text) // (2 * (len(item) + 2 * known)) + 1
    for low, high in zip(cuts, cuts[1:]):
        at = text.find(item[low:high])
        while at >= 0:
            zones.append((at - low - known, at - low + len(item) + known))
            if len(zones) > limit:
                return edits_of_best_passage(item, text)
            at = text.find(item[low:high], at + 1)
    best, merged = (len(item), 0), []
    for low, high in sorted(zones):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(high, merged[-1][1])
        else:
            merged.append([low, high])
    for low, high in merged:
        edits, end = edits_of_best_passage(item, text[max(0, low) : max(0, high)])
        if edits < best[0]:
            best = (edits, max(0, low) + end)
    return best


def contaminated_passages(
    tracks: DataFrame, items: DataFrame, text: str = "lyrics", similarity: float = SIMILARITY, item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """(track_id, text_key, item_id, first_word, edits, item_length): the best passage of each item in each track.

    ``items`` (item_id, text) are held-out captions. In plain form, windows open at all word starts; windows of track
    and item that share a sampled hash of their CGK walks propose where the item would lie, and the item-sized
    passage there is checked by exact edit distance: at most ``1 - similarity`` times the item's length. A track
    with such a passage is then checked whole, so that ``edits`` are its fewest (the first passage with them counts).
    Walks are as long as the item's length class asks for (``CLASSES``); items of fewer bytes than the last class
    are found unchanged only. Of edited passages with 10, 15 and 20 % edits 95 % or more are found (see the tests).
    Items go to the tasks in blocks of ``item_block``, each a pass over the tracks. Empty items and those without id
    are left out; items with equal text have a row each. Null texts have no passages, repeated rows repeat theirs.
    """
    bounded_batches(tracks.sparkSession)
    named = items.where("item_id is not null and text is not null")
    key, words = F.xxhash64("text").alias("item_key"), F.col("text").cast("binary").alias("text")
    held = named.select(words).distinct().select("text", key)
    named = stored(named.select(F.col("item_id").cast("long"), words).distinct().select("item_id", key))
    n_blocks = max(1, -(-held.count() // item_block))
    rows = tracks.select(F.col("track_id").cast("long"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary").alias("text"))
    passes = []
    for block in range(n_blocks):
        part = held.where(F.pmod("item_key", F.lit(n_blocks)) == block).collect()  # bounded by item_block
        listed = sorted((r["item_key"], plain(bytes(r["text"]))) for r in part)
        index = ItemIndex([x for x in listed if x[1]])
        passes.append(rows.mapInArrow(_passages(index, similarity), SCHEMA))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionAll(more)
    columns = [column.split()[0] for column in SCHEMA.split(", ")]
    return out.withColumnRenamed("item_id", "item_key").join(named, "item_key").select(*columns)


def _passages(index: ItemIndex, similarity: float):
    names = [column.split()[0] for column in SCHEMA.split(", ")]

    def found_in(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        hits = index.hits(texts)
        size = np.array([len(t) for t in index.texts], np.int64)[hits[:, 1]] if len(hits) else np.empty(0, np.int64)
        # proposals whose passages overlap are checked as one
        apart = np.flatnonzero(np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(1) | (hits[1:, 2] - hits[:-1, 2] > size[1:])]) if len(hits) else []
        for at, to in zip(apart, [*apart[1:], len(hits)]):
            row, item, begin = hits[at].tolist()
            text, words = texts[row], index.texts[item]
            allowed = int((1 - similarity) * len(words) + 1e-9)
            if (row, item) in best:
                continue  # the whole text has been checked
            low = max(0, begin - 2 * allowed)
            near, _ = edits_of_best_passage(words, text[low : int(hits[to - 1, 2]) + len(words) + 2 * allowed])
            if near <= allowed:
                edits, end = fewest_edits(words, text, near)
                best[row, item] = (edits, text[: max(0, end - len(words))].count(b" "))
        out = [(*rows[r][:2], index.ids[i], word, edits, len(index.texts[i])) for (r, i), (edits, word) in best.items()]
        columns = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for track, key, text in zip(*batch.columns):
                held.append((track.as_py(), key.as_py(), plain(text.as_py())))
                size += len(held[-1][2])
                if size > BUFFER:
                    yield found_in(held)
                    held, size = [], 0
        if held:
            yield found_in(held)

    return run
