import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from pairloom.llm import trie
from pairloom.llm.queries import _rebuilt
from pairloom.llm.trie import digest_of_lists, prefix_trie, split_at_centroids

SCHEMA = "track_id long, position long, label string, lyrics string, depth string, a long"


def brute(tracks):
    """tracks: id -> list of (label, lyrics)."""
    members, ends = defaultdict(list), defaultdict(list)
    for t in sorted(tracks):
        for d in range(len(tracks[t]) + 1):
            members[tuple(tracks[t][:d])].append(t)
        ends[tuple(tracks[t])].append(t)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)

    def below(seq):
        yield seq
        for child in children[seq]:
            yield from below(child)

    out = {}
    for seq, own in members.items():
        under = list(below(seq))
        saved = sum((len(members[s]) - 1) * len(s[-1][1]) for s in under if s)
        parent = min(members[seq[:-1]]) if seq else None
        out[own[0], len(seq)] = (parent, len(own), len(children[seq]), sum(not children[s] for s in under), saved)
    return out, {(min(members[s]), len(s)): e for s, e in ends.items()}


def made(rnd, n, alphabet, length):
    return {t * 7: [(rnd.choice("vc"), rnd.choice(alphabet) * rnd.randint(1, 2)) for _ in range(rnd.randint(0, length))] for t in range(n)}


def rows_of(tracks):
    return [(t, 10 * p, label, text, "x", 1) for t, parts in tracks.items() for p, (label, text) in enumerate(parts)]


@pytest.mark.parametrize("local,slices", [(4096, 4096), (3, 2)])
def test_same_as_brute_force(spark, monkeypatch, local, slices):
    monkeypatch.setattr(trie, "LOCAL", local)
    monkeypatch.setattr(trie, "SLICE", slices)
    rnd = random.Random(5)
    tracks = made(rnd, 60, "aé", 5)
    tracks |= {1000 + k: [("v", "long")] * k for k in (17, 18, 40)} | {2000 + k: tracks[7] for k in range(30)}
    rows = rows_of(tracks)
    rnd.shuffle(rows)
    listed = spark.createDataFrame([(t, "y") for t in tracks] + [(None, "y"), (0, "y")], "track_id long, lyrics string")
    got = prefix_trie(spark.createDataFrame([*rows, (None, 1, "v", "lost", None, None)], SCHEMA), listed)
    nodes, ends = brute(tracks)
    assert {(r.track_id, r.depth): (r.parent_id, r.n_tracks, r.n_children, r.n_leaves, r.saved) for r in got.nodes.collect()} == nodes
    assert got.nodes.count() == len(nodes)
    listed_ends = defaultdict(list)
    for r in got.ends.collect():
        listed_ends[r.node_id, r.depth].append(r.track_id)
    assert {k: sorted(v) for k, v in listed_ends.items()} == ends
    digests = digest_of_lists(got.ends, ["node_id", "depth"], "track_id", "h").collect()
    assert {(r.node_id, r.depth): r.h for r in digests} == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ends.items()}


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, None, None, None, None), (1, 2, "v", "x", None, None), (2, 5, "", "", None, None), (2, 6, "v", "x", None, None), (2, 6, "v", "x", None, None), (3, 1, "v", "x" * 300_000, None, None), (-4, 1, "v", "", None, None)]
    got = {(r.track_id, r.depth): r for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).nodes.collect()}
    want, _ = brute({1: [("", ""), ("v", "x")], 2: [("", ""), ("v", "x"), ("v", "x")], 3: [("v", "x" * 300_000)], -4: [("v", "")]})
    assert {k: (r.parent_id, r.n_tracks, r.n_children, r.n_leaves, r.saved) for k, r in got.items()} == want
    none = prefix_trie(spark.createDataFrame([], SCHEMA))
    assert none.nodes.count() == none.ends.count() == 0


def test_rollup_of_random_forests():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 9, 200, 1000):
        parent = np.array([-1 if k == 0 or rnd.random() < 0.05 else int(rnd.integers(max(0, k - 1 - n // 4 * int(rnd.integers(0, 2))), k)) for k in range(n)])
        weights = rnd.integers(0, 9, (n, 2))
        size, want = np.ones(n, np.int64), weights.copy()
        for k in range(n - 1, 0, -1):
            if parent[k] >= 0:
                size[parent[k]] += size[k]
                want[parent[k]] += want[k]
        assert np.array_equal(split_at_centroids(parent, size, weights), want)


def test_rebuilt_conversations(spark):
    import zlib

    rnd = random.Random(2)
    convs = {c: [(rnd.choice("ua"), f"{c} {k}") for k in range(rnd.randint(1, 8))] for c in (0, 1, 2, 99, 100, 101, 155, 307, 5, 6, 7, 8)}
    rows = [(c, None if k == 0 else k, role, text) for c, parts in convs.items() for k, (role, text) in enumerate(parts)]
    sections, tracks = _rebuilt(spark.createDataFrame([*rows, (None, 1, "u", "t")], "conv_id long, turn long, role string, text string"))
    got = defaultdict(list)
    for r in sections.orderBy("track_id", "position").collect():
        got[r.track_id].append((r.label, r.lyrics))
    want = {}
    for c, parts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + parts[h:]
    assert got == {c: parts for c, parts in want.items() if parts}
    assert {r.track_id for r in tracks.collect()} == set(convs)
