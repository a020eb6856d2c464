import random

import xxhash
from pyspark.sql import functions as F

from pairloom.llm import simhash
from pairloom.llm.graph import connected_components

SCHEMA = "track_id long, lyrics string, path string"


def brute(rows):
    prints = {}
    for track, text in rows:
        words = (text or "").encode().lower().split()
        n = max(1, len(words) - 2)
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)] if words else []
        prints[track] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    root = {t: t for t in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] < root[b]:
                    root[b], changed = root[a], True
    return {(t, f"{prints[t]:016x}", root[t]) for t in prints}


def test_groups_match_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for base in range(12):
        text = [rnd.choice(vocab) for _ in range(rnd.choice([2, 5, 60, 200]))]
        for copy in range(8):
            words = list(text)
            for _ in range(copy % 3):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append((100 * base + copy, "\t".join(words).upper() if copy == 7 else " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "one"), (5004, "ONE "), (5005, "É x"), (5006, "x " * 70000)]
    tracks = spark.createDataFrame([(i, t, "p") for i, t in rows], SCHEMA).withColumn("fp", F.lit(1))
    got = {tuple(r) for r in simhash.near_duplicate_groups(tracks).collect()}
    assert got == brute(rows)


def test_large_cells_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    rnd = random.Random(9)
    prints = {rnd.getrandbits(64) for _ in range(20)}
    for p in list(prints)[:3]:
        for _ in range(60):
            prints.add(p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r.node: r.root for r in connected_components(links).collect()}
    want = {p: p for p in signed}
    for _ in signed:
        step = {p: min(want[q] for q in signed if ((p ^ q) & (2**64 - 1)).bit_count() <= 2) for p in signed}
        if step == want:
            break
        want = step
    assert all(got.get(p, p) == want[p] for p in signed)


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d", None), (3, "a b c d", None), (3, "a b c d", None), (None, "zz yy", None)]
    got = simhash.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.track_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_components_of_a_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(7, 7), (900, 901)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(200)}, 900: 900, 901: 900}
