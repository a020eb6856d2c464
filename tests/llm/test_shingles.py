import random

import corpus_pipeline
from pairloom.llm import shingles

SCHEMA = "doc_id long, text string, source string"


def shingle_texts(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = {t: shingle_texts(x) for t, x in rows}
    root = {t: t for t in sets}
    near = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            changed |= root[a] != root[b]
            root[a] = root[b] = low
    return set(root.values()), near


def edited(rnd, words, times):
    words = list(words)
    for _ in range(times):
        words[rnd.randrange(len(words))] = rnd.choice("abcdefgh") * 5
    return " ".join(words)


def test_stage_keeps_one_of_all_texts_with_similarity_08(spark, monkeypatch):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    line = [rnd.choice(vocab) for _ in range(40)]
    rows = []
    for base in range(30):
        text = [rnd.choice(vocab) for _ in range(rnd.choice([3, 60, 250]))] + line * (base % 2)
        rows += [(100 * base + copy, edited(rnd, text, copy * len(text) // 100)) for copy in range(7)]
    rows += [(9000 + i, edited(rnd, line * 3, i % 9)) for i in range(60)]
    rows += [(9900, None), (9901, ""), (9902, " \n"), (9903, "one"), (9904, "ONE ")]
    rnd.shuffle(rows)
    want, near = brute(rows)
    prints = {t: shingles.shingle_set((x or "").encode()) for t, x in rows}
    assert len(near) > 100 and len(want) > 40
    assert any(list(prints[a]) != list(prints[b]) for a, b in near)
    docs = spark.createDataFrame([(t, x, "s") for t, x in rows], SCHEMA)
    for stars, sampled in ((2, 16), (0, 1), (1, 1)):
        monkeypatch.setattr(shingles, "STARS", stars)
        monkeypatch.setattr(shingles, "SAMPLED", sampled)
        kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, None).collect()
        assert {r.doc_id for r in kept} == want and len(kept) == len(want)


def test_stage_on_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, None).collect()
    assert {r.doc_id for r in kept} == want
