import random

import numpy as np

from pairloom.llm import decontamination as dec
from pairloom.llm.decontamination import contaminated_passages, edits_of_best_passage, fewest_edits, plain

SCHEMA = "track_id long, lyrics string, item_id string"


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
    return min(row)


def test_edit_distance_is_exact():
    rnd = random.Random(4)
    for _ in range(300):
        item = bytes(rnd.choice(b"abc ") for _ in range(rnd.randint(1, 90)))
        text = bytes(rnd.choice(b"abc ") for _ in range(rnd.randint(0, 120)))
        assert edits_of_best_passage(item, text)[0] == edits(item, text)


def test_fewest_edits_are_those_of_the_whole_text():
    rnd = random.Random(11)
    for _ in range(400):
        item = bytes(rnd.choice(b"abcdef ") for _ in range(rnd.randint(10, 90)))
        copies = [edited(rnd, item.decode(), share, ["change", "insert", "remove"]).encode() for share in (0.02, 0.05, rnd.choice((0, 0.1, 0.2)))]
        text = b" ".join(x for c in copies for x in (c, bytes(rnd.choice(b"abcdef ") for _ in range(rnd.randint(0, 300)))))
        want = edits_of_best_passage(item, text)
        for known in (want[0], want[0] + 1, want[0] + 4):
            assert fewest_edits(item, text, known) == want


def test_few_windows_walk_to_their_end(monkeypatch):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(30)).encode()) for i in range(50)]
    index = dec.ItemIndex(items)
    finished, whole = [], dec.Walks.finish
    monkeypatch.setattr(dec.Walks, "finish", lambda self, buffer, at, keys, walk: (finished.append(len(at)), whole(self, buffer, at, keys, walk)))
    texts = [" ".join(word() for _ in range(5000)).encode(), items[7][1] + b" and more"]
    pruned = index.hits(texts)
    assert sum(finished) < 0.4 * len(index.classes) * index.classes[0].walks.walks * 5000
    for mark in (m for c in index.classes for m in c.early):
        mark[:] = True
    assert len(pruned) and np.array_equal(pruned, index.hits(texts))


def test_planted_passages_and_brute_force(spark):
    rnd = random.Random(8)
    syllables = ["ra", "mo", "ti", "on", "sel", "ka", "ber", "lu", "é", "th"]
    words = lambda n: [("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))) for _ in range(n)]
    items = [(i, " ".join(words(rnd.randint(14, 60)))) for i in range(40)]
    rows, planted = [], set()
    for t in range(120):
        text = words(rnd.randint(0, 200))
        if t % 3 == 0:
            i, passage = rnd.choice(items)
            passage = list(passage)
            for _ in range(int(len(passage) * (t % 4) * 0.02)):  # up to 6 % of the characters
                passage[rnd.randrange(len(passage))] = rnd.choice("xyz")
            at = rnd.randint(0, len(text))
            text[at:at] = ["".join(passage).upper().replace(" ", ",\n", 2)]
            planted.add((t, i))
        rows.append((t, " ".join(text), "x"))
    rows += [(900, None, None), (901, "", None), (None, items[0][1], None), (902, "la " * 50000 + items[1][1], None), (902, "x", None)]
    tracks = spark.createDataFrame(rows, SCHEMA)
    held = spark.createDataFrame([*items, (99, None), (None, "some text"), (98, "")], "item_id long, text string")
    got = contaminated_passages(tracks, held).collect()
    want = {
        (t, i): e
        for t, x, _ in rows if x and len(x) < 20000
        for i, y in items if (e := edits_of_best_passage(plain(y.encode()), plain(x.encode()))[0]) <= int(0.2 * len(plain(y.encode())))
    } | {(902, 1): 0}
    found = {(r.track_id, r.item_id): r.edits for r in got}
    assert planted <= set(want) and set(found) <= set(want)
    assert len(found) >= 0.97 * len(want) and {(902, 1), (None, 0)} <= set(found)
    assert all(found[k] == want[k] for k in found)
    assert contaminated_passages(tracks, held.limit(0)).count() == contaminated_passages(tracks.limit(0), held).count() == 0


def test_blocks_give_the_same_rows(spark):
    items = spark.createDataFrame([(i, f"line {i} of the song that nobody sings twice in the morning light {i * i}") for i in range(20)], "item_id long, text string")
    tracks = items.selectExpr("item_id + 100 as track_id", "concat('before it ', text, ' and after') as lyrics")
    rows = [{tuple(r) for r in contaminated_passages(tracks, items, similarity=0.98, item_block=n).collect()} for n in (3, 5000)]
    assert rows[0] == rows[1] and len(rows[0]) >= 20


def test_items_with_equal_text_have_a_row_each(spark):
    text = "the words of a song that two benchmark tables hold under three different numbers and one that shares a number"
    other = "some quite different question about rivers and mountains which nobody has ever answered in one short sentence"
    items = spark.createDataFrame([(7, text), (3, text), (9, text), (3, text), (3, other)], "item_id long, text string")
    tracks = spark.createDataFrame([(1, f"before {text} after"), (2, f"before {other} after"), (None, text)], "track_id long, lyrics string")
    got = sorted((r.track_id or 0, r.item_id, r.edits, r.item_length) for r in contaminated_passages(tracks, items).collect())
    assert got == sorted([(t, i, 0, len(text)) for t in (0, 1) for i in (3, 7, 9)] + [(2, 3, 0, len(other))])


def edited(rnd, item, share, kinds):
    out = list(item)
    for _ in range(int(share * len(item))):
        at, kind, c = rnd.randrange(len(out)), rnd.choice(kinds), rnd.choice("abcdefghijklmnopqrstuvwxyz ")
        if kind == "insert":
            out.insert(at, c)
        else:
            out[at : at + 1] = [c] if kind == "change" else []
    return "".join(out)


def test_recall_by_share_of_edits(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    rnd, rows, want = random.Random(3), [], {}
    for share in (0.1, 0.15, 0.2):
        for kinds in (["change"], ["change", "insert", "remove"]):
            for i, text in items:
                track = len(rows)
                rows.append((track, f"some words before {edited(rnd, text, share, kinds)} and some after it", None))
                item, whole = plain(text.encode()), plain(rows[-1][1].encode())
                if edits_of_best_passage(item, whole)[0] <= int(0.2 * len(item)):
                    want.setdefault((share, len(kinds)), set()).add((track, i))
    found = {(r.track_id, r.item_id) for r in contaminated_passages(spark.createDataFrame(rows, SCHEMA).repartition(8), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = {k: len(found & v) / len(v) for k, v in want.items()}
    assert min(len(v) for v in want.values()) > 100 and min(recall.values()) >= 0.95, recall


def test_short_items(spark):
    items = [(1, "What is it?"), (2, "la"), (3, "the red door opens at noon"), (4, "a caption of some fifty bytes, no more than that."), (5, "Ünïcode wörds")]
    rows = [(1, "and what is it then, la la", ""), (2, "WHAT IS IT", ""), (3, "somewhat is it", ""), (4, "when the red door opens at noon!", ""), (5, "so: a caption of some fifty bites, no more than that.", ""), (6, "ünïcode wörds Ünïcode wörds", ""), (7, "", ""), (8, "the red door opens at noonday", "")]
    got = {(r.track_id, r.item_id): r.edits for r in contaminated_passages(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (2, 1): 0, (4, 3): 0, (5, 4): 1, (6, 5): 0}
