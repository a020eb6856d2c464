import hashlib
import random

import numpy as np
import pytest

from pairloom.llm import repeats
from pairloom.llm.queries import op3_repeated_strings
from pairloom.llm.repeats import longest_previous_factors, without_repeats

SCHEMA = "track_id long, lyrics string, kept string"


def brute(texts):
    """texts: (id, bytes) with distinct ids."""
    seen, out = set(), {}
    for track, raw in sorted(texts):
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = hashlib.blake2b(raw[s : s + 100], digest_size=16).digest()
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[track] = (len(raw), [tuple(e) for e in edges.reshape(-1, 2).tolist()], kept)
    return out


def made_texts():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("aeiouñlmst") for _ in range(rnd.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rnd.choice([20, 60, 200]))) for _ in range(8)]
    texts = []
    for t in range(150):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 80)))]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(passages), word()]
        texts.append((t * 3, " ".join(parts)))
    texts += [(1000 + i, texts[4][1] + "!" * i) for i in range(12)] + [(2000, "ab" * 700), (2001, "x" * 333), (2002, "x" * 99), (2003, ""), (2004, "ab" * 60), (2005, "\x00" * 250)]
    return texts


@pytest.mark.parametrize("large", [2048, 3])
def test_same_as_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(repeats, "LARGE", large)
    texts = made_texts()
    rows = [(i, t, "old") for i, t in texts] + [(5000, None, "old"), (None, texts[4][1], "old")]
    got = without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = brute([(i, t.encode()) for i, t in texts])
    assert len(got) == len(rows)
    for r in got:
        if r.track_id is None:
            assert bytes(r.kept) == texts[4][1].encode() and r.spans == []
        elif r.track_id == 5000:
            assert (r.n_bytes, r.spans, bytes(r.kept)) == (0, [], b"")
        else:
            assert (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) == want[r.track_id]


def test_chunks_change_nothing(spark, monkeypatch):
    texts = made_texts()
    def names(text):
        return [(g, f + k) for gs, _, fs, ns in repeats.segments(text) for g, f, n in zip(gs, fs, ns) for k in range(n)]
    whole = [names(t.encode()) for _, t in texts[:40]]
    monkeypatch.setattr(repeats, "CHUNK", 37)
    assert [names(t.encode()) for _, t in texts[:40]] == whole


def test_previous_factors():
    text = b"abracadabra" * 3
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 4)
    got = longest_previous_factors(windows, np.arange(len(windows))) >= 4
    assert got.tolist() == [text[i : i + 4] in [text[j : j + 4] for j in range(i)] for i in range(len(windows))]


def test_whole_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute([(r.doc_id, (r.text or "").encode()) for r in docs])
    for r in op3_repeated_strings(spark, sf).collect():
        size, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (size, sum(b - a for a, b in spans), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_empty_and_repeated_rows(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "some words that go on and on " * 3 + "until the line is long enough to count as one whole string of its own"
    rows = spark.createDataFrame([(1, text, ""), (1, text, ""), (2, text, "")], SCHEMA)
    assert sorted((r.track_id, len(r.kept)) for r in without_repeats(rows).collect()) == [(1, len(text)), (1, len(text)), (2, 0)]


def test_an_id_with_a_long_and_a_short_text(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("aeioulmst") for _ in range(rnd.randint(1, 7)))
    shared, own = (" ".join(word() for _ in range(60)) for _ in "12")
    long = own + " " + shared + " " + " ".join(word() for _ in range(90))
    other = " ".join(word() for _ in range(40)) + " " + shared + "!"
    rows = [(5, long, ""), (5, "short", ""), (5, other[:150], ""), (3, shared + " tail", ""), (9, other, ""), (9, None, "")]
    rows += [(20 + i, shared[i:] + f" {i} " + own[: 200 + i], "") for i in range(5)]
    got = without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)

    def of(track, text):
        raw = (text or "").encode()
        return next(r for r in got if r.track_id == track and r.n_bytes == len(raw))

    # every string's earliest place, over all texts of an id
    places = {}
    for track, text, _ in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - 99):
            places.setdefault(raw[s : s + 100], set()).add((track, s))
    pooled = {}
    for track, text, _ in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - 99):
            if min(places[raw[s : s + 100]]) < (track, s):
                pooled.setdefault(track, set()).update(range(s, s + 100))
    for track, text, _ in rows:
        raw = (text or "").encode()
        gone = {k for k in pooled.get(track, ()) if k < len(raw)}
        row = of(track, text)
        assert {k for s in row.spans for k in range(s.start, s.stop)} == gone
        assert bytes(row.kept) == bytes(c for k, c in enumerate(raw) if k not in gone)
