import random

from pairloom.llm import maxscore
from pairloom.llm.maxscore import top_k_tracks

SCHEMA = "track_id long, vector array<long>, score string"


def brute(rows, asked, k):
    out = set()
    for q, v in asked:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), t) for t, w in rows if t != q)[:k]
        out |= {(q, n, t, -s) for n, (s, t) in enumerate(scores, 1)}
    return out


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 40)
    monkeypatch.setattr(maxscore, "GROUP_ROWS", 150)
    rnd = random.Random(2)
    rows = [(i, [rnd.randint(-60, 60) if rnd.random() < 0.7 else 0 for _ in range(12)]) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, [0] * 12), (2001, [-5] * 12), (2002, [3])]
    asked = [r for r in rows if r[0] % 20 == 0] + [rows[7], (2001, [-5] * 12)]
    tracks = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    queries = spark.createDataFrame([(*r, "x") for r in asked], SCHEMA)
    assert {tuple(r) for r in top_k_tracks(tracks, queries).collect()} == brute(rows, asked, 5)


def test_few_null_and_repeated_rows(spark):
    rows = [(1, [1, 2], None), (2, [3, None], None), (3, None, None), (None, [9, 9], None), (4, [2, 2], None), (4, [2, 2], None), (5, [], None)]
    tracks = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in top_k_tracks(tracks, tracks.where("track_id = 1")).collect()}
    assert got == {(1, 1, 4, 6), (1, 2, 5, 0)}
    none = spark.createDataFrame([], SCHEMA)
    assert top_k_tracks(none, tracks).count() == top_k_tracks(tracks, none).count() == 0
