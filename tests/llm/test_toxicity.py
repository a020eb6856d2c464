import random
import zlib


from pairloom.llm.queries import op4_toxicity
from pairloom.llm.toxicity import toxicity_scores

SCHEMA = "track_id long, lyrics string, score string"
SF = "/root/testdata/sf0.1"


def auc(rows):
    ranked = sorted(rows)
    pos = [i for i, (_, y) in enumerate(ranked, 1) if y]
    n = len(pos)
    return (sum(pos) - n * (n + 1) / 2) / (n * (len(ranked) - n))


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op4_toxicity(spark, SF).collect()
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(r.predicted and labels[r.doc_id] for r in held)
    precision, recall = hit / sum(r.predicted for r in held), hit / sum(labels[r.doc_id] for r in held)
    by_lang = auc([(r.score, labels[r.doc_id]) for r in held])
    print("precision", precision, "recall", recall, "auc", by_lang)
    assert precision > 0.8 and recall > 0.8 and by_lang > 0.9


def test_edge_cases(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["la", "moon", "sun", "day"]) for _ in range(30)) + (" vile wretch" if i % 4 == 0 else ""), "x") for i in range(80)]
    rows += [(100, None, None), (101, "", None), (None, "vile wretch", None), (102, "VILE, wretch!\n" * 30000, None), (3, "la", None), (3, "la", None)]
    tracks = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(5, None), (None, 1), (7, 0)], "track_id long, toxic int")
    got = toxicity_scores(tracks, labels).collect()
    assert len(got) == len(rows)
    by = {r.track_id: r for r in got}
    assert by[None].predicted == 1 and by[102].predicted == 1 and by[101].score == by[100].score < 0.3
    assert sum(r.predicted for r in got) == 22
    assert {r.score for r in toxicity_scores(tracks, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity_scores(tracks, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity_scores(tracks.limit(0), labels).count() == 0
