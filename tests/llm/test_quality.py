import numpy as np
import pytest

from pairloom.llm.queries import op12_quality
from pairloom.llm.quality import N_FEATURES, AttentionModel, fitted_model, passage_features, quality_scores

SF = "/root/testdata/sf0.01"
SCHEMA = "track_id long, lyrics string, score string, quality string"


def test_held_out_quality(spark):
    scored = op12_quality(spark, SF)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(truth, "doc_id").where("held_out").collect()
    low = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert sum(r.predicted == 0 for r in low) >= 0.7 * len(low)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_gradients_are_those_of_the_loss():
    rnd = np.random.default_rng(1)
    x, starts, y = rnd.normal(size=(23, N_FEATURES)), np.array([0, 1, 5, 9, 20]), np.array([0.0, 1, 1, 0, 1])
    model = AttentionModel.fit(x, starts, y, rounds=3)

    def loss():
        p = model.forward(x, starts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 5e-5 * sum((v**2).sum() for v in model.weights)

    for v, g in zip(model.weights, model.gradients(x, starts, y)):
        for at in [tuple(rnd.integers(0, n) for n in v.shape) for _ in range(6)]:
            old = v[at]
            v[at] = old + 1e-5
            up = loss()
            v[at] = old - 1e-5
            slope = (up - loss()) / 2e-5
            v[at] = old
            assert g[at] == pytest.approx(slope, abs=1e-7, rel=1e-4)
    f = model.forward(x, starts)
    assert np.allclose(np.add.reduceat(f["a"], starts), 1)
    parts = [x[a:b] for a, b in zip(starts, [*starts[1:], 23])]
    assert np.allclose(model.scores(parts), [model.scores([p])[0] for p in parts])


def test_attention_finds_the_passage_that_counts():
    rnd = np.random.default_rng(2)
    bags, y = [], []
    for k in range(400):
        bag = rnd.normal(size=(int(rnd.integers(1, 9)), N_FEATURES))
        bag[:, 0] = 0
        if k % 2:
            bag[rnd.integers(0, len(bag)), 0] = 1
        bags.append(bag)
        y.append(float(k % 2))
    starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
    model = AttentionModel.fit(np.concatenate(bags), starts, np.array(y))
    assert ((model.scores(bags) >= 0.5) == np.array(y)).mean() > 0.97
    weights = model.forward(np.concatenate(bags), starts)
    marked = np.concatenate(bags)[:, 0] > 0
    many = np.diff(np.r_[starts, len(marked)])[weights["of"]] > 3
    assert weights["a"][marked & many].mean() > 2 * weights["a"][~marked & many].mean()


def test_nulls_empty_tables_and_one_kind_of_labels(spark):
    rows = [(1, "good words in a line that goes on", "x", "y"), (2, None, None, None), (3, "", None, None), (None, "### $$$ !!!", None, None), (4, "### $$$ %%% " * 50000, None, None), (1, "good words in a line that goes on", "x", "y")]
    tracks = spark.createDataFrame(rows, SCHEMA)
    labels = lambda *x: spark.createDataFrame(list(x), "track_id long, quality int")
    got = quality_scores(tracks, labels((1, 1), (4, 0), (None, 1), (2, None), (77, 0))).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by_id = {r.track_id: r.score for r in got}
    assert by_id[1] > 0.5 > by_id[4]
    assert quality_scores(tracks.limit(0), labels((1, 1), (4, 0))).count() == 0
    assert {r.score for r in quality_scores(tracks, labels((1, 1))).collect()} == {1.0}
    assert {r.score for r in quality_scores(tracks, labels()).collect()} == {0.0}
    assert isinstance(fitted_model(tracks, labels((1, 1), (1, 0))), float)
    assert passage_features(None).shape == passage_features(b" \n").shape == (1, N_FEATURES)
    assert len(passage_features(b"a " * 1000)) == 16
