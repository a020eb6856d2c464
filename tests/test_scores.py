import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from pairloom.functions import cosine01
from pairloom.operators import evaluation as ev
from pairloom.operators import model as md
from pairloom.operators import profiling as prof
from pairloom.operators import similarity as sim
from pairloom.operators import store


def frames(spark, tracks):
    rows = [(k, f, b, float(v)) for k, m in tracks.items() for f, row in enumerate(m) for b, v in enumerate(row)]
    return spark.createDataFrame(rows, "track_id string, frame int, band int, value double")


def pair(spark, *pairs):
    return spark.createDataFrame(list(pairs), "track_a_path string, track_b_path string")


def warp(x, y):
    x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    cost = 1 - x @ y.T
    acc = np.full((len(x) + 1, len(y) + 1), np.inf)
    acc[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            acc[i + 1, j + 1] = cost[i, j] + min(acc[i, j], acc[i, j + 1], acc[i + 1, j])
    return acc[-1, -1]


def test_alignment_paths(spark):
    rng = np.random.default_rng(5)
    tracks = {"a": rng.random((30, 12)), "b": rng.random((25, 12)), "long": rng.random((230, 12)), "one": rng.random((1, 12))}
    df = frames(spark, tracks)
    pairs = pair(spark, ("a", "b"), ("a", "a"), ("a", "long"), ("one", "a"))
    got = {(r[0], r[1]): r["melodic"] for r in sim.melodic_similarity(pairs, df).collect()}
    for p in [("a", "b"), ("a", "long")]:
        want = 1 - warp(tracks[p[0]], tracks[p[1]]) / (len(tracks[p[0]]) + len(tracks[p[1]]))
        assert math.isclose(got[p], min(1, max(0, want)), rel_tol=1e-9)
    assert got[("a", "a")] > 0.999999 and got[("one", "a")] == 0.0


def test_structure_against_matrices(spark):
    rng = np.random.default_rng(6)
    tracks = {"a": rng.random((40, 12)), "b": rng.random((25, 12)), "flat": np.ones((10, 12)), "zero": np.zeros((9, 12))}
    pairs = pair(spark, ("a", "b"), ("a", "a"), ("a", "flat"), ("a", "zero"))
    got = {(r[0], r[1]): r["structural"] for r in sim.structural_similarity(pairs, frames(spark, tracks)).collect()}

    def resized(x, m):
        x = x / np.abs(x).max(axis=1)[:, None]
        s = x @ x.T
        at = np.arange(m) * (len(x) - 1) / (m - 1)
        lo = np.minimum(np.floor(at).astype(int), len(x) - 2)
        w = at - lo
        rows = s[lo] * (1 - w)[:, None] + s[lo + 1] * w[:, None]
        return rows[:, lo] * (1 - w) + rows[:, lo + 1] * w

    want = (np.corrcoef(resized(tracks["a"], 25).ravel(), resized(tracks["b"], 25).ravel())[0, 1] + 1) / 2
    assert math.isclose(got[("a", "b")], want, rel_tol=1e-9)
    assert math.isclose(got[("a", "a")], 1.0, rel_tol=1e-9)
    assert got[("a", "flat")] == 0.0 and got[("a", "zero")] == 0.0


def test_null_rules(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine01(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]
    docs = spark.createDataFrame([("a", "x y"), ("b", " "), ("c", ""), ("d", "X y y")], "track_id string, text string")
    got = {(r[0], r[1]): r["lyrical"] for r in sim.text_similarity(pair(spark, ("a", "b"), ("b", "c"), ("a", "d")), docs).collect()}
    assert got[("a", "b")] == 0.0 and got[("b", "c")] is None
    assert math.isclose(got[("a", "d")], 3 / math.sqrt(2 * 5))


def test_blend_and_confidence(spark):
    df = spark.createDataFrame([("a", "b", 0.9, 0.9, 0.9, None), ("c", "d", 0.5, 0.1, 0.9, 0.2)], "track_a_path string, track_b_path string, melodic double, timbral double, structural double, neural double")
    rows = sim.confidence(sim.attribution_score(df)).collect()
    assert math.isclose(rows[0]["attribution_score"], 0.9) and rows[0]["confidence"] == "high"
    want = (0.15 * 0.5 + 0.15 * 0.1 + 0.1 * 0.9 + 0.3 * 0.2) / 0.7
    assert math.isclose(rows[1]["attribution_score"], want)
    assert math.isclose(rows[1]["component_std"], np.std([0.5, 0.1, 0.9, 0.2]))


def test_artifact_score_range(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=22).tolist(),) for _ in range(50)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(sim.artifact_score(F.col("v"))).collect()]
    assert all(0 <= g <= 1 for g in got)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    rows = [(float(round(s, 2)), int(rng.random() < s)) for s in rng.random(3000)]
    return spark.createDataFrame(rows, "score double, label int").persist()


def test_auc_and_roc(scored):
    got = ev.auc(scored).first()["auc"]
    raw = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(scored.withColumn("label", F.col("label").cast("double")))
    assert math.isclose(got, raw, rel_tol=1e-9)
    points = ev.roc_curve(scored).orderBy(F.desc("threshold")).collect()
    assert (points[0]["fpr"], points[0]["tpr"]) == (0.0, 0.0) and (points[-1]["fpr"], points[-1]["tpr"]) == (1.0, 1.0)
    assert all(p["fpr"] <= q["fpr"] and p["tpr"] <= q["tpr"] for p, q in zip(points, points[1:]))


def test_one_class_and_zero_division(scored):
    one = scored.where("label = 1")
    assert ev.auc(one).first()["auc"] == 0.0
    row = ev.binary_metrics(ev.predict(scored, 2.0, True)).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_histogram_loses_nothing(scored):
    assert ev.score_histogram(scored).agg(F.sum("n")).first()[0] == 3000


def test_losses(spark):
    rows = [(x, y) for x, y in zip([0.3, -1.2, 2.0, 0.1, -0.4, 1.5, -2.2, 0.9], [1, 0, 1, 0, 1, 1, 0, 0])]
    df = spark.createDataFrame(rows, "logit double, label int")
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    want = np.mean(-(y * np.log(1 / (1 + np.exp(-x))) + (1 - y) * np.log(1 - 1 / (1 + np.exp(-x)))))
    assert math.isclose(md.bce_loss(df).first()[0], want, rel_tol=1e-9)
    assert md.focal_loss(df, smoothing=0.1).first()[0] > 0


def test_stats(spark):
    rng = np.random.default_rng(42)
    rows = [(rng.normal(7, 3, 20).tolist(),) for _ in range(50)]
    df = spark.createDataFrame(rows, "features array<double>")
    row = store.feature_stats(df).first()
    x = np.array([r[0] for r in rows])
    assert np.allclose(row["mean"], x.mean(axis=0)) and np.allclose(row["std"], x.std(axis=0, ddof=1))
    z = np.array([r[0] for r in store.standardise(df, store.feature_stats(df)).collect()])
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9)
    with pytest.raises(Exception, match="too few"):
        store.feature_stats(df.limit(1)).collect()


@pytest.mark.parametrize("t,v,want", [(2.0, 10.0, 0.07338803), (1.0, 1.0, 0.5), (0.0, 5.0, 1.0), (-4.5, 30.0, 0.0000961)])
def test_welch_tail(t, v, want):
    import pandas as pd

    assert abs(prof._beta_tail(pd.Series([t]), pd.Series([v])).iloc[0] - want) < 1e-6


def test_pca_against_eigenvalues(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)) * np.array([5, 3, 1, 1, 0.5, 0.1])
    rows = [("g" if i % 3 else "h", x[i].tolist()) for i in range(300)]
    got = prof.pca_profile(spark.createDataFrame(rows, "g string, vector array<double>"), "g", k=6).where("g = 'g'").orderBy("component").collect()
    part = np.array([r[1] for r in rows if r[0] == "g"])
    values = np.linalg.eigvalsh(np.cov(part.T))[::-1]
    want = np.cumsum(values) / values.sum()
    assert np.allclose([r["cumulative"] for r in got], want)
    assert got[0]["needed"] == int(np.searchsorted(want, 0.9)) + 1


def test_a_batch_that_is_too_large_fails(spark):
    rows = spark.range(50).selectExpr("1 as batch", "id as row", "int(id % 2) as label", "array(1D, id + 0D) as vector_a", "array(2D, id + 0D) as vector_b")
    assert md.bounded_batches(rows, 50).count() == 50
    with pytest.raises(Exception, match="more than 49 rows"):
        md.bounded_batches(rows, 49).collect()


def test_tracks_without_frames_score_zero(spark):
    rows = [("a", f, b, float((f * 3 + b) % 5)) for f in range(6) for b in range(3)]
    table = spark.createDataFrame(rows, "track_id string, frame long, band long, value double")
    pairs = spark.createDataFrame([("a", "a"), ("a", "none"), ("none", "other")], "track_a_path string, track_b_path string")
    for score, name in ((sim.melodic_similarity, "melodic"), (sim.structural_similarity, "structural")):
        got = {(r[0], r[1]): r[name] for r in score(pairs, table).collect()}
        assert len(got) == 3 and got["a", "a"] > 0.9 and got["a", "none"] == got["none", "other"] == 0.0


def test_the_split_of_a_model_moves_no_features(spark, monkeypatch):
    from checks import model as checked

    given = []
    split = checked.stratified_split
    monkeypatch.setattr(checked, "stratified_split", lambda df, **settings: given.append(df.dtypes) or split(df, **settings))
    rows = checked.QUERIES["g04_fit_pair_model"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 0 and all(0 <= r["score"] <= 1 for r in rows)
    assert not [kind for _, kind in given[0] if kind.startswith("array")]


def test_structure_keeps_bands_in_rows(spark):
    rng = np.random.default_rng(11)
    x, y = rng.random((30, 5)), rng.random((17, 5))
    df = sim.structural_similarity(pair(spark, ("a", "b"), ("a", "a"), ("a", "gone")), frames(spark, {"a": x, "b": y}))
    got = {r[1]: r["structural"] for r in df.collect()}
    assert abs(got["a"] - 1.0) < 1e-9 and got["gone"] == 0.0 and 0.0 < got["b"] < 1.0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 6 and plan.count("Generate ") <= 5


def test_texts_travel_in_batches_of_few_rows(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        docs = spark.range(3).select(F.col("id").alias("track_id"), F.lit("a b a").alias("text"))
        terms = sim.packed_terms(docs)
        assert int(spark.conf.get(key)) == sim.TEXTS_TOGETHER
        assert sorted(terms.first()["terms"]["tf"]) == [1, 2]
    finally:
        spark.conf.set(key, before)
