import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.operators import augment as aug
from pairloom.operators import block_augment as block
from pairloom.operators import blocks
from pairloom.operators import descriptors as d
from pairloom.operators import kernels
from pairloom.operators import windows as win
from pairloom.operators.spectrum import block_mean_magnitude, block_spectrum, long_spectrum, mean_magnitude, spectrum
from pairloom.plans import feature_job


def series(spark, tracks):
    frames = [
        pd.DataFrame({"track_id": k, "pos": np.arange(len(v)), "value": np.asarray(v, float), "n": len(v)}) for k, v in tracks.items()
    ]
    return spark.createDataFrame(pd.concat(frames))


@pytest.mark.parametrize("n,want", [(3, 1), (10, 1), (12, 2), (30, 5), (60, 11)])
def test_window_counts(spark, n, want):
    got = spark.range(1).select(win.window_count(F.lit(n * 16000), 160000, 80000).alias("k")).first()["k"]
    assert got == want


def test_last_window_is_padded(spark):
    s = series(spark, {"a": np.ones(12), "b": np.ones(3)})
    rows = {(r["track_id"], r["chunk"], r["i"]): r["value"] for r in win.chunk_rows(s, 10, 5).collect()}
    assert len(rows) == 30
    assert [rows[("a", 1, i)] for i in range(10)] == [1.0] * 7 + [0.0] * 3
    assert [rows[("b", 0, i)] for i in range(10)] == [1.0] * 3 + [0.0] * 7


def test_array_and_row_windows_agree(spark):
    values = np.arange(1.0, 48.0)
    rows = win.chunk_rows(series(spark, {"a": values}), 10, 4)
    arrays = win.chunk_array(spark.createDataFrame([("a", values.tolist())], "track_id string, x array<double>"), "x", 10, 4)
    flat = arrays.select("track_id", "chunk", F.posexplode("samples").alias("i", "value"))
    assert rows.exceptAll(flat).count() == 0 and flat.exceptAll(rows).count() == 0


def test_frames_hold_their_own_windows(spark):
    got = win.framed_chunks(series(spark, {"a": np.ones(60)}), 30, 10, 5)
    assert got.select("frame", "chunk").distinct().count() == 10


def test_full_size_features(spark):
    t = np.arange(48000) / 16000
    tracks = {
        "sine": 0.5 * np.sin(2 * np.pi * 440 * t),
        "noise": 0.1 * np.random.default_rng(42).standard_normal(48000),
        "silence": np.zeros(48000),
        "short": 0.5 * np.sin(2 * np.pi * 440 * t[:1600]),
    }
    rows = {r["track_id"]: np.array(r["features"]) for r in feature_job.window_vectors(series(spark, tracks)).collect()}
    assert feature_job.TIER1_SIZE == 430 and feature_job.TIER2_SIZE == 22
    for vector in rows.values():
        assert vector.shape == (452,) and np.isfinite(vector).all()
    # 440 Hz is pitch class A
    assert int(np.argmax(rows["sine"][376:388])) == 69 % 12
    assert rows["silence"][430 + 12 :].max() == 0.0
    assert rows["noise"][430 + 8] > rows["sine"][430 + 8]


def test_blocks_give_the_windows_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    s = series(spark, {"a": rng.random(997), "b": rng.random(3), "c": rng.random(64), "d": rng.random(300)})
    whole = lambda: lambda samples: samples.copy()
    for w, stride, size in ((64, 32, 50), (64, 7, 1000), (10, 25, 16), (400, 130, 37)):
        for tile in (blocks.BLOCK, 128):
            monkeypatch.setattr(blocks, "BLOCK", tile)
            got = blocks.map_windows(blocks.block_table(s, size), w, stride, whole)
            flat = got.select("track_id", "chunk", F.posexplode("features").alias("i", "value"))
            want = win.chunk_rows(s, w, stride)
            assert flat.exceptAll(want).count() == 0 and want.exceptAll(flat).count() == 0


def test_harmonics_to_noise_of_tones_and_noise():
    t = np.arange(160000) / 16000
    noise = np.random.default_rng(1).standard_normal(160000)
    tone = np.sin(2 * np.pi * 200 * t)
    values = {}
    for name, x in {"tone": tone, "noisy": tone + 0.316 * noise, "noise": noise, "silence": 0 * t}.items():
        values[name] = kernels.window_slots(x[None], 2048, 512, 16000, ("hnr",), {})[0, 0]
    assert values["tone"] > 30 and values["silence"] == 0.0
    assert values["noise"] < 0 and abs(values["noisy"] - 7.0) < 2.0


def test_spectrum_against_direct_transform(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(256)
    for path in ("join", "fft"):
        rows = spectrum(win.chunk_rows(series(spark, {"a": x}), 256, 128), 256, 64, 16, path).collect()
        got = {(r["frame"], r["bin"]): complex(r["re"], r["im"]) for r in rows}
        padded = np.concatenate([np.zeros(32), x, np.zeros(32)])
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
        for f in range(17):
            want = np.fft.rfft(padded[f * 16 : f * 16 + 64] * hann)
            assert np.allclose([got[(f, k)] for k in range(33)], want, atol=1e-7)


@pytest.mark.parametrize("n,hop,ends", [(64, 8, "reflect"), (256, 64, "constant"), (30, 10, "constant")])
def test_joined_spectrum_keeps_a_row_per_group_of_bins(spark, n, hop, ends):
    rng = np.random.default_rng(5)
    chunks = win.chunk_rows(series(spark, {"a": rng.standard_normal(700), "b": rng.random(5)}), 256, 128)
    joined = spectrum(chunks, 256, n, hop, "join", ends)
    got, want = ({tuple(r)[:4]: (r["re"], r["im"]) for r in df.collect()} for df in (joined, spectrum(chunks, 256, n, hop, "fft", ends)))
    assert got.keys() == want.keys() and all(np.allclose(got[k], v, atol=1e-8) for k, v in want.items())
    # sums are kept by (window, frame, group of bins), not by bin
    keys = [line.split("[")[1].split("]")[0] for line in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert any("frame" in line for line in keys) and not any("bin#" in line for line in keys)


def test_vectors_by_join_are_those_of_rows_with_a_row_per_window(spark, monkeypatch):
    rng = np.random.default_rng(6)
    s = series(spark, {"a": 100 * rng.random(150), "b": rng.standard_normal(3), "c": np.zeros(70)})
    monkeypatch.setattr(feature_job, "ROWS", 2)
    got = {}
    for path in ("join", None):
        for make in (feature_job.window_vectors_by_join, feature_job.window_vectors_by_rows):
            df = make(s, 64, 32, 64, 8, 16000, path)
            got[path, make.__name__] = {(r["track_id"], r["chunk"]): np.array(r["features"]) for r in df.collect()}
        # no sorted rows of bins or bands, nothing united slot by slot
        plan = feature_job.window_vectors_by_join(s, 64, 32, 64, 8, 16000, path)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window [" not in plan and plan.count("Aggregate [") == (3 if path else 1)
    want = got[None, "window_vectors_by_rows"]
    assert len(want) == 7
    for rows in got.values():
        assert rows.keys() == want.keys() and all(np.allclose(rows[k], v, atol=1e-6) for k, v in want.items())


def test_novelty_equals_the_matrix_form(spark):
    rng = np.random.default_rng(3)
    x = rng.random((12, 20))
    rows = [("a", 0, f, b, float(x[b, f])) for f in range(20) for b in range(12)]
    df = spark.createDataFrame(rows, "track_id string, chunk int, frame int, band int, value double")
    got = d.ssm_novelty(df, 20).first()["value"]
    s, k, curve = x.T @ x, 8, []
    for t in range(20):
        total = 0.0
        for p in range(-k, k):
            for q in range(-k, k):
                if 0 <= t + p < 20 and 0 <= t + q < 20:
                    total += (1 if (p >= 0) == (q >= 0) else -1) * s[t + p, t + q]
        curve.append(max(total, 0.0))
    assert math.isclose(got, np.mean(curve), rel_tol=1e-9)


def test_peak_regularity(spark):
    df = spark.createDataFrame([([0.0, 5.0, 0.0, 5.0, 0.0, 5.0, 0.0],), ([0.0, 5.0, 0.0, 5.0, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(d.peak_regularity(F.col("v"), F.lit(1.0))).collect()]
    assert abs(got[0] - 1.0) < 1e-9 and got[1] == 0.0


def test_augmentation_keeps_length_and_level(spark):
    x = np.sin(np.arange(4000) / 7) * 3
    s = series(spark, {"a": x, "b": x[:900]})
    noisy = aug.add_noise(s, 20.0).join(s.withColumnRenamed("value", "raw").drop("n"), ["track_id", "pos"])
    stats = noisy.where("track_id = 'a'").agg(F.avg(F.pow("raw", F.lit(2))).alias("s"), F.avg(F.pow(F.col("value") - F.col("raw"), F.lit(2))).alias("n")).first()
    assert abs(10 * math.log10(stats["s"] / stats["n"]) - 20.0) < 0.5
    parts = blocks.block_table(s, 512)
    coloured = block.sample_rows(block.add_coloured_noise(parts, 15.0)).join(s.withColumnRenamed("value", "raw").drop("n"), ["track_id", "pos"])
    level = coloured.where("track_id = 'a'").agg(F.avg(F.pow(F.col("value") - F.col("raw"), F.lit(2))).alias("n")).first()["n"]
    assert abs(10 * math.log10(stats["s"] / level) - 15.0) < 0.01
    out = block.sample_rows(block.augment(parts, 2, 0.9, size=512, limit=None, taps=100, piece=(200, 3000)))
    sizes = {r["track_id"]: (r["c"], r["d"]) for r in out.groupBy("track_id").agg(F.count("pos").alias("c"), F.count_distinct("pos").alias("d")).collect()}
    assert sizes == {f"{t}#{v}": (n, n) for t, n in (("a", 4000), ("b", 900)) for v in range(3)}
    raw = out.where("track_id = 'a#0'").join(s.where("track_id = 'a'").select("pos", F.col("value").alias("raw")), "pos")
    assert raw.where(F.abs(F.col("value") - F.col("raw")) > 1e-9).count() == 0
    assert block.augment(parts, 2, enabled=False) is parts


def test_steps_do_not_depend_on_the_block_size(spark):
    rng = np.random.default_rng(4)
    s = series(spark, {"a": rng.standard_normal(700), "b": rng.standard_normal(33), "c": rng.standard_normal(1)})
    rows = []
    for size in (7, 64, 65536):
        parts = blocks.block_table(s, size)
        out = block.augment(parts, 3, 0.8, size=size, taps=50, piece=(20, 300))
        rows.append({(r["track_id"], r["pos"]): r["value"] for r in block.sample_rows(out).collect()})
    assert len(rows[0]) == 4 * 734 and rows[0].keys() == rows[1].keys() == rows[2].keys()
    assert all(abs(rows[k][x] - v) < 1e-9 for x, v in rows[0].items() for k in (1, 2))


def test_filters_against_recursion(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal(3000)
    parts = blocks.block_table(series(spark, {"a": x}), 256)
    for centre, q, db in ((90.0, 1.5, 6.0), (2500.0, 5.0, -12.0), (8000.0, 0.5, 3.0)):
        got = block.equalise(parts, 16000, centre, q, db, 256).orderBy("start").collect()
        a, w0 = 10 ** (db / 40), 2 * math.pi * centre / 16000
        alpha, y = math.sin(w0) / (2 * q), np.zeros(3002)
        padded = np.r_[0.0, 0.0, x]
        for t in range(2, 3002):
            y[t] = ((1 + alpha * a) * padded[t] - 2 * math.cos(w0) * padded[t - 1] + (1 - alpha * a) * padded[t - 2] + 2 * math.cos(w0) * y[t - 1] - (1 - alpha / a) * y[t - 2]) / (1 + alpha / a)
        assert np.allclose(np.concatenate([r["samples"] for r in got]), y[2:], atol=1e-9)


def test_a_long_response_sends_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    s = series(spark, {"a": rng.standard_normal(700), "b": rng.standard_normal(33), "c": rng.standard_normal(1)})
    parts = blocks.block_table(s, 16)
    rows = []
    for work in (16, 48, block.WORK):
        monkeypatch.setattr(block, "WORK", work)
        out = block.augment(parts, 3, 0.8, size=16, taps=50, piece=(20, 300))
        rows.append({(r["track_id"], r["pos"]): r["value"] for r in block.sample_rows(out).collect()})
        assert out.where("size(samples) > 16 or start % 16 <> 0").count() == 0
    assert len(rows[0]) == 4 * 734 and rows[0].keys() == rows[1].keys() == rows[2].keys()
    assert all(abs(rows[k][x] - v) < 1e-9 for x, v in rows[0].items() for k in (1, 2))
    low = block.equalise(blocks.block_table(series(spark, {"a": rng.standard_normal(3000)}), 16), 16000, 80.0, 1.5, 6.0, 16)
    plan = low._jdf.queryExecution().optimizedPlan().toString()
    assert len(block.filter_response(16000, 80.0, 1.5, 6.0)) > 16 * 100 and "_at" in plan
    assert len(block.filter_response(16000, 80.0, 1.5, 6.0, 67)) == 67


def test_spectra_of_blocks_are_those_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    s = series(spark, {"a": rng.random(500), "b": rng.random(3), "c": rng.random(64)})
    monkeypatch.setattr(blocks, "TOGETHER", 300)
    for size, ends in ((50, "constant"), (1000, "reflect")):
        parts = blocks.block_table(s, size)
        got = long_spectrum(block_spectrum(parts, 64, 32, 32, 8, ends))
        want = spectrum(win.chunk_rows(s, 64, 32), 64, 32, 8, "fft", ends)
        rows = [{tuple(r)[:4]: (r["re"], r["im"]) for r in df.collect()} for df in (got, want)]
        assert rows[0].keys() == rows[1].keys() and all(np.allclose(rows[0][k], v, atol=1e-8) for k, v in rows[1].items())
    means = [
        {(r["track_id"], r["chunk"], r["bin"]): r["value"] for r in df.collect()}
        for df in (block_mean_magnitude(blocks.block_table(s, 50), 64, 32, 32, 8), mean_magnitude(spectrum(win.chunk_rows(s, 64, 32), 64, 32, 8)))
    ]
    assert means[0].keys() == means[1].keys() and all(abs(means[0][k] - v) < 1e-8 for k, v in means[1].items())
    plan = block_spectrum(blocks.block_table(s, 50), 64, 32, 32, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan
