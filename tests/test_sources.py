import re
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators import validation
from pairloom.sources import catalogue, schemas, signals
from pairloom.streaming import jobs


def write_wav(path, values, sr=16000, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(sr)
        f.writeframes((np.asarray(values) * 32767).astype("<i2").tobytes())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("wav")
    write_wav(d / "mono.wav", 0.5 * np.sin(np.arange(20000) / 10))
    write_wav(d / "stereo.wav", np.repeat([[0.2, 0.4]], 8000, axis=0).ravel(), channels=2)
    write_wav(d / "empty.wav", [])
    write_wav(d / "rate.wav", np.zeros(5000), sr=8000)
    write_wav(d / "short.wav", np.zeros(800))
    (d / "bad.wav").write_bytes(b"not audio at all")
    (d / "zero.wav").write_bytes(b"")
    return d


def name(col="path"):
    return F.element_at(F.split(col, "/"), -1)


def test_ingest(spark, folder):
    blocks = signals.read_signal_blocks(spark, str(folder)).persist()
    s = signals.ingest_signals(blocks).withColumn("f", name("track_id"))
    stats = {r["f"]: r for r in s.groupBy("f").agg(F.count("pos").alias("n"), F.max("pos").alias("last"), F.avg("value").alias("m")).collect()}
    assert stats["mono.wav"]["n"] == 20000 and stats["mono.wav"]["last"] == 19999
    assert abs(stats["stereo.wav"]["m"] - 0.3) < 1e-3 and stats["stereo.wav"]["n"] == 8000
    assert stats["empty.wav"]["n"] == 16000 and stats["empty.wav"]["m"] == 0
    bad = {r["f"]: r["error"] for r in signals.quarantine(blocks).withColumn("f", name("track_id")).collect()}
    assert set(bad) == {"rate.wav", "bad.wav", "zero.wav"} and "wrong sample rate" in bad["rate.wav"]


def test_headers_and_verdicts(spark, folder):
    headers = signals.read_headers(spark, str(folder)).withColumn("path", name())
    refs = spark.createDataFrame(
        [(n,) for n in ["mono.wav", "stereo.wav", "empty.wav", "rate.wav", "short.wav", "bad.wav", "zero.wav", "gone.wav"]], "path string"
    )
    got = {r["path"]: (r["valid"], r["reason"]) for r in validation.validate(refs, headers).collect()}
    assert got["mono.wav"] == (True, "")
    assert got["gone.wav"][1] == "missing" and got["zero.wav"][1] == "empty file (0 bytes)"
    assert got["bad.wav"][1].startswith("corrupt (") and got["rate.wav"][1].startswith("wrong sample rate (8000")
    assert got["stereo.wav"][1] == "not mono (2 channels)"
    assert got["short.wav"][1] == "too short (0.050s, min 0.1s)"


def test_listing_has_empty_and_nested_files(spark, folder, tmp_path):
    listing = catalogue.list_files(spark, str(folder))
    assert listing.count() == 7
    sub = tmp_path / "deep" / "er"
    sub.mkdir(parents=True)
    write_wav(sub / "x.wav", np.zeros(10))
    (tmp_path / "y.txt").write_text("no")
    rows = catalogue.list_files(spark, str(tmp_path)).collect()
    assert [(r["name"], r["path"]) for r in rows] == [("x.wav", f"file:{sub}/x.wav")]
    spark_path = spark.read.format("binaryFile").load(str(sub)).select("path").first()["path"]
    assert rows[0]["path"] == spark_path


def test_missing_catalogue_is_none(spark, tmp_path):
    assert catalogue.read_catalogue(spark, str(tmp_path / "none.csv"), schemas.LABELLED_CATALOGUE) is None


def test_catalogue_by_header(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('split,filename,label,generator\ntrain,"a, b.wav",ai,suno\nval,c.wav,real,real\n')
    rows = catalogue.read_catalogue(spark, str(p), schemas.LABELLED_CATALOGUE).collect()
    assert rows[0].asDict() == {"filename": "a, b.wav", "label": "ai", "generator": "suno", "split": "train"}
    pairs = tmp_path / "p.csv"
    pairs.write_text("pair_id,track_a,track_b,similarity_label\n3,x,,plag\n")
    assert catalogue.read_catalogue(spark, str(pairs), schemas.PAIR_CATALOGUE).collect()[0]["pair_id"] == 3


def test_required_columns(spark):
    df = spark.createDataFrame([], schemas.PAIRS)
    assert validation.require_columns(df, ["label"]) is df
    with pytest.raises(ValueError, match="split"):
        validation.require_columns(df, ["label", "split"])


def test_split_files(spark, tmp_path):
    rows = [("a", "b", 1, "p", "train"), ("c", "d", 0, "n", "test")]
    pairs = spark.createDataFrame(rows, "track_a_path string, track_b_path string, label int, pair_type string, split string")
    catalogue.write_pairs(pairs, str(tmp_path / "pq"))
    one = catalogue.read_pairs(spark, str(tmp_path / "pq"), "test")
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()
    catalogue.write_pairs(pairs, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_header_far_behind_and_float_samples(spark, tmp_path):
    values = np.linspace(-0.5, 0.5, 400)

    def chunk(name, body):
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    def write(name, tag, bits, raw, notes):
        layout = chunk(b"fmt ", struct.pack("<HHIIHH", tag, 1, 16000, 16000 * bits // 8, bits // 8, bits))
        body = b"WAVE" + layout + chunk(b"LIST", notes) + chunk(b"data", raw)
        (tmp_path / name).write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)

    write("late.wav", 1, 16, (values * 32767).astype("<i2").tobytes(), b"n" * 5001)
    write("float.wav", 3, 32, values.astype("<f4").tobytes(), b"")
    (tmp_path / "bad.wav").write_bytes(b"RIFF1234WAVEfmt ")
    heads = {r["path"].rsplit("/", 1)[1]: r for r in signals.read_headers(spark, str(tmp_path)).collect()}
    assert heads["late.wav"]["readable"] and heads["float.wav"]["readable"] and not heads["bad.wav"]["readable"]
    assert heads["late.wav"]["duration"] == heads["float.wav"]["duration"] == 0.025
    blocks = {r["track_id"].rsplit("/", 1)[1]: r for r in signals.read_signal_blocks(spark, str(tmp_path)).collect()}
    assert np.allclose(blocks["float.wav"]["samples"], values, atol=1e-6)
    assert np.allclose(blocks["late.wav"]["samples"], values, atol=1e-4) and blocks["bad.wav"]["error"]


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_files_of_two_column_orders(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text('filename,label,generator,split\na.wav,ai,suno,train\n"b, c.wav",real,real,val\n')
    (tmp_path / "b.csv").write_text("split,generator,filename\ntrain,udio,d.wav\n")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("filename", "label", "generator", "split")])
    got = {tuple(r) for r in catalogue.read_catalogue(spark, str(tmp_path), schema, multi_line).collect()}
    assert got == {("a.wav", "ai", "suno", "train"), ("b, c.wav", "real", "real", "val"), ("d.wav", None, "udio", "train")}


def test_ingest_reads_only_the_folders_of_its_keys(spark, tmp_path):
    rows = [(f"k{i}", i, "en") for i in range(200)]
    schema = "key string, doc_id long, lang string"
    source, target = tmp_path / "in", str(tmp_path / "out")
    for k, part in enumerate((rows[:120], rows[60:] + rows[60:90])):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        jobs.stream_ingest(stream, target, str(tmp_path / f"state{k}"), ["key"], "doc_id", counts=str(tmp_path / "counts"), parts=16).awaitTermination()
    assert sorted(tuple(r) for r in jobs.read_ingested(spark, target).collect()) == sorted(rows)
    counts = spark.read.parquet(str(tmp_path / "counts")).groupBy("status").agg(F.sum("n").alias("n")).collect()
    assert {r["status"]: r["n"] for r in counts}["added"] == 200
    few = jobs.stored_keys(spark, target, stream.schema, ["key"], [3, 5])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "key_part IN (3,5)" in re.sub(r"#\d+", "", plan.split("PartitionFilters: ")[1].split("]")[0])
    assert {tuple(r) for r in few.collect()} == {(r["key"],) for r in spark.createDataFrame(rows, schema).where(jobs.key_part(["key"], 16).isin(3, 5)).collect()}


def test_ingest_of_a_folder_of_part_files_and_of_a_null_key(spark, tmp_path):
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("doc_id", T.LongType())])
    rows = [(None, 3), (None, 1), ("a", 2), ("b", 4)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    part = next(p for p in (tmp_path / "in" / "documents.parquet").iterdir() if p.suffix == ".parquet")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "documents.parquet").write_bytes(part.read_bytes())
    single = spark.read.parquet(str(tmp_path / "one")).count()
    for folder, kept in (("in", [(None, 1), ("a", 2), ("b", 4)]), ("one", None)):
        stream = jobs.file_stream(spark, str(tmp_path / folder), schema, pattern="documents.parquet")
        for k in range(2):
            jobs.stream_ingest(stream, str(tmp_path / f"out_{folder}"), str(tmp_path / f"state_{folder}{k}"), ["key"], "doc_id", parts=4).awaitTermination()
        got = jobs.read_ingested(spark, str(tmp_path / f"out_{folder}")).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == kept if kept else 0 < len(got) <= single
