import random
from collections import defaultdict

import corpus_pipeline
from pairloom.llm.decontamination import edits_of_best_passage, plain
from pairloom.llm.packing import public_byte_bpe
from pairloom.llm.toxicity import toxicity_scores
from pairloom.llm.queries import training_labels, tracks_of
from test_shingles import brute

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(2)
    rows = [docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    toxic = {r.track_id for r in toxicity_scores(tracks_of(docs), training_labels(spark, SF)).where("predicted = 1").collect()}
    for name in names[:-1]:
        docs = spark.createDataFrame(stages[name](spark, docs, SF).collect(), docs.schema)
        rows.append(docs.collect())
    kept = [{r.doc_id for r in part} for part in rows]
    assert kept[1] == kept[0] - toxic
    first, _ = brute([(r.doc_id, r.text) for r in rows[1]])
    assert kept[2] == first
    items = [plain(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in rows[2] if any(edits_of_best_passage(i, plain(r.text.encode()))[0] <= int(0.2 * len(i)) for i in items)}
    assert kept[3] == kept[2] - leaks
    assert kept[4] == kept[3]
    before = {r.doc_id: r for r in rows[3]}
    for r in rows[4]:
        old = before[r.doc_id]
        assert ("token = " in (old.text or "")) == ("[redacted]" in (r.text or ""))
        assert r.n_chars == len(r.text) if r.text != old.text else r == old
    encode, total = public_byte_bpe(), defaultdict(int)
    for r in stages[names[-1]](spark, docs, SF).collect():
        total[r.doc_id] += r.length
    assert total == {r.doc_id: len(encode(r.text or "")) + 1 for r in rows[4]}


def test_odd_rows_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.select("*", docs.lang.alias("score"), docs.lang.alias("track_id"), docs.lang.alias("path")).schema
    text = " ".join(random.Random(3).choice("abcdefgh") * 3 for _ in range(90))
    odd = [(None, text, None, None, None), (None, None, "en", "s", 0), (7, None, None, None, None), (7, text, "en", "s", 1), (7, text, "en", "s", 1), (8, "", "", "", 0), (9, text + " z", "en", "s", 9), (10, "la " * 100000, "en", "s", 1)]
    rows = spark.createDataFrame([(*r, "a", "b", "c") for r in odd], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns and stage(spark, rows.limit(0), SF).count() == 0
        got = sorted((r.doc_id or -1, (r.text or "")[:9]) for r in out.collect())
        want = 5 if name == "simhash_near_dedup" else len(odd)
        assert len(got) <= want if name == "simhash_near_dedup" else len(got) == want, (name, got)
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).where("start = 0").count() == len(odd)
