import pytest
from pyspark.sql import functions as F

from pairloom.operators import catalogue as cat_ops
from pairloom.operators import pairs as ops
from pairloom.plans import pair_table


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [("s1", "ai", "suno"), ("s2", "ai", "suno"), ("u1", "ai", "udio"), ("u2", "ai", "udio"),
            ("r1", "real", "real"), ("r2", "real", "real"), ("r3", "real", "real")]
    return spark.createDataFrame(rows, "path string, label string, generator string")


@pytest.fixture(scope="module")
def renditions(spark):
    rows = [(f"{m}_{i}.wav", m) for m, i in [("m1", "x"), ("m1", "y"), ("m2", "x"), ("m2", "z"), ("m3", "y"), ("m3", "x")]]
    return spark.createDataFrame(rows, "path string, model string")


def test_pair_types_and_labels(spark, labelled, renditions):
    pairs = pair_table.all_pairs(labelled, renditions, None, [F.col("path")]).collect()
    assert {"positive", "negative", "hard_negative", "fmc_positive"} == {r["pair_type"] for r in pairs}
    assert {r["label"] for r in pairs} == {0, 1}
    assert all(r["label"] == 0 for r in pairs if r["pair_type"] == "hard_negative")
    assert all(r["track_a_path"] != r["track_b_path"] for r in pairs)


def test_single_catalogues_and_none(labelled, renditions):
    assert pair_table.all_pairs(labelled, None, None, [F.col("path")]).count() > 0
    assert pair_table.all_pairs(None, renditions, None, [F.col("path")]).count() > 0
    with pytest.raises(ValueError):
        pair_table.all_pairs(None, None, None, [])


def test_sampled_pairs_are_distinct_and_bounded(labelled):
    pool = labelled.select("path")
    got = [(r[0], r[1]) for r in ops.sample_pairs(pool, pool, 20, 3).collect()]
    assert len(got) == len(set(got)) <= 20
    assert ops.sample_pairs(pool.where("1 = 0"), pool, 5).count() == 0
    unordered = [tuple(sorted((r[0], r[1]))) for r in ops.sample_pairs(pool, pool, 20, 3, unordered=True).collect()]
    assert len(unordered) == len(set(unordered))


def test_negatives_never_repeat_a_positive(spark):
    rows = [(f"t{i}", f"t{(i * 7 + 1) % 12}") for i in range(12)]
    pos = ops.annotated_positives(spark.createDataFrame(rows, "track_a string, track_b string"))
    known = {frozenset((r[0], r[1])) for r in pos.collect()}
    assert not known & {frozenset((r[0], r[1])) for r in ops.negatives_excluding(pos, 60).collect()}


def test_shared_key_with_a_hot_key(spark):
    df = spark.range(9000).select(
        F.concat(F.lit("m_"), F.col("id"), F.lit("_"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.floor(F.col("id") / 4).cast("string")), F.lit(".wav")).alias("path")
    )
    got = ops.shared_key_positives(df, ops.shared_key(F.col("path"))).withColumn("k", ops.shared_key(F.col("track_a_path")))
    rows = got.collect()
    hot = {frozenset((r["track_a_path"], r["track_b_path"])) for r in rows if r["k"] == "hot"}
    assert len(hot) == 5 and all(len(p) == 2 for p in hot)
    sizes = df.groupBy(ops.shared_key(F.col("path")).alias("k")).count().collect()
    assert len(rows) == sum(min(5, r["count"] * (r["count"] - 1) // 2) for r in sizes)
    assert all(ops_key(r["track_a_path"]) == ops_key(r["track_b_path"]) for r in rows)


def ops_key(path):
    return path.rsplit("_", 1)[1].replace(".wav", "")


def test_split_is_disjoint_and_stratified(spark):
    rows = [(f"a{i}", f"b{i}", int(i % 4 == 0), "p") for i in range(400)]
    pairs = spark.createDataFrame(rows, "track_a_path string, track_b_path string, label int, pair_type string")
    got = ops.stratified_split(pairs)
    assert got.count() == 400 and got.select("track_a_path").distinct().count() == 400
    sizes = {(r["label"], r["split"]): r["count"] for r in got.groupBy("label", "split").count().collect()}
    assert sizes[(1, "test")] == 15 and sizes[(0, "test")] == 45
    assert sizes[(1, "val")] == 15 and sizes[(0, "val")] == 45


@pytest.mark.parametrize(
    "fake,real,n,want", [(500, 122, 100, (80, 20)), (1, 999, 10, (1, 9)), (999, 0, 10, (10, 0)), (5, 5, 1, (0, 1)), (3, 2, 50, (3, 2))]
)
def test_class_quotas(fake, real, n, want):
    assert cat_ops.class_quotas(fake, real, n) == want


def test_vendor_rows(spark):
    fake = spark.createDataFrame([("a.mp3", "suno", "train"), ("b.mp3", None, None)], "filename string, source string, split string")
    real = spark.createDataFrame([("c.mp3", "val")], "filename string, split string")
    rows = {r["filename"]: r for r in cat_ops.normalise_labels(fake, real).collect()}
    assert (rows["a.mp3"]["label"], rows["a.mp3"]["generator"]) == ("ai", "suno")
    assert (rows["b.mp3"]["generator"], rows["b.mp3"]["split"]) == ("unknown", "train")
    assert (rows["c.mp3"]["label"], rows["c.mp3"]["generator"]) == ("real", "real")


def test_captions(spark):
    cap = spark.createDataFrame([(" k ", "one", 1), ("k", " two ", 2), ("n", None, 3), ("", "x", 4)], "ytid string, caption string, o int")
    got = {r["ytid"]: r["caption"] for r in cat_ops.caption_lookup(cap, "ytid", "caption", "o").collect()}
    assert got == {"k": "two", "n": ""}
    assert cat_ops.caption_lookup(cap.drop("caption"), "ytid", "caption", "o").count() == 0


def test_quotas_add_up():
    assert ops.stratum_quotas({0: 100, 1: 301}, 0.15) == {0: 15, 1: 46}
    assert ops.stratum_quotas({0: 1}, 0.15) == {0: 1}
    assert sum(ops.stratum_quotas({0: 7, 1: 7, None: 7}, 0.2).values()) == 5


def test_combination_numbers_of_very_large_keys(spark):
    sizes = [2, 3, 5, 92_683, 200_000_000, 1_000_000_000, 3_000_000_000]
    numbers = {t for n in sizes for m in [n * (n - 1) // 2] for t in (0, 1, m // 3, m // 2, m - 2, m - 1) if 0 <= t < m}
    numbers |= {h * (h - 1) // 2 + d for h in (94_906_266, 999_999_999, 2_147_483_648) for d in (-1, 0, 1)}
    low, high = ops.ranks_of_combination(F.col("t"))
    got = spark.createDataFrame([(t,) for t in sorted(numbers)], "t long").select("t", low.alias("lo"), high.alias("hi"))
    for r in got.collect():
        assert 1 <= r["lo"] < r["hi"] and (r["hi"] - 1) * (r["hi"] - 2) // 2 + r["lo"] - 1 == r["t"]


@pytest.mark.parametrize("size,n,tried", [(60, 200, True), (12, 110, False)])
def test_first_draws_give_the_pairs_of_all_draws(spark, monkeypatch, size, n, tried):
    pool = spark.range(size).select(F.concat(F.lit("p"), F.col("id") % (size - 2)).alias("path"))
    for unordered in (False, True):
        want = sorted(map(tuple, ops.sample_pairs(pool, pool, n, 5, unordered=unordered).collect()))
        monkeypatch.setattr(ops, "MANY", 1)
        got = ops.sample_pairs(pool, pool, n, 5, unordered=unordered)
        monkeypatch.undo()
        # the draws behind the first ones are made only where pairs are missing
        assert (f"Range (0, {5 * n}" in got._jdf.queryExecution().optimizedPlan().toString()) != tried
        assert sorted(map(tuple, got.collect())) == want
