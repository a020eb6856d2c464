import random

from pyspark.sql import functions as F

from pairloom.operators.ranking import (
    depth_bounds, depth_bucket, exact_quantiles, exact_rank, first_rows, hash_bucket, running_totals,
)


def skewed(spark, n=3000):
    rng = random.Random(1)
    # one key holds a third of the rows, and null is a key too
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), float(rng.randint(0, 400))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k string, x double"), rows


def test_exact_rank_equals_row_number(spark):
    df, rows = skewed(spark)
    bounds = depth_bounds(df, F.col("x"))
    got = exact_rank(df, ["k"], [F.col("x"), F.col("id")], depth_bucket(F.col("x"), bounds), total="n").collect()
    want, sizes = {}, {}
    for k in {r[1] for r in rows}:
        members = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        sizes[k] = len(members)
        want.update({r[0]: i + 1 for i, r in enumerate(members)})
    assert {r["id"]: r["rn"] for r in got} == want
    assert all(r["n"] == sizes[r["k"]] for r in got)


def test_exact_rank_by_hash_without_keys(spark):
    df, _ = skewed(spark, 500)
    digest = F.md5(F.col("id").cast("string"))
    got = exact_rank(df, [], [digest], hash_bucket(digest)).withColumn("h", digest).orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 501))
    assert [r["h"] for r in got] == sorted(r["h"] for r in got)


def test_bucket_follows_order(spark):
    df, _ = skewed(spark)
    b = depth_bucket(F.col("x"), depth_bounds(df, F.col("x")))
    rows = df.select("x", b.alias("b")).orderBy("x").collect()
    assert all(p["b"] <= q["b"] for p, q in zip(rows, rows[1:]))


def test_running_totals(spark):
    df, rows = skewed(spark)
    bounds = depth_bounds(df, F.col("x"))
    got = running_totals(
        df.withColumn("one", F.lit(1)), ["k"], [F.col("x"), F.col("id")], depth_bucket(F.col("x"), bounds), {"one": "run"}
    ).collect()
    hot = sorted((r for r in rows if r[1] == "hot"), key=lambda r: (r[2], r[0]))
    want = {r[0]: i + 1 for i, r in enumerate(hot)}
    assert {r["id"]: r["run"] for r in got if r["k"] == "hot"} == want


def test_first_rows_limits_before_the_shuffle(spark):
    df, _ = skewed(spark)
    out = first_rows(df, ["k"], [F.col("id")], 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 3 * 4


def test_exact_quantiles_with_ties_and_nulls(spark):
    df, rows = skewed(spark, 1000)
    # one value holds a third of the rows, some are null
    df = df.withColumn("x", F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 50 != 1, F.col("x")))
    got = exact_quantiles(df, ["k"], "x", [0.0, 0.25, 0.5, 0.9], ["a", "b", "c", "d"]).collect()
    want = df.groupBy("k").agg(F.percentile("x", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.9)])).alias("q")).collect()
    assert {r["k"]: [round(r[c], 9) for c in "abcd"] for r in got} == {r["k"]: [round(v, 9) for v in r["q"]] for r in want}
    whole = exact_quantiles(df, [], "x", [0.5], ["m"]).first()["m"]
    assert whole == df.agg(F.median("x")).first()[0]
