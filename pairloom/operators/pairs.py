"""Labelled pair construction, balance and splitting."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_hex, hash_int
from pairloom.operators.ranking import exact_rank, first_rows, hash_bucket
from pairloom.session import kept

# fixed values: draws per wanted pair, limits per group, and the pair types written out:
# positive, negative, hard_negative, fmc_positive
ATTEMPTS = 5
HARD_CAP = 50
MODEL_CAP = 40
SHARED_CAP = 5
CROSS_LIMIT = 500
#: wanted pairs from which a part of the draws is tried first
MANY = 20000


def _numbered(pool: DataFrame, col: str, out: str, seed: str) -> DataFrame:
    """Pool values with a 0-based number in hash order."""
    values = pool.select(F.col(col).alias(out))
    digest = hash_hex(seed, F.col(out))
    ranked = exact_rank(values, [], [digest, F.col(out)], hash_bucket(digest), name="_i")
    return ranked.withColumn("_i", F.col("_i") - 1)


def sample_pairs(
    pool_a: DataFrame,
    pool_b: DataFrame,
    n: int,
    seed: str | int = 42,
    col: str = "path",
    unordered: bool = False,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Up to ``n`` distinct ordered pairs (a <> b) from two pools, at most 5·n draws.

    A draw is two hashed indices; each index is an equi-join with a numbered pool, so the
    product of the pools is never formed. Duplicates keep their first draw. ``sizes`` spares
    counting pools whose sizes are known. Of many draws the first ones are tried first, and the rest only where those
    have too few distinct pairs.
    """
    spark = pool_a.sparkSession
    if sizes is None:
        size_a = pool_a.count()
        sizes = (size_a, size_a if pool_b is pool_a else pool_b.count())
    size_a, size_b = sizes
    if n <= 0 or size_a == 0 or size_b == 0:
        return spark.createDataFrame([], "track_a_path string, track_b_path string, draw bigint")
    a = _numbered(pool_a, col, "track_a_path", f"{seed}|pool").withColumnRenamed("_i", "_ia")
    b = _numbered(pool_b, col, "track_b_path", f"{seed}|pool").withColumnRenamed("_i", "_ib")

    def distinct(count: int) -> DataFrame:
        """Distinct pairs of the first ``count`` draws, each with its first draw."""
        draws = spark.range(count).select(
            F.col("id").alias("draw"),
            (hash_int(f"{seed}|a", F.col("id")) % size_a).alias("_ia"),
            (hash_int(f"{seed}|b", F.col("id")) % size_b).alias("_ib"),
        )
        drawn = draws.join(a, "_ia").join(b, "_ib").where(F.col("track_a_path") != F.col("track_b_path"))
        if unordered:
            lo = F.least("track_a_path", "track_b_path")
            hi = F.greatest("track_a_path", "track_b_path")
            drawn = drawn.select(lo.alias("track_a_path"), hi.alias("track_b_path"), "draw")
        return drawn.groupBy("track_a_path", "track_b_path").agg(F.min("draw").alias("draw"))

    whole, found = n * ATTEMPTS, None
    if n >= MANY:
        # where the first draws have n distinct pairs, those are the first n of all draws
        found = kept(distinct(n + n // 8))
        if found.count() < n:
            found = None
    if found is None:
        # the rank below reads its input twice; both readings share this exchange
        found = distinct(whole)
    width = max(1, whole // 4096)
    ranked = exact_rank(
        found, [], [F.col("draw")], F.floor(F.col("draw") / F.lit(width)), name="_rank"
    )
    return ranked.where(F.col("_rank") <= n).select("track_a_path", "track_b_path", "draw")


def labelled(pairs: DataFrame, label: int, pair_type: str) -> DataFrame:
    return pairs.select(
        "track_a_path",
        "track_b_path",
        F.lit(label).alias("label"),
        F.lit(pair_type).alias("pair_type"),
    )


def class_positive_pairs(
    cat: DataFrame, seed: str | int = 42, col: str = "path", label: str = "label"
) -> DataFrame:
    """Real x ai positives, n = min(R·A, max(R, A))."""
    real = cat.where(F.col(label) == "real").select(col)
    ai = cat.where(F.col(label) == "ai").select(col)
    sizes = cat.agg(
        F.count_if(F.col(label) == "real").alias("r"), F.count_if(F.col(label) == "ai").alias("a")
    ).first()
    r, a = sizes["r"], sizes["a"]
    n = min(r * a, max(r, a))
    return labelled(sample_pairs(real, ai, n, f"{seed}|pos", col, sizes=(r, a)), 1, "positive")


def class_negative_pairs(
    cat: DataFrame, n: int, seed: str | int = 42, col: str = "path", label: str = "label"
) -> DataFrame:
    """Real x real negatives, as many as there are positives."""
    real = cat.where(F.col(label) == "real").select(col)
    return labelled(sample_pairs(real, real, n, f"{seed}|neg", col), 0, "negative")


def hard_negatives(
    df: DataFrame,
    group: str,
    order: Sequence[Column],
    cap: int = HARD_CAP,
    seed: str | int = 42,
    col: str = "path",
) -> DataFrame:
    """2-combinations of the first ``cap`` tracks of each group, max(10, n // 4) of them by hash.

    ``cap`` is the feature's own limit and is applied before the join, so a group yields at
    most cap·(cap−1)/2 rows whatever its size.
    """
    head = first_rows(df.select(F.col(group), F.col(col), *order), [group], order, cap)
    head = head.select(group, F.col(col).alias("_p"), F.col("rn"))
    left = head.select(group, F.col("_p").alias("track_a_path"), F.col("rn").alias("_ra"))
    right = head.select(group, F.col("_p").alias("track_b_path"), F.col("rn").alias("_rb"))
    combos = left.join(right, group).where(F.col("_ra") < F.col("_rb"))
    by_group = Window.partitionBy(group)
    digest = hash_hex(f"{seed}|hard", F.col("track_a_path"), F.col("track_b_path"))
    kept = (
        combos.withColumn("_n", F.count(F.lit(1)).over(by_group))
        .withColumn("_k", F.row_number().over(by_group.orderBy(digest, "track_a_path", "track_b_path")))
        .where(F.col("_k") <= F.greatest(F.lit(10), F.floor(F.col("_n") / 4)))
    )
    return labelled(kept, 0, "hard_negative")


def annotated_positives(pairs: DataFrame, a: str = "track_a", b: str = "track_b") -> DataFrame:
    named = pairs.select(F.col(a).alias("track_a_path"), F.col(b).alias("track_b_path"))
    return labelled(named, 1, "positive")


def negatives_excluding(
    positives: DataFrame, n: int | None = None, seed: str | int = 42
) -> DataFrame:
    """Draws from the pooled tracks minus pairs that are positive in either direction."""
    sides = F.explode(F.array("track_a_path", "track_b_path")).alias("path")
    pool = positives.select(sides).distinct()
    n = positives.count() if n is None else n
    drawn = sample_pairs(pool, pool, n, f"{seed}|excl")
    lo, hi = F.least("track_a_path", "track_b_path"), F.greatest("track_a_path", "track_b_path")
    known = positives.select(lo.alias("_lo"), hi.alias("_hi"))
    kept = drawn.withColumn("_lo", lo).withColumn("_hi", hi).join(known, ["_lo", "_hi"], "left_anti")
    return labelled(kept, 0, "negative")


def cross_source_negatives(
    real: DataFrame, other: DataFrame, n: int = CROSS_LIMIT, seed: str | int = 42, col: str = "path"
) -> DataFrame:
    return labelled(sample_pairs(real, other, n, f"{seed}|cross", col), 0, "negative")


def shared_key(filename: Column) -> Column:
    """Text after the last underscore without its extension."""
    return F.regexp_replace(F.regexp_extract(filename, r"([^_]*)$", 1), r"\.wav", "")


def pairs_below(h: Column) -> Column:
    """h·(h − 1) / 2 in integers; the even factor is halved first, so it holds up to 3·10⁹."""
    half = F.when(h % 2 == 0, h).otherwise(h - 1)
    return F.shiftright(half, 1) * F.when(h % 2 == 0, h - 1).otherwise(h)


def ranks_of_combination(t: Column) -> tuple[Column, Column]:
    """Combination number t -> (lo, hi) with 1 <= lo < hi, numbered hi-major.

    t = (hi − 1)(hi − 2) / 2 + (lo − 1). The floating-point root is at most one off and is set right by
    exact comparison.
    """
    root = F.floor((F.sqrt(t.cast("double") * 8 + 1) + 1) / 2).cast("bigint")
    h = (
        F.when(pairs_below(root) > t, root - 1)
        .when(pairs_below(root + 1) <= t, root + 1)
        .otherwise(root)
    )
    return t - pairs_below(h) + 1, h + 1


def shared_key_positives(
    df: DataFrame,
    key: Column,
    cap: int | None = SHARED_CAP,
    seed: str | int = 42,
    col: str = "path",
) -> DataFrame:
    """Pairs of tracks that share a key, at most ``cap`` per key; None: as many as the key has tracks.

    The combinations of a key are numbered 0..M−1 without being written out; a key takes
    ``cap`` of them at equal steps from a hashed start (all when M <= cap), each number is
    turned back into two ranks, and two equi-joins fetch the tracks. A key with a billion
    tracks costs ``cap`` pairs, not a billion squared.
    """
    rows = df.select(key.alias("_key"), F.col(col).alias("_p"))
    digest = hash_hex(f"{seed}|shared", F.col("_p"))
    ranked = exact_rank(rows, ["_key"], [digest, F.col("_p")], hash_bucket(digest), name="_rn")
    sizes = (
        rows.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= 2)
        .withColumn("_m", pairs_below(F.col("_n")))
        .withColumn("_start", hash_int(f"{seed}|start", F.col("_key")) % F.col("_m"))
        .withColumn("_take", F.least(F.col("_m"), F.col("_n") if cap is None else F.lit(cap)))
    )
    picks = sizes.select(
        "_key", "_m", "_start", "_take", F.explode(F.expr("sequence(0L, _take - 1)")).alias("_j")
    ).select(
        "_key",
        ((F.col("_start") + F.col("_j") * F.expr("_m div _take")) % F.col("_m")).alias("_t"),
    )
    low, high = ranks_of_combination(F.col("_t"))
    picks = picks.select("_key", low.alias("_lo"), high.alias("_hi"))
    a = ranked.select("_key", F.col("_rn").alias("_lo"), F.col("_p").alias("track_a_path"))
    b = ranked.select("_key", F.col("_rn").alias("_hi"), F.col("_p").alias("track_b_path"))
    pairs = picks.join(a, ["_key", "_lo"]).join(b, ["_key", "_hi"])
    return labelled(pairs, 1, "fmc_positive")


def union_pairs(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def pair_balance(pairs: DataFrame) -> DataFrame:
    """Positives, negatives, ratio and skew flag in one row."""
    return (
        pairs.agg(
            F.count_if(F.col("label") == 1).alias("n_pos"),
            F.count_if(F.col("label") == 0).alias("n_neg"),
        )
        .withColumn("ratio", F.col("n_pos") / F.greatest(F.col("n_neg"), F.lit(1)))
        .withColumn("skewed", (F.col("ratio") < 0.3) | (F.col("ratio") > 3.0))
    )


def pair_type_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pair_type").agg(F.count(F.lit(1)).alias("n"))


def stratum_quotas(sizes: dict, share: float) -> dict:
    """Whole-table quota ceil(share·N), dealt to strata in proportion by largest remainder."""
    total = sum(sizes.values())
    quota = math.ceil(round(total * share, 9))
    exact = {k: quota * n / max(total, 1) for k, n in sizes.items()}
    dealt = {k: math.floor(round(x, 9)) for k, x in exact.items()}
    left = quota - sum(dealt.values())
    for k in sorted(exact, key=lambda k: (-round(exact[k] - dealt[k], 9), str(k)))[:left]:
        dealt[k] += 1
    return dealt


def stratified_split(
    pairs: DataFrame,
    val: float = 0.15,
    test: float = 0.15,
    seed: str | int = 42,
    stratum: str = "label",
    key: Sequence[str] = ("track_a_path", "track_b_path", "pair_type"),
) -> DataFrame:
    """Three-way split: test share first, then val / (1 − test) of the rest, both stratified.

    Rows are ranked per stratum in hash order by the two-level rank, so two strata do not
    mean two tasks. The quotas come from one count per stratum.
    """
    digest = hash_hex(f"{seed}|split", *[F.col(k) for k in key])
    ranked = exact_rank(
        pairs, [stratum], [digest, *[F.col(k) for k in key]], hash_bucket(digest), name="_rank"
    )
    sizes = {r[0]: r[1] for r in pairs.groupBy(stratum).count().collect()}
    n_test = stratum_quotas(sizes, test)
    n_val = stratum_quotas({k: n - n_test[k] for k, n in sizes.items()}, val / (1.0 - test))
    limit = lambda quota: F.coalesce(
        *[F.when(F.col(stratum).eqNullSafe(F.lit(k)), F.lit(n)) for k, n in quota.items()], F.lit(0)
    )
    split = (
        F.when(F.col("_rank") <= limit(n_test), "test")
        .when(F.col("_rank") <= limit(n_test) + limit(n_val), "val")
        .otherwise("train")
    )
    return ranked.withColumn("split", split).drop("_rank")


def track_roles(pairs: DataFrame) -> DataFrame:
    """Every track with the flag whether it occurs in the train split."""
    sides = pairs.select(F.explode(F.array("track_a_path", "track_b_path")).alias("path"), "split")
    return sides.groupBy("path").agg(F.bool_or(F.col("split") == "train").alias("in_train"))


def split_leaks(pairs: DataFrame) -> DataFrame:
    """Tracks that occur in more than one split (the split is made by pair)."""
    sides = pairs.select(F.explode(F.array("track_a_path", "track_b_path")).alias("path"), "split")
    return (
        sides.groupBy("path")
        .agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"))
        .where(F.col("splits").contains(","))
    )


def variant_jobs(roles: DataFrame, n_aug: int) -> DataFrame:
    """One row per (path, variant): 0..n for train tracks, 0 otherwise."""
    top = F.when(F.col("in_train"), F.lit(n_aug)).otherwise(F.lit(0))
    return roles.select("path", F.explode(F.sequence(F.lit(0), top)).alias("variant"))


def pick_variant(pairs: DataFrame, n: int, seed: str | int = 42) -> DataFrame:
    """Augmentation variant per pair, the same on both sides."""
    draw = hash_int(f"{seed}|variant", F.col("track_a_path"), F.col("track_b_path"))
    return pairs.withColumn("variant", (draw % (n + 1)).cast("int"))


def as_views(pairs: DataFrame) -> DataFrame:
    """Both sides of a pair as two views under one view id."""
    return pairs.select(
        F.concat_ws("|", "track_a_path", "track_b_path").alias("view_id"),
        F.col("track_a_path").alias("view_1"),
        F.col("track_b_path").alias("view_2"),
    )


def as_singles(pairs: DataFrame) -> DataFrame:
    """First side of each pair as a single view."""
    return pairs.select(F.col("track_a_path").alias("path"), "label")
