"""Profiles of documents, orders, lineitem and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import ANNOTATED_SQL, CATALOGUE_SQL, RENDITIONS_SQL, annotated, catalogue, r6, renditions, table, with_sql
from checks.similarity import COS, VPAIRS, vector_pairs, vectors
from pairloom.operators import profiling as ops
from pairloom.operators.similarity import pair_cosine

QUERIES: dict = {}
SQL: dict = {}


def _round(df, cols, digits=6):
    for c in cols:
        df = df.withColumn(c, r6(F.col(c), digits))
    return df


def _round_sql(cols, digits=6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


# ---- tables
QUERIES["i01_profile"] = lambda spark, sf: _round(
    ops.profile(catalogue(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left").select(
        "doc_id", "label", "generator", "n_chars", "toxic"
    )),
    ["mean", "std", "low", "high"],
)


def _profile_sql(col: str, numeric: bool) -> str:
    value = f"{col}::DOUBLE" if numeric else "NULL::DOUBLE"
    return (
        f"SELECT '{col}' AS \"column\", count(*) AS n, count(*) FILTER ({col} IS NULL) AS nulls, round(avg({value}), 6) AS mean, "
        f"round(stddev_samp({value}), 6) AS std, min({value}) AS low, max({value}) AS high FROM src"
    )


SQL["i01_profile"] = with_sql(CATALOGUE_SQL, "src AS (SELECT c.*, l.toxic FROM cat c LEFT JOIN labels l USING (doc_id))") + (
    " UNION ALL ".join(
        _profile_sql(c, n)
        for c, n in [("doc_id", True), ("label", False), ("generator", False), ("n_chars", True), ("toxic", True)]
    )
)

QUERIES["i02_value_counts"] = lambda spark, sf: ops.value_counts(table(spark, sf, "lineitem"), "l_shipdate").withColumn(
    "l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")
)
SQL["i02_value_counts"] = """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS percent
FROM (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1)"""
QUERIES["i03_crosstab"] = lambda spark, sf: ops.crosstab(
    table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]
)
SQL["i03_crosstab"] = """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
  count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1"""
QUERIES["i04_numeric_stats"] = lambda spark, sf: _round(
    ops.numeric_stats(table(spark, sf, "lineitem"), "l_extendedprice"), ["mean", "median"], 4
)
SQL["i04_numeric_stats"] = """
SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_extendedprice), 4) AS mean,
  round(median(l_extendedprice), 4) AS median FROM lineitem"""
QUERIES["i05_histogram"] = lambda spark, sf: ops.histogram(table(spark, sf, "orders"), "o_totalprice", 40, "o_orderstatus")
SQL["i05_histogram"] = """
WITH r AS (SELECT o_orderstatus, o_totalprice AS v, min(o_totalprice) OVER () AS lo,
  (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) / 40 AS w FROM orders)
SELECT o_orderstatus, least(CAST(floor((v - lo) / w) AS INT), 39) AS bin, count(*) AS n FROM r GROUP BY 1, 2"""



def _captioned(spark, sf):
    caption = F.when(F.col("doc_id") % 6 == 0, F.lit(None)).when(F.col("doc_id") % 6 == 1, "  ").otherwise(F.col("text"))
    return table(spark, sf, "documents").withColumn("text", caption)


_WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"
QUERIES["i06_text_coverage"] = lambda spark, sf: _round(
    ops.text_coverage(_captioned(spark, sf), "text"), ["percent", "mean_words"]
)
SQL["i06_text_coverage"] = f"""
SELECT count(*) AS n, count(*) FILTER (has) AS with_text, round(count(*) FILTER (has) * 100.0::DOUBLE / count(*), 6) AS percent,
  round(avg({_WORDS}) FILTER (has), 6) AS mean_words, max({_WORDS}) FILTER (has) AS max_words
FROM (SELECT text, doc_id % 6 > 1 AND trim(text, ' ') <> '' AS has FROM documents)"""
QUERIES["i07_top_words"] = lambda spark, sf: ops.top_words(table(spark, sf, "documents"), "text")
SQL["i07_top_words"] = f"""
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents)
WHERE length(word) > 2 AND word NOT IN {ops.STOP_WORDS} GROUP BY word ORDER BY n DESC, word LIMIT 20"""
QUERIES["i08_count_by"] = lambda spark, sf: ops.count_by(catalogue(spark, sf), ["source", "label"])
SQL["i08_count_by"] = with_sql(CATALOGUE_SQL) + "SELECT source, label, count(*) AS n FROM cat GROUP BY 1, 2"
QUERIES["i09_quartiles"] = lambda spark, sf: _round(
    ops.quartiles(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"), ["q1", "q2", "q3"]
)
SQL["i09_quartiles"] = """
SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2,
  quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1"""


def _segments(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.length("url").alias("s"), F.length("html").alias("e"))
    text = (
        F.when(F.col("page_id") % 5 == 0, F.format_string("[%d, %d]", "s", "e"))
        .when(F.col("page_id") % 5 == 1, F.format_string("[[%d, %d], [%d, %d]]", "s", "e", "e", "s"))
        .when(F.col("page_id") % 5 == 2, "oops")
        .when(F.col("page_id") % 5 == 3, F.format_string("[%d]", "s"))
    )
    return ops.segment_durations(p.withColumn("times", text), "times", "page_id")


QUERIES["i10_segment_durations"] = _segments
SQL["i10_segment_durations"] = """
WITH p AS (SELECT page_id, length(url)::DOUBLE AS s, length(html)::DOUBLE AS e FROM pages),
x AS (SELECT page_id, s, e FROM p WHERE page_id % 5 IN (0, 1) UNION ALL SELECT page_id, e, s FROM p WHERE page_id % 5 = 1)
SELECT page_id, s AS start, e AS "end", CASE WHEN e > s THEN e - s END AS duration FROM x"""

# ---- feature matrices
TIERS = {"first": (0, 40), "second": (40, 64), "all": (0, 64)}
LONG = """lng AS (SELECT vec_id, label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)"""
MOMENTS = """mo AS (SELECT label, dim, count(*) AS n, avg(v) AS m, var_pop(v) AS vp, var_samp(v) AS vs FROM lng GROUP BY 1, 2)"""
EFFECT = "abs(a.m - b.m) / sqrt((a.vp + b.vp) / 2 + 1e-10)"
PAIR = f"""cd AS (SELECT a.dim, {EFFECT} AS d, (a.m - b.m) / sqrt(a.vs / a.n + b.vs / b.n) AS t,
   pow(a.vs / a.n + b.vs / b.n, 2) / (pow(a.vs / a.n, 2) / (a.n - 1) + pow(b.vs / b.n, 2) / (b.n - 1)) AS df,
   abs(a.m - b.m) AS md FROM mo a JOIN mo b ON a.dim = b.dim WHERE a.label = 2 AND b.label = 7)"""
BASE = with_sql(LONG, MOMENTS, PAIR)


def _vec(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


QUERIES["i11_matrix_stats"] = lambda spark, sf: _round(
    ops.matrix_stats(_vec(spark, sf), "label", TIERS), ["mean", "std", "low", "high"]
)
SQL["i11_matrix_stats"] = with_sql(LONG) + """,
t AS (SELECT * FROM lng, (VALUES ('first', 0, 40), ('second', 40, 64), ('all', 0, 64)) t(tier, lo, hi) WHERE dim >= lo AND dim < hi)
SELECT label, tier, count(DISTINCT dim) AS dims, count(DISTINCT vec_id) AS rows, round(avg(v), 6) + 0.0 AS mean,
  round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM t GROUP BY 1, 2"""
QUERIES["i12_cohens_d"] = lambda spark, sf: _round(ops.cohens_d(_vec(spark, sf), "label", 2, 7), ["cohens_d"])
SQL["i12_cohens_d"] = BASE + "SELECT dim, round(d, 6) AS cohens_d, row_number() OVER (ORDER BY d DESC, dim) AS rank FROM cd"
QUERIES["i13_welch_t"] = lambda spark, sf: _round(ops.welch_t(_vec(spark, sf), "label", 2, 7).drop("p"), ["t", "df"])
SQL["i13_welch_t"] = BASE + "SELECT dim, round(t, 6) + 0.0 AS t, round(df, 6) AS df FROM cd"
QUERIES["i13_welch_p"] = lambda spark, sf: _round(ops.welch_t(_vec(spark, sf), "label", 2, 7), ["t", "df", "p"])
# two-sided tail of t: with u = sqrt(df) tan(x) the density is a power of cos(x), summed by Simpson's rule
TAIL = """,
pv AS (SELECT *, CASE WHEN t IS NULL THEN 1.0 ELSE
  1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * atan(abs(t) / sqrt(df)) / 6000 * list_sum(list_transform(range(0, 2001),
    lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(i * atan(abs(t) / sqrt(df)) / 2000), df - 1))) END AS p
  FROM cd)"""
SQL["i13_welch_p"] = BASE + TAIL + "SELECT dim, round(t, 6) + 0.0 AS t, round(df, 6) AS df, round(p, 6) + 0.0 AS p FROM pv"
QUERIES["i14_top_features"] = lambda spark, sf: _round(
    ops.top_features(_vec(spark, sf), "label", 2, 7, 10, TIERS).select("tier", "dim", "cohens_d", "rank", "significant"), ["cohens_d"]
)
SQL["i14_top_features"] = BASE + TAIL + """,
r AS (SELECT tier, dim, d, p < 0.05 AS significant, row_number() OVER (PARTITION BY tier ORDER BY d DESC, dim) AS rank
  FROM pv, (VALUES ('first', 0, 40), ('second', 40, 64), ('all', 0, 64)) t(tier, lo, hi) WHERE dim >= lo AND dim < hi)
SELECT tier, dim, round(d, 6) AS cohens_d, rank, significant FROM r WHERE rank <= 10"""
QUERIES["i15_mean_diff"] = lambda spark, sf: _round(ops.mean_diff(_vec(spark, sf), "label", 2, 7), ["mean_diff"])
SQL["i15_mean_diff"] = BASE + "SELECT dim, round(md, 6) AS mean_diff FROM cd"
QUERIES["i16_group_profile"] = lambda spark, sf: _round(ops.group_profile(_vec(spark, sf), "label"), ["mean", "z"])
SQL["i16_group_profile"] = with_sql(LONG, MOMENTS) + """,
sp AS (SELECT dim, row_number() OVER (ORDER BY var_pop(m) DESC, dim) AS rank FROM mo GROUP BY dim),
k AS (SELECT label, dim, rank, m FROM mo JOIN sp USING (dim) WHERE rank <= 20)
SELECT label, dim, rank, round(m, 6) + 0.0 AS mean,
  round((m - avg(m) OVER (PARTITION BY label)) / stddev_pop(m) OVER (PARTITION BY label), 6) + 0.0 AS z FROM k"""
QUERIES["i17_melt_dims"] = lambda spark, sf: _round(
    ops.melt_dims(_vec(spark, sf), ["vec_id", "label"], [3, 17, 40, 63]), ["value"]
)
SQL["i17_melt_dims"] = with_sql(LONG) + (
    "SELECT vec_id, label, dim, round(v, 6) + 0.0 AS value FROM lng WHERE dim IN (3, 17, 40, 63)"
)
QUERIES["i18_pca_profile"] = lambda spark, sf: _round(ops.pca_profile(_vec(spark, sf), "label"), ["cumulative"])
QUERIES["i19_pairwise_cohens_d"] = lambda spark, sf: _round(
    ops.pairwise_cohens_d(_vec(spark, sf), "label"), ["cohens_d"]
)
SQL["i19_pairwise_cohens_d"] = with_sql(LONG, MOMENTS) + f""",
e AS (SELECT a.label AS source_a, b.label AS source_b, a.dim, {EFFECT} AS d FROM mo a JOIN mo b ON a.dim = b.dim AND a.label < b.label),
k AS (SELECT dim, row_number() OVER (ORDER BY max(d) DESC, dim) AS rank FROM e GROUP BY dim)
SELECT source_a, source_b, dim, round(d, 6) AS cohens_d, rank FROM e JOIN k USING (dim) WHERE rank <= 30"""
QUERIES["i20_project_2d"] = lambda spark, sf: _round(ops.project_2d(_vec(spark, sf), "vec_id"), ["x", "y"])


def _relations(spark, sf):
    scored = pair_cosine(vector_pairs(spark, sf), vectors(spark, sf), clip=False)
    return _round(
        ops.score_by_relation(scored, "label", "score", [1, 0]), ["mean", "std", "low", "high", "q1", "q2", "q3"]
    )


QUERIES["i21_score_by_relation"] = _relations
SQL["i21_score_by_relation"] = with_sql(VPAIRS, f"s AS (SELECT label, {COS} AS score FROM vp)") + """
SELECT label, count(*) AS n, round(avg(score), 6) + 0.0 AS mean, round(stddev_samp(score), 6) AS std, round(min(score), 6) AS low,
  round(max(score), 6) AS high, round(quantile_cont(score, 0.25), 6) + 0.0 AS q1, round(quantile_cont(score, 0.5), 6) + 0.0 AS q2,
  round(quantile_cont(score, 0.75), 6) + 0.0 AS q3, CASE label WHEN 1 THEN 0 ELSE 1 END AS position FROM s GROUP BY label"""
QUERIES["i22_corpus_totals"] = lambda spark, sf: ops.corpus_totals(
    labelled=catalogue(spark, sf), renditions=renditions(spark, sf), annotated=annotated(spark, sf)
)
SQL["i22_corpus_totals"] = with_sql(CATALOGUE_SQL, RENDITIONS_SQL, ANNOTATED_SQL) + """,
c AS (SELECT 'labelled' AS source, count(*) AS n FROM cat UNION ALL SELECT 'renditions', count(*) FROM ren
  UNION ALL SELECT 'annotated', count(*) FROM ann)
SELECT * FROM c UNION ALL SELECT 'total', sum(n)::BIGINT FROM c"""
