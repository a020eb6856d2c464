"""Registered queries of the subpackage: the given tables mapped to the operators and back."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.alignment import token_alignments
from pairloom.llm.brown import class_model_scores
from pairloom.llm.decontamination import contaminated_passages
from pairloom.llm.licences import SCAN_SQL, licence_scan, notices
from pairloom.llm.maxscore import top_k_tracks
from pairloom.llm.packing import pack_tracks
from pairloom.llm.quality import quality_scores
from pairloom.llm.repeats import without_repeats
from pairloom.llm.secrets import announced_labels, secret_candidates, secret_findings
from pairloom.llm.simhash import near_duplicate_groups
from pairloom.llm.storage import stored
from pairloom.llm.toxicity import toxicity_scores
from pairloom.llm.trie import digest_of_lists, prefix_trie
from pairloom.llm.urls import link_parts, link_verdicts, longest_rule
from pairloom.operators.ranking import depth_bounds, depth_bucket, exact_rank

# fixed values: the rules of op9
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def tracks_of(documents: DataFrame) -> DataFrame:
    """documents as tracks: the text plays the lyrics, the source the folder of the file."""
    return documents.select(
        F.col("doc_id").alias("track_id"), F.col("text").alias("lyrics"), F.col("source").alias("path")
    )


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    return tracks_of(spark.read.parquet(f"{sf}/documents.parquet"))


def _remainder(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("track_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_secret_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = stored(secret_candidates(_tracks(spark, sf)))
    judged = secret_findings(found, announced_labels(found))
    return judged.select(F.col("track_id").alias("doc_id"), "start", "length", "token_sha256", "probability", "is_secret")


def op2_maxscore_top5(spark: SparkSession, sf: str) -> DataFrame:
    finite = lambda x: F.abs(x) < float("inf")  # noqa: E731  false for NaN, which is larger
    whole = F.transform("embedding", lambda x: F.when(finite(x), F.floor(F.when(finite(x), x.cast("double")).otherwise(0.0) * 256)))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("track_id"), whole.alias("vector"))
    found = top_k_tracks(vectors, vectors.where(F.col("track_id") % 50 == 0))
    return found.withColumnRenamed("track_id", "vec_id")


def op3_repeated_strings(spark: SparkSession, sf: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return without_repeats(_tracks(spark, sf)).select(
        F.col("track_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def training_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("track_id"), "toxic")
    return labels.where(_remainder(4) != 2)


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    scored = toxicity_scores(_tracks(spark, sf), training_labels(spark, sf))
    return scored.select(F.col("track_id").alias("doc_id"), (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op5_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_groups(_tracks(spark, sf)).withColumnRenamed("track_id", "doc_id")


def op6_brown_scores(spark: SparkSession, sf: str) -> DataFrame:
    tracks = _tracks(spark, sf)
    scored = class_model_scores(tracks, tracks.where(_remainder(5) != 1))
    return scored.withColumn("held_out", _remainder(5) == 1).withColumnRenamed("track_id", "doc_id")


def op7_pack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    packed = pack_tracks(_tracks(spark, sf))
    return packed.withColumnsRenamed({"track_id": "doc_id", "track_tokens": "doc_tokens"})


def op8_licence_digests(spark: SparkSession, sf: str) -> DataFrame:
    found = licence_scan(_tracks(spark, sf), notices(spark))
    return found.withColumnsRenamed({"track_id": "doc_id", "licence_id": "license_id"})


def op9_url_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The pages that a rule decides are the labelled ones; the trees judge the others."""
    links = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("track_id"), "url")
    _, said = longest_rule(*link_parts(F.col("url")), URL_RULES)
    labelled = links.select("url", (said == "block").cast("int").alias("blocked"))
    return link_verdicts(links, labelled, URL_RULES).withColumnRenamed("track_id", "page_id")


def op10_benchmark_passages(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    found = contaminated_passages(_tracks(spark, sf), items)
    return found.drop("text_key").withColumnRenamed("track_id", "doc_id")


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    digest = lambda groups: hashlib.sha256(groups.encode()).hexdigest() if groups else ""
    found = token_alignments(_tracks(spark, sf), finish=digest)
    return found.withColumnsRenamed({"track_id": "doc_id", "groups": "groups_sha256"})


def op12_quality(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("track_id"), "quality")
    scored = quality_scores(_tracks(spark, sf), labels.where(_remainder(5) != 0))
    return scored.select(F.col("track_id").alias("doc_id"), (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, tracks): every conversation opens with the first turns of its hundred's first one."""
    turns = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("track_id"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranked = exact_rank(turns, ["track_id"], order, depth_bucket(F.col("turn"), depth_bounds(turns, F.col("turn"))), name="position")
    ranked = stored(ranked.select("track_id", "position", F.col("role").alias("label"), F.col("text").alias("lyrics")))
    taken = (F.crc32(F.col("track_id").cast("string").cast("binary")) % 6).alias("taken")
    tracks = ranked.select("track_id").distinct()
    heirs = tracks.select(F.col("track_id").alias("heir"), taken, (F.col("track_id") - F.col("track_id") % 100).alias("track_id"))
    first = ranked.where("position <= 5").join(heirs, "track_id").where("position <= taken").select(F.col("heir").alias("track_id"), "position", "label", "lyrics")
    return first.unionAll(ranked.where(F.col("position") > taken)), tracks


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    sections, tracks = _rebuilt(spark.read.parquet(f"{sf}/conversations.parquet"))
    trie = prefix_trie(stored(sections), tracks)
    ends = digest_of_lists(trie.ends, ["node_id", "depth"], "track_id", "ends_sha256").withColumnRenamed("node_id", "track_id")
    nodes = trie.nodes.join(ends, ["track_id", "depth"], "left").withColumnsRenamed({"track_id": "conv_id", "parent_id": "parent_conv_id", "n_tracks": "n_convs", "saved": "saved_tokens"})
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


QUERIES = {
    "op1_secret_findings": op1_secret_findings,
    "op2_maxscore_top5": op2_maxscore_top5,
    "op3_repeated_strings": op3_repeated_strings,
    "op4_toxicity": op4_toxicity,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_brown_scores": op6_brown_scores,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_licence_digests": op8_licence_digests,
    "op9_url_verdicts": op9_url_verdicts,
    "op10_benchmark_passages": op10_benchmark_passages,
    "op11_token_alignment": op11_token_alignment,
    "op12_quality": op12_quality,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL = {
    "op2_maxscore_top5": """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op8_licence_digests": SCAN_SQL,
    "op13_prefix_trie": """WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
      lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT crc.c, p, role, text FROM crc JOIN t ON t.c = crc.c - crc.c % 100 AND p <= h
  UNION ALL SELECT t.c, p, role, text FROM t JOIN crc USING (c) WHERE p > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, role, text FROM r),
path AS (
  SELECT c, d, length(text) AS n, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS seq FROM s
  UNION ALL SELECT c, 0, 0, [] FROM crc),
owned AS (SELECT c, d, n, min(c) OVER (PARTITION BY seq) AS o, count(*) OVER (PARTITION BY seq) AS k FROM path),
node AS (
  SELECT x.o, x.d, x.n, x.k, y.o AS up FROM owned x LEFT JOIN owned y ON y.c = x.c AND y.d = x.d - 1 WHERE x.c = x.o),
kids AS (SELECT up, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.k, 0) AS ch FROM node LEFT JOIN kids ON kids.up = node.o AND kids.d = node.d),
sums AS (
  SELECT a.o, a.d, sum(CAST(f.ch = 0 AS BIGINT)) AS leaves, sum((f.k - 1) * f.n) AS saved
  FROM full_node f JOIN owned a ON a.c = f.o AND a.d <= f.d GROUP BY ALL),
ends AS (
  SELECT o, d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h
  FROM (SELECT * FROM owned QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY ALL)
SELECT f.o AS conv_id, f.d AS depth, f.up AS parent_conv_id, f.k AS n_convs, f.ch AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends.h, sha256('')) AS ends_sha256
FROM full_node f JOIN sums USING (o, d) LEFT JOIN ends USING (o, d)""",
}
