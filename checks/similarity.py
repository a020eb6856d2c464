"""Pair scores: track i is user i (series), vector i (embedding) and document i (text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import r6, table, with_sql
from checks.windows import SERIES_SQL, series
from pairloom.functions.scalar_sql import register_sql_functions
from pairloom.operators import similarity as ops
from pairloom.operators.windows import tracks
from pairloom.plans import scoring

QUERIES: dict = {}
SQL: dict = {}

A, B = ops.A, ops.B
KEY = f"{A}, {B}"
STEPS = (1, 2, 3, 5, 8, 13, 21, 34)
BANDS = 8


# ---- vectors and their pairs: every vector with the vectors a few steps on
def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("vector"))


def vector_pairs(spark, sf):
    vecs = table(spark, sf, "embeddings").select("vec_id", "label")
    left = vecs.select(
        F.col("vec_id").alias(A), F.col("label").alias("_la"),
        F.explode(F.array(*[F.lit(s) for s in STEPS])).alias("_s"),
    ).withColumn(B, F.col(A) + F.col("_s"))
    right = vecs.select(F.col("vec_id").alias(B), F.col("label").alias("_lb"))
    return left.join(right, B).select(A, B, (F.col("_la") == F.col("_lb")).cast("int").alias("label"))


VPAIRS = f"""vp AS (SELECT a.vec_id AS {A}, b.vec_id AS {B}, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS label,
    a.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb
  FROM (SELECT *, unnest([{', '.join(map(str, STEPS))}]) AS s FROM embeddings) a JOIN embeddings b ON b.vec_id = a.vec_id + a.s)"""


def _cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


COS = _cos("va", "vb")


def _clip_sql(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


def _cosine(path):
    return lambda spark, sf: ops.pair_cosine(
        vector_pairs(spark, sf), vectors(spark, sf), path=path
    ).withColumn("score", r6(F.col("score")))


for _path in ("native", "arrow"):
    QUERIES[f"f01_cosine01_{_path}"] = _cosine(_path)
    SQL[f"f01_cosine01_{_path}"] = with_sql(VPAIRS) + (
        f"SELECT {KEY}, label, round({_clip_sql(COS)}, 6) + 0.0 AS score FROM vp"
    )


# ---- frames: each user's series folded into rows of eight values
def frames(spark, sf):
    return series(spark, sf).select(
        "track_id", F.floor(F.col("pos") / BANDS).alias("frame"), (F.col("pos") % BANDS).alias("band"), "value",
        F.floor(F.col("n") / BANDS).alias("_t"),
    ).where(F.col("frame") < F.col("_t")).drop("_t")


def user_pairs(spark, sf):
    ids = tracks(series(spark, sf)).select("track_id")
    left = ids.select(F.col("track_id").alias(A), F.explode(F.array(F.lit(1), F.lit(7))).alias("_s")).withColumn(
        B, F.col(A) + F.col("_s")
    )
    return left.join(ids.withColumnRenamed("track_id", B), B, "left_semi").select(A, B)


FRM = f"""frm AS (SELECT track_id, pos // {BANDS} AS frame, pos % {BANDS} AS band, value FROM ser WHERE pos // {BANDS} < n // {BANDS})"""
UPAIRS = f"""up AS (SELECT a.u AS {A}, b.u AS {B} FROM (SELECT DISTINCT user_id AS u FROM events) a
  JOIN (SELECT DISTINCT user_id AS u FROM events) b ON b.u = a.u + 1 OR b.u = a.u + 7)"""
FBASE = with_sql(SERIES_SQL, FRM, UPAIRS)

TIMBRAL = f"""mn AS (SELECT track_id, list(m ORDER BY band) AS v FROM (
    SELECT track_id, band, avg(value) AS m FROM frm GROUP BY 1, 2) GROUP BY 1),
tim AS (SELECT {KEY}, {_clip_sql('coalesce(' + _cos('a.v', 'b.v') + ', 0.0)')} AS timbral
  FROM up JOIN mn a ON a.track_id = {A} JOIN mn b ON b.track_id = {B})"""
QUERIES["f02_timbral_similarity"] = lambda spark, sf: ops.timbral_similarity(
    user_pairs(spark, sf), frames(spark, sf)
).withColumn("timbral", r6(F.col("timbral")))
SQL["f02_timbral_similarity"] = FBASE + "," + TIMBRAL + f"SELECT {KEY}, round(timbral, 6) + 0.0 AS timbral FROM tim"


def kinds(spark, sf):
    vec = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("track_id"),
        F.map_from_arrays(
            F.array(F.lit("low"), F.lit("high")), F.array(F.slice(vec, 1, 32), F.slice(vec, 33, 32))
        ).alias("kinds"),
    )


def _kind_sql(name: str, pairs: str, a: str, b: str) -> str:
    lo = _clip_sql(_cos(f"{a}[1:32]", f"{b}[1:32]"))
    hi = _clip_sql(_cos(f"{a}[33:64]", f"{b}[33:64]"))
    return f"{name} AS (SELECT {KEY}, {lo} AS low, {hi} AS high, ({lo} + {hi}) / 2 AS embedding FROM {pairs})"


QUERIES["f03_embedding_similarity"] = lambda spark, sf: ops.embedding_similarity(
    vector_pairs(spark, sf), kinds(spark, sf)
).select(
    A, B, r6(F.col("by_kind")["low"]).alias("low"), r6(F.col("by_kind")["high"]).alias("high"),
    r6(F.col("embedding")).alias("embedding"),
)
SQL["f03_embedding_similarity"] = with_sql(VPAIRS, _kind_sql("emb", "vp", "va", "vb")) + (
    f"SELECT {KEY}, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(embedding, 6) + 0.0 AS embedding FROM emb"
)


def texts(spark, sf):
    text = F.when(F.col("doc_id") % 10 < 2, "  ").otherwise(F.col("text"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("track_id"), text.alias("text"))


def doc_pairs(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias(A))
    pairs = ids.withColumn("_s", F.explode(F.array(F.lit(1), F.lit(4)))).withColumn(B, F.col(A) + F.col("_s"))
    return pairs.join(ids.withColumnRenamed(A, B), B, "left_semi").select(A, B)


def _text_sql(pairs: str) -> str:
    return f"""txt AS (SELECT doc_id, CASE WHEN doc_id % 10 < 2 THEN '  ' ELSE text END AS text FROM documents),
tc AS (SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS term FROM txt) WHERE term <> '' GROUP BY 1, 2),
tn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM tc GROUP BY 1),
td AS (SELECT {KEY}, sum(x.tf * y.tf) AS d FROM {pairs} JOIN tc x ON x.doc_id = {A} JOIN tc y ON y.doc_id = {B} AND y.term = x.term GROUP BY {KEY}),
lyr AS (SELECT p.{A}, p.{B}, CASE WHEN a.norm IS NULL AND b.norm IS NULL THEN NULL
    WHEN a.norm IS NULL OR b.norm IS NULL THEN 0.0 ELSE coalesce(d, 0) / (a.norm * b.norm) END AS lyrical
  FROM {pairs} p LEFT JOIN tn a ON a.doc_id = p.{A} LEFT JOIN tn b ON b.doc_id = p.{B}
  LEFT JOIN td ON td.{A} = p.{A} AND td.{B} = p.{B})"""


DPAIRS = f"""dp AS (SELECT a.doc_id AS {A}, b.doc_id AS {B} FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 OR b.doc_id = a.doc_id + 4)"""
QUERIES["f04_text_similarity"] = lambda spark, sf: ops.text_similarity(
    doc_pairs(spark, sf), texts(spark, sf)
).withColumn("lyrical", r6(F.col("lyrical")))
SQL["f04_text_similarity"] = with_sql(DPAIRS, _text_sql("dp")) + (
    f"SELECT {KEY}, round(lyrical, 6) + 0.0 AS lyrical FROM lyr"
)


def voices(spark, sf):
    vec = F.col("embedding")
    silent = F.transform(vec, lambda _: F.lit(0.0).cast("float"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("track_id"),
        F.when(F.col("vec_id") % 9 == 0, silent).otherwise(vec).alias("vector"),
        (F.col("label") % 4 != 0).alias("active"),
    )


def _voice_sql(pairs: str) -> str:
    return f"""voc AS (SELECT {KEY}, CASE WHEN a.label % 4 <> 0 AND b.label % 4 <> 0 AND a.vec_id % 9 <> 0 AND b.vec_id % 9 <> 0
    THEN {_cos('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} END AS vocal
  FROM (SELECT {KEY} FROM {pairs}) p JOIN embeddings a ON a.vec_id = {A} JOIN embeddings b ON b.vec_id = {B})"""


QUERIES["f05_gated_similarity"] = lambda spark, sf: ops.gated_similarity(
    vector_pairs(spark, sf).select(A, B), voices(spark, sf)
).withColumn("vocal", r6(F.col("vocal")))
SQL["f05_gated_similarity"] = with_sql(VPAIRS, _voice_sql("vp")) + f"SELECT {KEY}, round(vocal, 6) + 0.0 AS vocal FROM voc"


def _energy_gated(spark, sf):
    gate = ops.energy_gate(series(spark, sf), 900.0)
    active = vectors(spark, sf).join(gate, "track_id")
    return ops.gated_similarity(user_pairs(spark, sf), active).withColumn("vocal", r6(F.col("vocal")))


QUERIES["f05_energy_gate"] = _energy_gated
SQL["f05_energy_gate"] = FBASE + f""",
gate AS (SELECT user_id AS id, avg(value * value) > 900 AS active FROM events GROUP BY 1)
SELECT {KEY}, CASE WHEN ga.active AND gb.active THEN round({_cos('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) + 0.0 END AS vocal
FROM up JOIN gate ga ON ga.id = {A} JOIN gate gb ON gb.id = {B}
JOIN embeddings a ON a.vec_id = {A} JOIN embeddings b ON b.vec_id = {B}"""

# the whole matrices, resized cell by cell from their four neighbours
STRUCTURAL = f"""top AS (SELECT track_id, frame, max(abs(value)) AS top FROM frm GROUP BY 1, 2),
scl AS (SELECT track_id, frame, band, CASE WHEN top > 0 THEN value / top ELSE 0.0 END AS x FROM frm JOIN top USING (track_id, frame)),
ssm AS (SELECT a.track_id, a.frame AS i, b.frame AS j, sum(a.x * b.x) AS s FROM scl a JOIN scl b USING (track_id, band) GROUP BY 1, 2, 3),
fc AS (SELECT track_id, max(frame) + 1 AS t FROM frm GROUP BY 1),
sz AS (SELECT {KEY}, a.t AS ta, b.t AS tb, least(a.t, b.t, 200) AS m FROM up JOIN fc a ON a.track_id = {A} JOIN fc b ON b.track_id = {B}),
cell AS (SELECT {KEY}, side, CASE side WHEN 0 THEN {A} ELSE {B} END AS track_id,
    p * ((CASE side WHEN 0 THEN ta ELSE tb END) - 1) / (m - 1)::DOUBLE AS ap,
    q * ((CASE side WHEN 0 THEN ta ELSE tb END) - 1) / (m - 1)::DOUBLE AS aq, p, q
  FROM (SELECT *, unnest(range(0, m)) AS q FROM (SELECT *, unnest(range(0, m)) AS p FROM sz WHERE m >= 2)), (SELECT unnest([0, 1]) AS side)),
crn AS (SELECT *, CAST(floor(ap) AS BIGINT) + di AS i, CAST(floor(aq) AS BIGINT) + dj AS j,
    (CASE di WHEN 0 THEN 1 - (ap - floor(ap)) ELSE ap - floor(ap) END) * (CASE dj WHEN 0 THEN 1 - (aq - floor(aq)) ELSE aq - floor(aq) END) AS w
  FROM cell, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj)),
rsz AS (SELECT {KEY}, p, q, sum(w * s) FILTER (side = 0) AS x, sum(w * s) FILTER (side = 1) AS y
  FROM crn JOIN ssm USING (track_id, i, j) WHERE w > 0 GROUP BY {KEY}, p, q),
ncc AS (SELECT {KEY}, CASE WHEN stddev_pop(x) <= 1e-7 OR stddev_pop(y) <= 1e-7 THEN 0.0
    ELSE {_clip_sql('(corr(x, y) + 1) / 2')} END AS structural FROM rsz GROUP BY {KEY}),
stc AS (SELECT {KEY}, coalesce(structural, 0.0) AS structural FROM sz LEFT JOIN ncc USING ({KEY}))"""
QUERIES["f06_structural_similarity"] = lambda spark, sf: ops.structural_similarity(
    user_pairs(spark, sf), frames(spark, sf)
).withColumn("structural", r6(F.col("structural")))
SQL["f06_structural_similarity"] = FBASE + "," + STRUCTURAL + (
    f"SELECT {KEY}, round(structural, 6) + 0.0 AS structural FROM stc"
)

MELODIC = f"""fx AS (SELECT track_id, frame, list(value ORDER BY band) AS x FROM frm GROUP BY 1, 2),
fz AS (SELECT track_id, frame, CASE WHEN sqrt(list_dot_product(x, x)) < 1e-10 THEN list_value(1e-10::DOUBLE, 1e-10, 1e-10, 1e-10, 1e-10, 1e-10, 1e-10, 1e-10) ELSE x END AS x FROM fx),
fl AS (SELECT track_id, list(x ORDER BY frame) AS f, count(*) AS t FROM fz GROUP BY 1),
dtw AS (SELECT {KEY}, a.f AS fa, b.f AS fb, a.t AS n, b.t AS m, 0::BIGINT AS step, []::DOUBLE[] AS prev, []::DOUBLE[] AS cur
    FROM up JOIN fl a ON a.track_id = {A} JOIN fl b ON b.track_id = {B} WHERE a.t >= 2 AND b.t >= 2
  UNION ALL
  SELECT {KEY}, fa, fb, n, m, step + 1, pr, list_append(cu, (1 - {_cos('fa[i + 1]', 'fb[j + 1]')}) +
      CASE WHEN i = 0 AND j = 0 THEN 0 ELSE least(
        CASE WHEN i > 0 THEN pr[j + 1] ELSE 'Infinity'::DOUBLE END,
        CASE WHEN j > 0 THEN cu[j] ELSE 'Infinity'::DOUBLE END,
        CASE WHEN i > 0 AND j > 0 THEN pr[j] ELSE 'Infinity'::DOUBLE END) END)
  FROM (SELECT *, step // m AS i, step % m AS j, CASE WHEN step % m = 0 THEN cur ELSE prev END AS pr,
          CASE WHEN step % m = 0 THEN []::DOUBLE[] ELSE cur END AS cu FROM dtw) WHERE step < n * m),
mel AS (SELECT {KEY}, CASE WHEN a.t < 2 OR b.t < 2 THEN 0.0 ELSE {_clip_sql('1 - d.cur[d.m] / (d.n + d.m)')} END AS melodic
  FROM up JOIN fl a ON a.track_id = {A} JOIN fl b ON b.track_id = {B}
  LEFT JOIN (SELECT * FROM dtw WHERE step = n * m) d USING ({KEY}))"""


def _melodic(path):
    return lambda spark, sf: ops.melodic_similarity(
        user_pairs(spark, sf), frames(spark, sf), path
    ).withColumn("melodic", r6(F.col("melodic")))


for _path in ("fold", "arrow"):
    QUERIES[f"f07_melodic_similarity_{_path}"] = _melodic(_path)
    SQL[f"f07_melodic_similarity_{_path}"] = FBASE.replace("WITH ", "WITH RECURSIVE ", 1) + "," + MELODIC + (
        f"SELECT {KEY}, round(melodic, 6) + 0.0 AS melodic FROM mel"
    )


# ---- tier-2 vectors: the first 22 numbers of each embedding, stretched
def tier2(spark, sf):
    vec = F.slice(F.col("embedding").cast("array<double>"), 1, 22)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("track_id"), F.transform(vec, lambda x: F.abs(x) * 10.0).alias("features")
    )


def _tier(i: int) -> str:
    return f"abs(embedding[{i + 1}]::DOUBLE) * 10"


ARTIFACT = f"""art AS (SELECT vec_id AS track_id, {_clip_sql(
    '0.15 * ' + _clip_sql(f'({_tier(0)} - 1) / 1.5') + ' + 0.15 * ' + _clip_sql(f'1 - {_tier(7)} / 20')
    + ' + 0.10 * ' + _clip_sql(f'{_tier(8)} * 5') + ' + 0.10 * ' + _clip_sql(f'abs({_tier(10)} - 0.87) / 0.3')
    + ' + 0.50 * (' + ' + '.join(_tier(i) for i in range(12, 22)) + ') / 10')} AS artifact FROM embeddings)"""
QUERIES["f08_artifact_score"] = lambda spark, sf: scoring.artifacts(tier2(spark, sf)).withColumn(
    "artifact", r6(F.col("artifact"))
)
SQL["f08_artifact_score"] = with_sql(ARTIFACT) + "SELECT track_id, round(artifact, 6) + 0.0 AS artifact FROM art"


# ---- components read off two vectors, some of them absent
def components(spark, sf):
    joined = ops.both_sides(vector_pairs(spark, sf), vectors(spark, sf), ["vector"])
    part = lambda i: F.least(F.lit(1.0), F.abs(
        F.element_at("vector_a", i).cast("double") + F.element_at("vector_b", i).cast("double")) * 4)
    absent = lambda c, k: F.when(F.col(A) % k != 0, c)
    return joined.select(
        A, B, part(1).alias("melodic"), part(2).alias("timbral"), part(3).alias("structural"),
        absent(part(4), 7).alias("embedding"), absent(part(5), 5).alias("neural"),
        absent(part(6), 3).alias("lyrical"), absent(part(7), 2).alias("vocal"),
    )


def _part(i: int) -> str:
    return f"least(1.0, abs(va[{i}] + vb[{i}]) * 4)"


_ORDER = list(ops.WEIGHTS)
COMPONENTS = f"""cmp AS (SELECT {KEY}, {_part(1)} AS melodic, {_part(2)} AS timbral, {_part(3)} AS structural,
  CASE WHEN {A} % 7 <> 0 THEN {_part(4)} END AS embedding, CASE WHEN {A} % 5 <> 0 THEN {_part(5)} END AS neural,
  CASE WHEN {A} % 3 <> 0 THEN {_part(6)} END AS lyrical, CASE WHEN {A} % 2 <> 0 THEN {_part(7)} END AS vocal FROM vp)"""


def blend_sql(source: str, cols) -> str:
    top = " + ".join(f"coalesce({c}, 0) * {ops.WEIGHTS[c]}" for c in cols)
    den = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {ops.WEIGHTS[c]}::DOUBLE END" for c in cols)
    values = ", ".join(cols)
    return f"""bl0 AS (SELECT *, ({top}) / ({den}) AS attribution_score, {den} AS weight_total,
    (SELECT CASE WHEN count(v) > 1 THEN stddev_pop(v) ELSE 0 END FROM (SELECT unnest([{values}]) AS v)) AS component_std FROM {source}),
bl AS (SELECT *, CASE WHEN abs(attribution_score - 0.5) > 0.25 AND component_std < 0.15 THEN 'high'
    WHEN abs(attribution_score - 0.5) > 0.12 OR component_std < 0.20 THEN 'medium' ELSE 'low' END AS confidence,
    attribution_score > 0.65 AS is_likely_attribution FROM bl0)"""


def _scored(spark, sf):
    return ops.confidence(ops.attribution_score(components(spark, sf))).withColumn(
        "is_likely_attribution", ops.is_attribution(F.col("attribution_score"))
    )


BLEND = with_sql(VPAIRS, COMPONENTS, blend_sql("cmp", _ORDER))
QUERIES["f09_attribution_score"] = lambda spark, sf: ops.attribution_score(components(spark, sf)).select(
    A, B, r6(F.col("attribution_score")).alias("attribution_score")
)
SQL["f09_attribution_score"] = BLEND + f"SELECT {KEY}, round(attribution_score, 6) AS attribution_score FROM bl"
QUERIES["f10_confidence"] = lambda spark, sf: _scored(spark, sf).select(
    A, B, r6(F.col("component_std")).alias("component_std"), "confidence"
)
SQL["f10_confidence"] = BLEND + f"SELECT {KEY}, round(component_std, 6) AS component_std, confidence FROM bl"
QUERIES["f11_is_attribution"] = lambda spark, sf: _scored(spark, sf).select(A, B, "is_likely_attribution")
SQL["f11_is_attribution"] = BLEND + f"SELECT {KEY}, is_likely_attribution FROM bl"

QUERIES["f12_fast_screen"] = lambda spark, sf: ops.fast_screen(
    vector_pairs(spark, sf).select(A, B), scoring.artifacts(tier2(spark, sf))
).withColumn("attribution_score", r6(F.col("attribution_score"))).drop("artifact_a", "artifact_b")
SQL["f12_fast_screen"] = with_sql(VPAIRS, ARTIFACT) + f"""
SELECT {KEY}, round(s, 6) AS attribution_score, s > 0.65 AS is_likely_attribution,
  CASE WHEN s > 0.8 THEN 'high' WHEN s > 0.5 THEN 'medium' ELSE 'low' END AS confidence, 'fast' AS mode
FROM (SELECT {KEY}, greatest(a.artifact, b.artifact) AS s FROM vp JOIN art a ON a.track_id = {A} JOIN art b ON b.track_id = {B})"""


# ---- whole pair table through the plan
def track_tables(spark, sf):
    return scoring.TrackTables(
        tier2=tier2(spark, sf), chroma_frames=frames(spark, sf), cepstrum_frames=frames(spark, sf),
        embeddings=kinds(spark, sf), texts=texts(spark, sf), voices=voices(spark, sf),
    )


_OUT = ["attribution_score", "component_std", "confidence", "is_likely_attribution"]


def _score_pairs(**toggles):
    def run(spark, sf):
        out = scoring.score_pairs(user_pairs(spark, sf), track_tables(spark, sf), **toggles)
        parts = [c for c in _ORDER if c in out.columns]
        return out.select(
            A, B, *[r6(F.col(c), 5).alias(c) for c in [*parts, "attribution_score", "component_std"]],
            "confidence", "is_likely_attribution",
        )

    return run


def _score_sql(cols) -> str:
    sources = {
        "melodic": "mel", "timbral": "tim", "structural": "stc", "embedding": "emb", "lyrical": "lyr", "vocal": "voc",
    }
    both = f"""uv AS (SELECT {KEY}, a.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb
  FROM up JOIN embeddings a ON a.vec_id = {A} JOIN embeddings b ON b.vec_id = {B})"""
    parts = [both, TIMBRAL, STRUCTURAL, MELODIC, _kind_sql("emb", "uv", "va", "vb"), _text_sql("up"), _voice_sql("up")]
    joins = " ".join(f"LEFT JOIN {sources[c]} USING ({KEY})" for c in cols)
    names = ", ".join(cols)
    out = ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in [*cols, "attribution_score", "component_std"])
    return (
        FBASE.replace("WITH ", "WITH RECURSIVE ", 1) + "," + ",\n".join(parts)
        + f",\nallc AS (SELECT {KEY}, {names} FROM uv {joins}),\n" + blend_sql("allc", cols)
        + f"\nSELECT {KEY}, {out}, confidence, is_likely_attribution FROM bl"
    )


QUERIES["f13_score_pairs_plain"] = _score_pairs(use_embeddings=False, use_lyrics=False, use_vocals=False)
SQL["f13_score_pairs_plain"] = _score_sql(["melodic", "timbral", "structural"])
QUERIES["f14_score_pairs_full"] = _score_pairs(mode="full")
SQL["f14_score_pairs_full"] = _score_sql(["melodic", "timbral", "structural", "embedding", "lyrical", "vocal"])


def _result(spark, sf):
    arts = scoring.artifacts(tier2(spark, sf))
    out = ops.result_struct(ops.both_sides(_scored(spark, sf), arts, ["artifact"]))
    number = lambda p: r6(F.get_json_object("json", p)).alias(p.split(".")[-1])
    return out.select(
        A, B, number("$.attribution_score"), number("$.ai_artifact_score.track_a"),
        number("$.details.component_agreement_std"), number("$.details.weights_used.neural"),
        r6(F.col("result.details.component_scores")["vocal"]).alias("vocal"),
        F.get_json_object("json", "$.confidence").alias("confidence"),
        F.get_json_object("json", "$.is_likely_attribution").alias("likely"),
    )


QUERIES["f15_result_struct"] = _result
SQL["f15_result_struct"] = with_sql(VPAIRS, COMPONENTS, ARTIFACT, blend_sql("cmp", _ORDER)) + f"""
SELECT {KEY}, round(attribution_score, 6) AS attribution_score, round(a.artifact, 6) AS track_a,
  round(component_std, 6) AS component_agreement_std,
  CASE WHEN neural IS NOT NULL THEN round(0.30::DOUBLE / weight_total, 6) END AS neural, round(vocal, 6) AS vocal,
  confidence, CASE WHEN is_likely_attribution THEN 'true' ELSE 'false' END AS likely
FROM bl JOIN art a ON a.track_id = {A}"""


def chunks(spark, sf):
    vec = F.col("embedding")
    quarters = F.array(*[F.slice(vec, 16 * i + 1, 16) for i in range(4)])
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("track_id"), F.posexplode(quarters).alias("chunk", "vector")
    )


def _coarse(threshold):
    return lambda spark, sf: ops.coarse_to_fine(
        vector_pairs(spark, sf), vectors(spark, sf), chunks(spark, sf), threshold
    ).select(A, B, *[r6(F.col(c)).alias(c) for c in ("coarse", "fine", "score")])


def _coarse_sql(where: str) -> str:
    return with_sql(VPAIRS) + f""",
co AS (SELECT {KEY}, va, vb, {COS} AS coarse FROM vp),
qa AS (SELECT {KEY}, coarse, vb, i, va[16 * i + 1 : 16 * i + 16] AS x FROM co, (SELECT unnest(range(0, 4)) AS i) {where}),
qb AS (SELECT {KEY}, coarse, i, x, vb[16 * j + 1 : 16 * j + 16] AS y FROM qa, (SELECT unnest(range(0, 4)) AS j)),
bs AS (SELECT {KEY}, coarse, i, max({_cos('x', 'y')}) AS best FROM qb GROUP BY {KEY}, coarse, i)
SELECT {KEY}, round(coarse, 6) + 0.0 AS coarse, round(avg(best), 6) + 0.0 AS fine,
  round(0.3 * coarse + 0.7 * avg(best), 6) + 0.0 AS score FROM bs GROUP BY {KEY}, coarse"""


QUERIES["f16_coarse_to_fine"] = _coarse(None)
SQL["f16_coarse_to_fine"] = _coarse_sql("")
QUERIES["f16_coarse_to_fine_pruned"] = _coarse(0.1)
SQL["f16_coarse_to_fine_pruned"] = _coarse_sql("WHERE coarse >= 0.1")


def _by_relation(spark, sf):
    out = ops.pair_cosine_by(vector_pairs(spark, sf), vectors(spark, sf), "label")
    return out.select("label", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "low", "high")])


QUERIES["f17_pair_cosine_by"] = _by_relation
SQL["f17_pair_cosine_by"] = with_sql(VPAIRS) + f"""
SELECT label, count(*) AS n, round(avg({COS}), 6) + 0.0 AS mean, round(min({COS}), 6) + 0.0 AS low,
  round(max({COS}), 6) + 0.0 AS high FROM vp GROUP BY label"""


# ---- the same scalars called from SQL text
def _sql_functions(spark, sf):
    register_sql_functions(spark)
    ops.both_sides(vector_pairs(spark, sf), vectors(spark, sf), ["vector"]).withColumn(
        "features", F.transform(F.slice(F.col("vector_a").cast("array<double>"), 1, 22), lambda x: F.abs(x) * 10.0)
    ).createOrReplaceTempView("pair_vectors")
    return spark.sql(
        f"""SELECT {KEY},
          round(cosine01(cast(vector_a AS array<double>), cast(vector_b AS array<double>)), 6) AS score,
          cache_key(cast({A} AS string), cast({B} % 3 AS int)) AS cache_key,
          round(artifact_score(features), 6) AS artifact,
          round(attribution_score(0.2D, features[1] / 10, 0.4D, 0.5D, CASE WHEN {A} % 2 = 0 THEN 0.6D END, NULL, 0.1D), 6) AS blended
        FROM pair_vectors"""
    )


QUERIES["u02_sql_functions"] = _sql_functions
SQL["u02_sql_functions"] = with_sql(VPAIRS, ARTIFACT) + f"""
SELECT {KEY}, round({_clip_sql(COS)}, 6) + 0.0 AS score,
  sha256({A} || '|10.0|5.0|16000' || CASE WHEN {B} % 3 > 0 THEN '|aug_' || ({B} % 3) ELSE '' END) AS cache_key,
  round(artifact, 6) AS artifact,
  round((0.2 * 0.15 + abs(va[2]) * 0.15 + 0.4 * 0.1 + 0.5 * 0.15 + CASE WHEN {A} % 2 = 0 THEN 0.6 * 0.3 ELSE 0 END + 0.1 * 0.05)
    / (0.15 + 0.15 + 0.1 + 0.15 + 0.05 + CASE WHEN {A} % 2 = 0 THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS blended
FROM vp JOIN art a ON a.track_id = {A}"""
