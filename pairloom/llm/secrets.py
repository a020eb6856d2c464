"""Secrets in lyrics: candidate strings, sorted out by a random forest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.storage import bounded_batches, stored

#: labelled findings used at most, chosen by hash; words of the dictionary, trees, depth, decision
MAX_LABELLED, DICTIONARY, TREES, DEPTH, THRESHOLD = 20_000, 5000, 30, 8, 0.5
#: bytes of text kept on either side of a candidate
CONTEXT = 48
# fixed values: words that announce a secret
ANNOUNCING = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "auth", "bearer", "credential")
LONG = re.compile(rb"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}")
ASSIGNED = re.compile(rb"(?i)(?:" + "|".join(ANNOUNCING).encode() + rb")[\"']?\s{0,4}[:=]\s{0,4}[\"']?([^\s\"',;]{8,})")
FOUND = "track_id long, text_key long, path string, start long, length long, token string, before string, after string"
REDACTED = b"[redacted]"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [column.split()[0] for column in FOUND.split(", ")]
    for batch in batches:
        out = []
        for track, key, path, text in zip(*(batch.column(k) for k in range(4))):
            text = text.as_py() or b""
            spans = {m.span() for m in LONG.finditer(text)}
            lowered = text.lower()
            if any(word.encode() in lowered for word in ANNOUNCING):
                taken = sorted(spans)
                for m in ASSIGNED.finditer(text):
                    a, b = m.span(1)
                    if not any(x < b and a < y for x, y in taken):
                        spans.add((a, b))
            for a, b in sorted(spans):
                around = (text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT])
                out.append((track.as_py(), key.as_py(), path.as_py(), a, b - a, *(s.decode("utf-8", "replace") for s in around)))
        columns = list(zip(*out)) or [()] * len(names)
        kinds = [pa.int64() if " long" in c else pa.string() for c in FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def with_key(tracks: DataFrame, text: str) -> DataFrame:
    """track_id, text_key (names a text, so that rows without or with repeated ids stay apart), path, text."""
    path = F.col("path") if "path" in tracks.columns else F.lit("")
    return tracks.select(
        F.col("track_id").cast("long"), F.xxhash64(text).alias("text_key"), path.alias("path"), F.col(text).cast("binary").alias("text")
    )


def secret_candidates(tracks: DataFrame, text: str = "lyrics") -> DataFrame:
    """One row per candidate of a whole text: byte position, string, and the text around it.

    Candidates are runs of 16 or more letters, digits and ``_+/=-``, and strings of 8 or more that are assigned
    to a word like ``password``. Null texts have none; a missing ``path`` column is an empty path.
    """
    bounded_batches(tracks.sparkSession)
    return with_key(tracks, text).mapInArrow(_candidates, FOUND)


def _features(token: str, before: str, after: str, path: str | None, dictionary: set[str]) -> list[float]:
    n = max(len(token), 1)
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    counts = np.unique(list(token), return_counts=True)[1] / n if token else np.ones(1)
    lowered, covered, at = token.lower(), 0, 0
    while at < len(lowered):
        size = next((k for k in range(min(12, len(lowered) - at), 2, -1) if lowered[at : at + k] in dictionary), 0)
        covered, at = covered + size, at + (size or 1)
    last = re.findall(r"[\w-]+", before.lower())[-2:]
    parts = (path or "").lower().split("/")
    return [
        float(len(token)), changes / n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("s") / n,
        sum(c in "0123456789abcdefABCDEF" for c in token) / n, float(-(counts * np.log2(counts)).sum()), covered / n,
        float(any(w in x for x in last for w in ANNOUNCING)), float(before.rstrip()[-1:] in ("=", ":") or before.rstrip(" \"'")[-1:] in ("=", ":")),
        float(before[-1:] in ("'", '"') and after[:1] == before[-1:]), float("@" in after[:1] + before[-1:]),
        float(any(w in dictionary for w in re.findall(r"[^\W\d_]+", after.lower())[:2])),
        float(len(parts)), float(any(w in p for p in parts for w in ("test", "example", "sample", "mock", "fixture"))),
        float(parts[-1].rpartition(".")[2] in ("env", "cfg", "conf", "ini", "json", "yaml", "yml", "pem", "key")),
    ]


def secret_findings(found: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """All candidates of ``found`` with token_sha256, probability and is_secret (0/1).

    ``labelled`` (track_id, start, secret 0/1) holds checked findings; about ``max_labelled`` of them, chosen
    by hash, give the dictionary (frequent words around them) and train a random forest on length,
    character transitions, dictionary coverage, path and neighbouring words. Labels of one kind only give that
    kind to all, no labels make every candidate a secret. Null labels are left out.
    """
    known = labelled.where("track_id is not null and start is not null and secret is not null")
    known = known.groupBy("track_id", "start").agg(F.max("secret").cast("double").alias("secret"))
    share = F.lit((1 << 30) * max_labelled // max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("track_id", "start"), F.lit(1 << 30)) < share)
    # about max_labelled rows of 24 bytes: small enough to send to every task
    sample = stored(found.join(F.broadcast(chosen), ["track_id", "start"]))
    word = F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit(r"(\p{L}{3,12})"), F.lit(1)))
    top = sample.select(word.alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(DICTIONARY)
    dictionary = {r["word"] for r in top.collect()}
    kinds = {r["secret"] for r in sample.select("secret").distinct().collect()}
    hashed = F.sha2("token", 256).alias("token_sha256")
    if len(kinds) < 2:
        sure = 0.0 if kinds == {0.0} else 1.0
        return found.select("*", hashed, F.lit(sure).alias("probability"), F.lit(int(sure)).alias("is_secret"))

    def described(df: DataFrame) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("token", "before", "after", "path")]
                values = [_features(*row, dictionary) for row in zip(*columns)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))], [*batch.schema.names, "values"])

        schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", values array<double>"
        return df.mapInArrow(add, schema).withColumn("features", array_to_vector("values"))

    forest = RandomForestClassifier(labelCol="secret", numTrees=TREES, maxDepth=DEPTH, seed=11)
    fitted = forest.fit(described(sample).select("features", "secret"))
    judged = fitted.transform(described(found)).withColumn("probability", vector_to_array("probability")[1])
    return judged.select(*found.columns, hashed, "probability", (F.col("probability") >= threshold).cast("int").alias("is_secret"))


def announced_labels(found: DataFrame) -> DataFrame:
    """Labels for the candidates that their surroundings decide, where no checked findings exist.

    Quoted and assigned to an announcing word: a secret; letters only, or part of a mail address: none.
    """
    assigned = r"(?i)(" + "|".join(ANNOUNCING) + r")\s*[:=]\s*[\"']$"
    letters = F.col("token").rlike(r"^[A-Za-z_=+/-]+$")
    mail = F.col("after").startswith("@") | F.col("before").endswith("@")
    secret = F.when(F.col("before").rlike(assigned) & ~letters, 1).when(letters | mail, 0)
    return found.select("track_id", "start", secret.alias("secret")).where("secret is not null")


def redacted(tracks: DataFrame, findings: DataFrame, text: str = "lyrics", track_id: str = "track_id") -> DataFrame:
    """``tracks`` with every secret of ``findings`` in ``text`` replaced; all rows and columns stay."""
    by_text = findings.where("is_secret = 1").groupBy(F.col("track_id").alias("_secret_track"), F.col("text_key").alias("_secret_text"))
    by_text = by_text.agg(F.collect_set(F.struct("start", "length")).alias("_secret_spans"))
    same = F.col(track_id).cast("long").eqNullSafe(F.col("_secret_track")) & (F.xxhash64(text) == F.col("_secret_text"))
    joined = tracks.join(by_text, same, "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        def one(text, cuts):
            if text is None or cuts is None or not len(cuts):
                return text
            raw, out, at = text.encode(), [], 0
            for start, length in sorted((c["start"], c["length"]) for c in cuts):
                out += [raw[at:start], REDACTED]
                at = start + length
            return b"".join([*out, raw[at:]]).decode("utf-8", "replace")

        return texts.combine(spans, one)

    changed = F.when(F.col("_secret_spans").isNotNull(), cut(F.col(text), F.col("_secret_spans"))).otherwise(F.col(text))
    return joined.withColumn(text, changed).select(*tracks.columns)
