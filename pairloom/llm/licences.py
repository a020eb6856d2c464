"""Licence texts found by digests of their canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.storage import stored

# fixed values: spellings that mean the same, written out as found and as kept
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("labour", "labor"),
    ("non-commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("http://", "https://"),
)
# fixed values: short notices by which works name their licence
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
)
COPYRIGHT_LINE = r"^[ \t*#/-]*(copyright|\(c\)|©|all rights reserved)"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text: Column) -> Column:
    """Lines in lower case and one spelling, with one space for every run of punctuation and white space.

    Copyright lines are empty. Null counts as an empty text.
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    for found, kept in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(kept))

    def words(line: Column) -> Column:
        return F.when(line.rlike(COPYRIGHT_LINE), "").otherwise(F.trim(F.regexp_replace(line, PUNCTUATION, " ")))

    return F.transform(F.split(out, "\n"), words)


def with_canonical(texts: DataFrame, text: str) -> DataFrame:
    """Adds lines, the canonical lines with words, and whole, all of them in a row."""
    lines = F.filter(canonical_lines(F.col(text)), lambda x: x != "")
    return texts.withColumn("lines", lines).withColumn("whole", F.array_join("lines", " "))


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES), "licence_id string, text string")


def licence_scan(tracks: DataFrame, licences: DataFrame, text: str = "lyrics") -> DataFrame:
    """(track_id, text_sha256, licence_id, notice_ids, n_notices) of every track.

    The canonical form of the whole text, and of every line as a text of its own, is joined by digest with
    the canonical forms of ``licences`` (licence_id, text). ``licence_id`` is that of the whole text or
    null; ``notice_ids`` names the licences of lines, sorted and joined by commas, empty if none. Of
    licences with one canonical form the smallest id counts, those without words are left out. Null texts
    are empty. Rows without track_id and repeated rows are kept. Extra columns are ignored.
    """
    known = with_canonical(licences.where("licence_id is not null").select("licence_id", F.col("text").alias("_t")), "_t")
    known = stored(
        known.where("whole <> ''").groupBy("whole").agg(F.min("licence_id").alias("licence_id"))
        .select(F.sha2("whole", 256).alias("digest"), "licence_id", F.length("whole").alias("size"))
    )
    longest = known.agg(F.coalesce(F.max("size"), F.lit(0)).alias("n")).first()["n"]
    known = known.drop("size")
    short = F.filter("lines", lambda x: F.length(x) <= longest)  # a longer line is none of them
    read = with_canonical(tracks.select("track_id", F.col(text).alias("_t")), "_t")
    whole = stored(read.select("track_id", F.sha2("whole", 256).alias("text_sha256"), F.transform(F.array_distinct(short), lambda x: F.sha2(x, 256)).alias("digests")))
    named = (
        whole.select("track_id", "text_sha256", F.explode("digests").alias("digest"))
        .join(known, "digest")
        .groupBy(F.col("track_id").alias("t"), F.col("text_sha256").alias("s"))
        .agg(F.array_sort(F.collect_set("licence_id")).alias("found"))
    )
    of_text = known.select(F.col("digest").alias("text_sha256"), "licence_id")
    out = whole.drop("digests").join(of_text, "text_sha256", "left")
    out = out.join(named, F.col("track_id").eqNullSafe(F.col("t")) & (F.col("text_sha256") == F.col("s")), "left")
    return out.select(
        "track_id", "text_sha256", "licence_id",
        F.coalesce(F.array_join("found", ","), F.lit("")).alias("notice_ids"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_notices"),
    )


def _canonical_sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for found, kept in SPELLINGS:
        out = f"replace({out}, '{found}', '{kept}')"
    out = f"regexp_replace({out}, '(?m){COPYRIGHT_LINE}[^\\n]*$', '', 'g')"
    return f"trim(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g'))"


_VALUES = ", ".join(f"('{i}', '{t}')" for i, t in NOTICES)
SCAN_SQL = f"""WITH known AS (
  SELECT sha256({_canonical_sql('text')}) AS digest, min(id) AS license_id FROM (VALUES {_VALUES}) AS n(id, text) GROUP BY 1),
docs AS (SELECT doc_id, text, sha256({_canonical_sql('text')}) AS text_sha256 FROM documents),
lines AS (SELECT doc_id, text_sha256, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
named AS (
  SELECT doc_id, text_sha256, list_sort(list(DISTINCT license_id)) AS found
  FROM (SELECT doc_id, text_sha256, sha256({_canonical_sql('line')}) AS digest FROM lines WHERE line <> '') JOIN known USING (digest)
  GROUP BY ALL)
SELECT d.doc_id, d.text_sha256, k.license_id, coalesce(array_to_string(found, ','), '') AS notice_ids,
  CAST(coalesce(len(found), 0) AS BIGINT) AS n_notices
FROM docs d LEFT JOIN known k ON k.digest = d.text_sha256
LEFT JOIN named n ON n.doc_id IS NOT DISTINCT FROM d.doc_id AND n.text_sha256 = d.text_sha256"""
