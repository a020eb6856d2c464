from pyspark.sql import functions as F

from pairloom.llm.urls import link_verdicts

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SCHEMA = "track_id long, url string, verdict string"


def test_rules(spark):
    urls = {
        1: "http://a.example.org/es/1", 2: "HTTP://A.Example.ORG/en/15?x=/fr/", 3: "https://b.org/x", 4: "https://b.org", 5: "https://z.com/de/1#a",
        6: None, 7: "no link", 8: "x://example.com/fr/?q", 9: "http://notorg/es/", 10: "a://b://c.org/", 11: "http://example.org?x/", 12: "http://h.net/" + "a/" * 40000,
    }
    links = spark.createDataFrame([(i, u, "old") for i, u in urls.items()] + [(None, urls[1], ""), (1, urls[1], "")], SCHEMA)
    none = spark.createDataFrame([], "url string, blocked int")
    got = {r.track_id: tuple(r)[1:] for r in link_verdicts(links, none, RULES).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") == got[None]
    assert got[2] == ("a.example.org", "/en/15", "example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4] == ("b.org", "", None, "allow")
    assert got[5] == ("z.com", "/de/1", "com/de/", "block") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("example.com", "/fr/", "com/fr/", "allow") and got[9][2] is None
    assert got[10][0] == "b:" and got[11] == ("example.org", "", None, "allow") and got[12][3] == "allow"


def test_trees_learn_from_labels(spark):
    n = spark.range(600).select(F.col("id").alias("track_id"))
    bad = F.concat(F.lit("http://cheap-"), F.col("track_id"), F.lit("-win.biz/"), F.col("track_id") * 7919, F.lit("?a=1&b=2&c="), "track_id")
    good = F.concat(F.lit("https://music.net/song/"), F.translate(F.col("track_id").cast("string"), "0123456789", "abcdefghij"))
    links = n.withColumn("url", F.when(F.col("track_id") % 3 == 0, bad).otherwise(good))
    labelled = links.where("track_id < 300").select("url", (F.col("track_id") % 3 == 0).cast("int").alias("blocked"))
    got = link_verdicts(links, labelled).collect()
    assert len(got) == 600 and sum((r.verdict == "block") == (r.track_id % 3 == 0) for r in got) >= 590
    assert link_verdicts(links.limit(0), labelled.where("blocked = 1")).count() == 0
    assert link_verdicts(links.limit(2), labelled.where("blocked = 1")).first().verdict == "block"
