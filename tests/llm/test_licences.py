from pairloom.llm.licences import licence_scan, notices

SCHEMA = "track_id long, lyrics string, licence_id string"


def test_whole_texts_and_lines(spark):
    rows = [
        (1, "RELEASED under the MIT licence", "x"),
        (2, "Copyright (c) 2020 Somebody\n\n* Released under the M.I.T License", "x"),
        (3, "(c) me\n Released  under\tthe MIT License!!", "x"),
        (4, "la la\nLicensed under CC BY-NC 4.0.\nreleased under the MIT License\nla", "x"),
        (5, None, "x"), (6, "", "x"), (None, "Released under the MIT License.", "x"),
        (7, "x\nLicensed under CC BY-NC 4.0.", "x"), (7, "x\nLicensed under CC BY-NC 4.0.", "x"), (8, "la " * 50000, "x"),
    ]
    got = licence_scan(spark.createDataFrame(rows, SCHEMA), notices(spark)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.track_id, []).append((r.licence_id, r.notice_ids, r.n_notices))
    assert by[1] == [("MIT", "MIT", 1)] and by[None] == [("MIT", "MIT", 1)]
    assert by[2] == [(None, "", 0)] and by[3][0][0] == "MIT"
    assert by[4] == [(None, "CC-BY-NC-4.0,MIT", 2)] and by[5] == by[6] == by[8] == [(None, "", 0)]
    assert by[7] == [(None, "CC-BY-NC-4.0", 1)] * 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert licence_scan(none, notices(spark)).count() == 0
    some = spark.createDataFrame([(1, "a", None)], SCHEMA)
    assert licence_scan(some, notices(spark).limit(0)).collect()[0].licence_id is None
