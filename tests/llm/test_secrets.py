import hashlib
import random

from pairloom.llm.secrets import announced_labels, redacted, secret_candidates, secret_findings

SCHEMA = "track_id long, lyrics string, path string, token string"


def table(spark):
    rnd = random.Random(6)
    secret = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = []
    for i in range(120):
        text = "moonlight over the water " * (i % 5) + f"ñ word supercalifragilisticexpialidocious {i}@mail.example.com "
        if i % 3 == 0:
            text += f'token = "{secret()}" and more'
        if i % 3 == 1:
            text += "a lovely-evening-by-the-riverside again"
        rows.append((i, text, f"songs/src{i}.txt", "clash"))
    leak = secret()
    rows += [(500, f"see {leak} here", "conf/app.env", ""), (501, None, None, None), (502, "", "", ""), (None, f'token = "{leak}"', "a", ""), (3, rows[3][1], "x", ""), (503, "la " * 60000 + f'token = "{leak}"', "b", "")]
    return spark.createDataFrame(rows, SCHEMA), rows, leak


def test_findings_and_redaction(spark):
    tracks, rows, leak = table(spark)
    found = secret_candidates(tracks)
    got = secret_findings(found, announced_labels(found)).collect()
    assert len(got) == found.count()
    for r in got:
        assert hashlib.sha256(r.token.encode()).hexdigest() == r.token_sha256
    secrets = {(r.track_id, r.token) for r in got if r.is_secret}
    assert {t for _, t in secrets} == {x.split('token = "')[1].split('"')[0] for _, x, _, _ in rows if x and "token" in x}
    assert {500, 503, None} <= {t for t, _ in secrets}
    clean = redacted(tracks, secret_findings(found, announced_labels(found))).collect()
    assert len(clean) == len(rows) and all(leak not in (r.lyrics or "") for r in clean)
    by = {(r.track_id, r.path): r.lyrics for r in clean}
    assert by[500, "conf/app.env"] == "see [redacted] here" and by[501, None] is None and by[1, "songs/src1.txt"] == rows[1][1]
    assert by[3, "x"] == by[3, "songs/src3.txt"] and "[redacted]" in by[3, "x"]


def test_few_labels_and_empty(spark):
    tracks, _, _ = table(spark)
    found = secret_candidates(tracks)
    none = announced_labels(found).limit(0)
    assert {r.is_secret for r in secret_findings(found, none).collect()} == {1}
    clean = announced_labels(found).where("secret = 0")
    assert {r.is_secret for r in secret_findings(found, clean).collect()} == {0}
    empty = secret_candidates(tracks.limit(0))
    assert secret_findings(empty, announced_labels(empty)).count() == 0
    assert redacted(tracks, secret_findings(empty, none)).count() == tracks.count()
