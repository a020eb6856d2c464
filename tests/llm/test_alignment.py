import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from pairloom.llm.alignment import aligned, linked_tokens, token_alignments
from pairloom.llm.queries import op11_token_alignment

SCHEMA = "track_id long, lyrics string, groups string, block long"


def pieces_of(text, hf, sp):
    """(id, bytes) of both tokenizers by their own libraries; no tokens where bytes change."""
    from_char = {}
    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for k, c in enumerate([*codes, *(x for x in range(256) if x not in codes)]):
        from_char[chr(c) if k < len(codes) else chr(256 + k - len(codes))] = c
    if not text:
        return [], []
    ids = hf.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(from_char[c] for c in hf.id_to_token(i))) for i in ids]
    b = [(i, bytes([int(p[3:5], 16)]) if len(p := sp.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i in sp.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def brute(rows):
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found, counts = [], Counter()
    for track, text in rows:
        a, b = pieces_of(text, hf, sp)
        ea, eb = (np.cumsum([0, *(len(x) for _, x in side)]) for side in (a, b))
        ends = np.union1d(ea[1:], eb[1:])  # every byte range between ends is one link
        links = [(a[i][0], b[j][0]) for i, j in zip(np.searchsorted(ea, ends) - 1, np.searchsorted(eb, ends) - 1)]
        counts.update(links)
        groups, i, j = [], 0, 0
        for end in np.intersect1d(ea[1:], eb[1:]):
            p, q = int(np.searchsorted(ea, end)), int(np.searchsorted(eb, end))
            groups.append(",".join(str(x) for x, _ in a[i:p]) + "|" + ",".join(str(x) for x, _ in b[j:q]))
            i, j = p, q
        found.append((track, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted((t or 0, n_a, n_b, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), ";".join(g)) for t, n_a, n_b, g, ls in found)


ODD = ["", "a", " ", "  two  spaces ", "\n\t x\r\n", "<|endoftext|> and </s> <unk> <0x41>", "▁already", "naïve café – “quoted” 你好 👩‍👩‍👧 ﬁ Å", "la " * 20000, "0123456789" * 30, "\x00nul", "é", "ＡＢ", "﻿bom"]


def test_same_as_brute_force_with_odd_texts(spark):
    rnd = random.Random(4)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "words without id"), (900, None), (7, ODD[7]), (7, ODD[7])]
    rows += [(1000 + k, " ".join("".join(rnd.choice("abcdeé ñ,.’") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 60)))) for k in range(60)]
    frame = spark.createDataFrame([(t, x, "g", 1) for t, x in rows], SCHEMA).repartition(3)
    want = brute(rows)
    for block in (4 << 20, 300):
        got = token_alignments(frame, block_bytes=block).collect()
        assert sorted((r.track_id or 0, *r[1:]) for r in got) == want
    assert token_alignments(frame.limit(0)).count() == 0


def test_runs_are_skipped_whole():
    rnd = random.Random(1)
    for _ in range(300):
        ends = sorted(rnd.sample(range(1, 400), rnd.randint(1, 120)))
        a, b = ([e for e in ends if rnd.random() < keep] for keep in (rnd.choice([1, 0.95, 0.5]), rnd.choice([1, 0.9])))
        a, b = sorted({*a, ends[-1]}), sorted({*b, ends[-1]})
        upto_a, upto_b = aligned(a, b)
        link_a, link_b = linked_tokens(np.array(a), np.array(b))
        both = sorted(set(a) & set(b))
        assert [a[i - 1] for i in upto_a] == [b[j - 1] for j in upto_b] == both
        union = sorted(set(a) | set(b))
        assert list(zip(link_a, link_b)) == [(np.searchsorted(a, e), np.searchsorted(b, e)) for e in union]
    assert aligned([], []) == ([], []) and len(linked_tokens(np.empty(0), np.empty(0))[0]) == 0


def test_whole_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    got = sorted(tuple(r) for r in op11_token_alignment(spark, sf).collect())
    assert got == [(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want]
