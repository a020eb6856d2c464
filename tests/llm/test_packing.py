import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pairloom.llm.packing import LevelPacker, pack_tracks, public_byte_bpe

SCHEMA = "track_id long, lyrics string, length string"
TEXTS = ["", None, "one two  three", "la " * 5000, "x", "<|endoftext|> a\n\n b  c \t", "é" * 3000, "same", "same", " \n", "it's 12,5"]


def test_pieces_rebuild_all_ids(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, t, "z") for i, t in enumerate(TEXTS * 30)]
    out = pack_tracks(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    by_track, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_track[r.track_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for track, text, _ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_track[track], key=lambda r: r.start):
            assert r.start == at and r.track_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0


def test_level_rule_is_least_squares():
    rnd = np.random.default_rng(3)
    packer = LevelPacker(0, 16)
    for k in range(400):
        size = int(rnd.integers(1, 16))
        before = packer.counts.copy()
        packer.add(k, np.zeros(size, np.uint32))
        options = []
        for level in range(16 - size + 1):
            if level == 0 or before[level]:
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 16
                options.append(int((after[:16] ** 2).sum()))
        assert int((packer.counts[:16] ** 2).sum()) == min(options)
        assert packer.held == sum(h * n for h, n in enumerate(packer.counts.tolist()))


def test_small_bound_loses_nothing(spark):
    rows = [(i, "a b c d e " * (i % 40), None) for i in range(200)]
    out = pack_tracks(spark.createDataFrame(rows, SCHEMA), length=64, open_tokens=100).collect()
    encode = public_byte_bpe()
    assert sum(r.length for r in out) == sum(len(encode(t)) + 1 for _, t, _ in rows)


def test_empty_table(spark):
    assert pack_tracks(spark.createDataFrame([], SCHEMA)).count() == 0
