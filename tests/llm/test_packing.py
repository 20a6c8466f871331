import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from innkeep.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "  \n", "Hello, World!  don't <|startoftext|> stop<|endoftext|>now", "é É İ Σς ǅ é a b",
         "w" * 5000, "ÀÉÖ×÷ßÿ don'T it'S ''s 'll'd a'rex x1y22 ñ.ñ,Ñ! <|x|> ~}| e\u0301a o'\u0308 'ſ K", "\x1c x y ́z", "The cat's 1234 ... !!! ñandú " * 1500, "same text", "same text"]


def brute_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_are_the_tokenizer_s_ids(spark):
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece int")
    got = {}
    for r in P.pieces(df, PATH, 512).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = brute_ids(t)
        want = [(k // 512, k, len(ids[k:k + 512]), zlib.crc32(np.array(ids[k:k + 512], "<u4").tobytes()))
                for k in range(0, len(ids), 512)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[i]) == want


def _check(rows, capacity):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return seqs


def test_packing_is_gapless_and_near_the_bound(spark):
    rng = np.random.default_rng(0)
    lengths = [int(x) for x in rng.integers(1, 1500, 3000)] + [4096] * 5
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = P.pack(df, shard_rows=1000).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    seqs = _check(rows, 4096)
    assert len(seqs) <= sum(lengths) / 4096 * 1.01 + 4


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 500)
    seq, offset = P.best_fit(lengths, 100, 3, 12000, rule=rule)
    for s in set(seq):
        own = lengths[seq == s]
        assert own.sum() <= 100 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 12000


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack_documents(df, PATH).count() == 0


def test_rows_are_dealt_evenly(spark):
    for rows, parts, shards in ((4000, 200, 128), (4000, 3, 64), (4000, 200, 50)):
        dealt = spark.range(0, rows, 1, parts).groupBy(P.shard(shards).alias("s")).count().collect()
        assert len(dealt) == shards and max(r["count"] for r in dealt) < 2.5 * rows / shards
