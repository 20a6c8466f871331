"""Cross-tokenizer alignment against a plain loop over all token pairs."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from innkeep.llm import alignment
from innkeep.llm.queries import op12_alignment
from tokenizers import Tokenizer

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = ["", None, "Hello world, this is  two spaces \n and lines.", "naïve café — 東京 😀", "a▁b is not given back",
         "<|endoftext|> and </s> are plain text", " leading", "trailing ", "   ", "\t\n", "the the the the",
         "x" * 3000, "Ein längerer Satz, der mehrfach vorkommt. " * 200, "the the the the"]


@pytest.fixture(scope="module")
def plain():
    """(A's ids, their bytes, B's ids, their bytes) of a text, by the two libraries alone."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    as_byte = alignment.byte_characters()

    def one(text):
        if not text:
            return [], [], [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xb = [bytes(as_byte[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()
              for p in map(b.id_to_piece, y)]
        whole = (" " + text).encode()
        return (x, xb, y, yb) if b"".join(xb) == whole == b"".join(yb) else ([], [], [], [])
    return one


def brute(docs, plain):
    """The query's rows without merge_asof, numpy or Spark."""
    out, links = [], []
    for doc, text in docs:
        x, xb, y, yb = plain(text)
        ax, by, at = [], [], 0
        for t in xb:
            ax.append((at, at + len(t)))
            at += len(t)
        at = 0
        for t in yb:
            by.append((at, at + len(t)))
            at += len(t)
        links.append([(x[i], y[j]) for i, (p, q) in enumerate(ax) for j, (r, s) in enumerate(by) if p < s and r < q])
        cuts = [0, *sorted({q for _, q in ax} & {s for _, s in by})]
        groups = [",".join(str(x[i]) for i, (p, q) in enumerate(ax) if lo <= p < hi) + "|"
                  + ",".join(str(y[j]) for j, (r, s) in enumerate(by) if lo <= r < hi) for lo, hi in zip(cuts, cuts[1:])]
        out.append((doc, len(x), len(y), len(groups), groups))
    count = Counter(p for some in links for p in some)
    best = {}
    for (i, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(doc, na, nb, ng, len(some), sum(count[p] == best[p[1]] for p in some), sum(count[p] for p in some),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "")
            for (doc, na, nb, ng, groups), some in zip(out, links)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("frequent", [500_000, 5, 0])
def test_against_brute_force(spark, plain, frequent):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id text"), (3, "the same id again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS a", "'x' AS key", "0 AS n")
    got = alignment.count_links(df, A, B, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got) == sorted(brute(docs, plain), key=str)


def test_slices_change_nothing(spark, plain):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    small, large = (rows(alignment.align(df, A, B, slice_bytes=n)) for n in (1, 1 << 20))
    assert small == large


def test_empty_table(spark):
    assert rows(alignment.count_links(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_libraries(plain, text):
    (x, y), = alignment._pair(A, B).ids([text])
    px, _, py, _ = plain(text)
    assert (x.tolist(), y.tolist()) == (px, py)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.randoms(use_true_random=False)), max_size=5))
def test_overlaps_are_all_and_once(docs):
    """Random cuts of the same bytes on both sides."""
    a_doc, a_start, b_doc, b_start, want, base = [], [], [], [], [], 0
    spans_a, spans_b = [], []
    for d, (lengths, rnd) in enumerate(docs):
        total = sum(lengths)
        other = [0, *sorted(rnd.sample(range(1, total), rnd.randint(0, total - 1))), total] if total > 1 else [0, total]
        mine = np.concatenate([[0], np.cumsum(lengths)])
        spans_a += [(d, base + p, base + q) for p, q in zip(mine, mine[1:])]
        spans_b += [(d, base + p, base + q) for p, q in zip(other, other[1:])]
        base += total
    if not spans_a:
        return
    at_a, at_b, _, _ = alignment.overlaps(*(np.array([s[k] for s in side], np.int64) for side in (spans_a, spans_b) for k in (0, 1)))
    want = [(i, j) for i, p in enumerate(spans_a) for j, q in enumerate(spans_b) if p[1] < q[2] and q[1] < p[2]]
    assert sorted(zip(at_a.tolist(), at_b.tolist())) == want


def test_query_covers_the_table(spark, plain):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    short = {d for d, t in docs if len(t or "") < 600}
    got = {r.doc_id: r for r in op12_alignment(spark, folder).collect()}
    assert len(got) == len(docs)
    for doc, na, nb, ng, _, _, _, digest in brute([(d, t) for d, t in docs if d in short], plain):
        assert (na, nb, ng, digest) == (got[doc].n_a, got[doc].n_b, got[doc].n_groups, got[doc].groups_sha256)
