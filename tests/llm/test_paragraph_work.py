"""What op9 does only once, or in a cheaper way with the same links."""
import random

import pytest

from innkeep.llm import paragraphs as P
from innkeep.llm.common import Tables


def test_passages_are_made_once(spark, monkeypatch):
    run = " ".join(f"w{i}" for i in range(60))
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(1, f"{one} {run}"), (2, f"{run} {two}"), (3, None), (4, "")], "doc_id long, text string")
    made = []
    passages = P.passages
    monkeypatch.setattr(P, "passages", lambda d: made.append(1) or passages(d))
    tables = Tables(spark, "paragraphs")
    found = tables.keep(P.shared_lines(docs, tables))
    rows = P.repeated_passages(docs, found, tables).collect()
    assert len(made) == 1
    assert rows and {(r["doc_id"], r["first_doc"]) for r in rows} == {(2, 1)}


def joined(component, links):
    root = list(component)
    for a, b in links:
        assert root[a] != root[b]
        root = [root[b] if r == root[a] else r for r in root]
    return {frozenset(i for i, r in enumerate(root) if r == x) for x in root}


@pytest.mark.parametrize("halves", [False, True])
def test_small_buckets_are_compared_set_by_set(monkeypatch, halves):
    rng = random.Random(5)
    cases = []
    for n in (1, 2, 3, 7, P.FEW):
        base = [[rng.choice("abcdefgh").encode() * 3 for _ in range(30)] for _ in range(3)]
        words = []
        for i in range(n):
            w = list(base[i % 3])
            for _ in range(rng.randrange(3)):
                w[rng.randrange(30)] = b"x%d" % rng.randrange(9)
            words.append(b" ".join(w))
        component = [rng.randrange(n) for _ in range(n)]
        cases.append((list(range(n)), component, words, 0.8, [i % 2 == 1 for i in range(n)] if halves else None))
    with monkeypatch.context() as m:
        m.setattr(P, "FEW", 0)
        want = [joined(c[1], P.similar_pairs(*c)) for c in cases]

    def numbered(words):
        raise AssertionError("shingles of a small bucket were numbered")
    monkeypatch.setattr(P, "_shingle_numbers", numbered)
    assert [joined(c[1], P.similar_pairs(*c)) for c in cases] == want
    assert any(len(x) < len(set(c[1])) for x, c in zip(want, cases))
