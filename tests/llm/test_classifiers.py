import zlib

import numpy as np
import pytest

from innkeep.llm import quality as Q
from innkeep.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def _tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_features_are_the_distinct_hashed_grams():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 3000):
        text = "".join(rng.choice(list("ab é!"), n))
        got = Q.features(text)
        assert len(got) == len(set(got.tolist()))
        data = text.encode()
        want = set()
        for k in Q.ORDERS:
            for i in range(len(data) - k + 1):
                h = 0
                for c in data[i:i + k]:
                    h = (h * 257 + c + 1) % 2 ** 32
                want.add((h * 2654435761 + k * 40503) % 2 ** 32 >> 32 - Q.BITS)
        words = data.split()
        repeats = sum(x == y for x, y in zip(words, words[1:]))
        want |= {(i * 7919 + 104729) % 2 ** Q.BITS for i in range(repeats.bit_length())}
        assert set(got.tolist()) == want


def test_quality_held_out_accuracy(spark):
    docs, labels = _tables(spark)
    model = Q.train(docs, labels)
    scored = Q.score_documents(docs, model).join(labels.select("doc_id", "quality"), "doc_id").collect()
    for r in scored:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    out = [r for r in scored if r.held_out]
    assert sum((r.score >= 0.5) == r.quality for r in out) >= 0.95 * len(out)
    assert sum(r.predicted for r in out if r.quality) >= 0.97 * sum(r.quality for r in out)


def test_scores_do_not_read_other_columns(spark):
    docs, labels = _tables(spark)
    model = Q.train(docs, labels)
    from pyspark.sql import functions as F
    other = docs.select((F.col("doc_id") + 10 ** 6).alias("doc_id"), "text", F.lit("zz").alias("lang"),
                        F.lit(0).alias("score"), F.lit(0).alias("predicted"))
    a = {r.doc_id: r.score for r in Q.score_documents(docs, model).collect()}
    b = {r.doc_id - 10 ** 6: r.score for r in Q.score_documents(other, model).collect()}
    assert a == b


@pytest.mark.parametrize("module", [Q, T])
def test_edge_cases(spark, module):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y"), (4, "w " * 30000)],
                                 "doc_id long, text string")
    column = "quality" if module is Q else "toxic"
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    one = spark.createDataFrame([(3, 1), (3, 1), (None, 0), (2, None)], f"doc_id long, {column} int")
    for labels in (none, one):
        rows = module.score_documents(docs, module.train(docs, labels)).collect()
        assert len(rows) == 6 and all(r.score == 0.5 for r in rows)
    assert module.score_documents(docs.limit(0), module.train(docs, none)).count() == 0


def test_windows_cover_everything():
    for n in range(0, 400):
        seen = set()
        for s in T.windows(n):
            seen |= set(range(s, min(n, s + T.WINDOW)))
        assert seen == set(range(n))


def test_gradients_match_differences():
    net = T.Network(["aa", "bb"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    docs = [["aa", "bb", "cc", "aa"], ["dd"], ["bb"] * 60]
    places = [(0, 0), (1, 0), (2, 0), (2, 12)]
    words, idx, mask = net.batch(docs, places)
    z, saved = net.forward(words[3], idx, mask.astype(np.float64), keep=True)
    weights = np.array([1.0, -0.5, 0.3, 0.7])
    grads = net.backward(weights, words, idx, mask.astype(np.float64), saved)
    rng = np.random.default_rng(0)
    for name in net.p:
        flat = np.argsort(-np.abs(grads[name]).ravel())[:4]
        for k in flat:
            where = np.unravel_index(k, net.p[name].shape)
            old, eps = net.p[name][where], 1e-4
            values = []
            for step in (eps, -eps):
                net.p[name][where] = old + step
                w, i, m = net.batch(docs, places)
                values.append(float(net.forward(w[3], i, m.astype(np.float64))[0] @ weights))
            net.p[name][where] = old
            got, want = grads[name][where], (values[0] - values[1]) / (2 * eps)
            assert abs(got - want) <= 2e-2 * abs(want) + 2e-4, (name, where)
    del rng


def test_toxicity_learns_planted_words(spark):
    rng = np.random.default_rng(3)
    syll = ["ta", "ri", "mo", "le", "sun", "ka"]

    def doc(toxic):
        n = int(rng.integers(5, 300))
        words = ["".join(rng.choice(syll, rng.integers(1, 4))) for _ in range(n)]
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(0, n)), rng.choice(["zorg", "zorgta", "zorgmo", "blick"]))
        return " ".join(words)
    y = rng.random(500) < 0.25
    texts = [doc(t) for t in y]
    net = T.fit(texts[:350], y[:350].astype(int), epochs=8)
    s = net.score(texts[350:])
    assert ((s >= 0.5) == y[350:]).mean() >= 0.95
    assert np.allclose(s[:5], [net.score([t])[0] for t in texts[350:355]], atol=1e-5)


def test_sample_is_bounded_where_texts_share_an_id(spark, monkeypatch):
    """Many texts under one labelled id: no more than ``max_rows`` rows reach the fit."""
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(60)] + [(4, "good"), (None, "no id")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    for module in (Q, T):
        monkeypatch.setattr(module, "fit", lambda rows, y, **kw: seen.append(len(rows)))
        module.train(docs, labels, folds=4, held_out=9, max_rows=7)
    assert seen == [7, 7]


def test_documents_without_an_id_are_in_no_fold(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, None)], "doc_id long, text string")
    for module, model in ((Q, Q.fit([], np.array([]))), (T, T.fit([], np.array([])))):
        got = {r.doc_id: (r.held_out, r.score) for r in module.score_documents(docs, model).collect()}
        assert got[None] == (False, 0.5) and got[3][1] == 0.5
