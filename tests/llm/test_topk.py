"""Exact top-k search against all inner products in Python's integers."""

import math

import numpy as np
import pytest
from innkeep.llm import topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr(
        "*", "1 AS rid", "2 AS rank", "3 AS score", "'x' AS query", "0 AS g")


def brute(rows, k=10, is_query=lambda i: i % 100 == 0):
    good = [(n, i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) for x in v]) for n, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i is None or not is_query(i):
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0, m) for m, j, v in good
                       if m != n and len(v) == len(q))[:k]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(found)]
    return sorted(out, key=str)


def got(df, **options):
    found = topk.top_k(df, F.col("vec_id") % 100 == 0, **options)
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()), key=str)


def clustered(n, dim, seed, ids=None):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    x = centres[rng.integers(0, 8, n)] + 0.1 * rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(int(i), v.tolist()) for i, v in zip(range(n) if ids is None else ids, x)]


@pytest.mark.parametrize("options", [{}, dict(cells=4, groups=3, per_group=1, block=2, chunk=100),
                                     dict(cells=64, groups=50, per_group=1, chunk=50), dict(k=3, chunk=7)])
def test_clustered_vectors(spark, options):
    rows = clustered(1200, 8, 1)
    assert got(frame(spark, rows), **options) == brute(rows, options.get("k", 10))


def test_pruning_takes_effect_and_keeps_all_results(spark):
    """Tight clusters: most vectors are sent to few groups."""
    rows = [(i, [200 * math.cos(a) + 0.01 * (i % 7), 200 * math.sin(a)]) for i in range(2000) for a in [2 * math.pi * (i % 20) / 20]]
    df = topk.prepare(frame(spark, rows), F.col("vec_id") % 100 == 0, "vec_id", "embedding", 1024).cache()
    plan = topk._plan(df, 2, 2000, 20, 1e6, 10, 64, 20, 1)
    x = topk._matrix(df.select("v").toPandas()["v"], 2)
    row, _ = plan.groups_of(x)
    assert len(row) < 0.5 * len(x) * len(plan.query_pivots)
    assert got(frame(spark, rows), groups=20, per_group=1) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, None), (200, [nan, 1.0]), (300, [1.0, None]), (400, []), (5, []),
            (500, [0.5]), (7, [2.0, 2.0]), (None, [2.0, 2.0]), (None, [2.0, 2.0]), (8, [inf, 0.0]), (9, [-1.0, -2.0]),
            (600, [0.0, 0.0]), (10, [1e-9, -1e-9]), (-100, [3.0, -1.0])]
    assert got(frame(spark, rows)) == brute(rows)


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert got(frame(spark, rows)) == [(0, 1, 1, 1024 * 2048)]
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(1, [1.0])])) == []


def test_hot_vector_and_ties(spark):
    """A third of the rows, queries among them, are one vector; ties go to the smaller id."""
    rows = clustered(400, 4, 2) + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)] + [
        (100 * i, [0.5, 0.5, 0.5, 0.5]) for i in range(20, 30)]
    assert got(frame(spark, rows), block=3, chunk=64, per_group=2) == brute(rows)


def test_scores_outside_doubles_are_exact(spark):
    """Components near 2**43 after scaling: doubles would round, ties would break."""
    rows = [(i, [float(2 ** 20 + i), float(2 ** 20 - 3 * i), 1.0]) for i in range(60)]
    rows += [(100, [float(2 ** 20 + 1), float(2 ** 20), 1.0])]
    assert got(frame(spark, rows)) == brute(rows)


def test_scores_outside_longs(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])]
    assert got(frame(spark, rows)) == [(0, 1, 1, 2 ** 63 - 1), (0, 2, 3, 1024 * 1024), (0, 3, 2, -2 ** 63)]


def test_random_small_tables(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 11, 12, 150):
        rows = [(int(i), np.round(rng.standard_normal(3), 1).tolist()) for i in rng.integers(-3, 6, n) * 50]
        found = topk.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, cells=5, groups=3, per_group=2, block=2, chunk=9)
        mine = sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()), key=str)
        assert mine == brute(rows)
