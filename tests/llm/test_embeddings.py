import numpy as np

from innkeep.llm import embeddings as E


def brute(rows):
    good = [(i, np.asarray(v, np.float64)) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in good]
    comp = {i: i for i, _ in rows}
    links = {i: 0 for i, _ in rows}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = sorted((root(ids[a]), root(ids[b])))
                comp[q] = p
    return {i: (links[i], root(i)) for i, _ in rows}


def make(n=700, dim=64):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(60)] if i % 3 else rng.standard_normal(dim)
        v = v / np.linalg.norm(v) + rng.standard_normal(dim) * rng.choice([0, 0.02, 0.03, 0.05])
        rows.append((i * 2 + 1, [float(x) for x in v.astype(np.float32)]))
    return rows + [(2, None), (4, [0.0] * dim), (6, [float("nan")] + [1.0] * (dim - 1)), (8, []),
                   (10, [None] + [1.0] * (dim - 1)), (12, [1.0, 2.0]), (14, [2.0, 4.0]), (16, [float("inf")] * dim),
                   (18, [0.0] * dim)]


def test_links_match_brute_force(spark):
    rows = make()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, nid long, copies int")
    want = brute(rows)
    for block in (40, 512):
        got = {r.vec_id: r for r in E.components(df, block=block).collect()}
        assert len(got) == len(rows)
        total = sum(n for n, _ in want.values())
        assert all(got[i].n_links <= n for i, (n, _) in want.items())
        assert sum(r.n_links for r in got.values()) >= 0.999 * total
        assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.995 * len(want)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_recall_at_exactly_the_limit():
    """Worst case: pairs at cosine 0.95, the code sized for 50,000 vectors."""
    rng = np.random.default_rng(5)
    n, dim = 1000, 64
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((n, dim))
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95 ** 2) * z
    words, alpha = E.code_size(50_000)
    found = np.zeros(n, bool)
    for i in range(E.CODES):
        cap = E.Caps(dim, words, alpha, E.BLOCKS, E.SEED + i)
        a, b = (set(zip(*(v.tolist() for v in cap.decode(u)))) for u in (x, y))
        found[[r for r, _ in a & b]] = True
    assert found.mean() >= 0.99


def test_empty_table(spark):
    assert E.components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_parallel_vectors_of_extreme_norms_link(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e-200, 0.0]), (3, [1e200, 0.0]), (4, [0.0, 1e-300]), (5, [0.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.components(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}
