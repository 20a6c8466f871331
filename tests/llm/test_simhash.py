import numpy as np
import xxhash

from innkeep.llm import simhash as S
from innkeep.llm.common import connected_components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def brute_components(fps):
    comp = {i: i for i in fps}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: root(i) for i in ids}


def test_edge_texts(spark):
    rows = [(5, None), (3, ""), (4, " \t\n"), (9, "A b C"), (2, "a B c"), (7, "one"), (8, "é É"),
            (11, "w%d " * 1 % 1 * 1), (12, " ".join(f"w{i}" for i in range(20000)))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, node long")
    got = {r.doc_id: r for r in S.components(df).collect()}
    for i, t in rows:
        assert got[i].fingerprint == f"{brute_fp(t):016x}"
    want = brute_components({i: brute_fp(t) for i, t in rows})
    assert {i: r.component_id for i, r in got.items()} == want


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.components(df).count() == 0
    assert S.keep_one(df).count() == 0
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert S.components(df).count() == 3
    assert [tuple(r) for r in S.keep_one(df).collect()] == [(1, "a b c d")]


def test_links_match_brute_force_in_deep_and_shallow_trees(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 12, dtype=np.uint64)]
    fps = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    want = brute_components(dict(enumerate(fps)))
    for limit in (12, 2048):
        comp = connected_components(S.links(df, limit=limit))
        got = {r.node & (2**64 - 1): r.component for r in comp.collect()}
        groups, expect = {}, {}
        for i, x in enumerate(fps):
            groups.setdefault(got.get(x, ("alone", x)), set()).add(x)
            expect.setdefault(want[i], set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_chain_budget_holds_for_every_pattern_of_three_bits():
    masks = S.ring_masks()
    rng = np.random.default_rng(2)
    for _ in range(3000):
        bits = sum(1 << int(b) for b in set(rng.integers(0, 64, 3)))
        assert any(not bits & m for m in masks)


def test_keep_one_with_null_and_repeated_ids(spark):
    far = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, far[0], "p"),                                        # alone, without an id
            (None, far[1], "q"), (None, far[1].upper(), "r"),           # a group without ids
            (5, far[2], "s"), (5, far[3], "t"), (5, far[3], "t"),       # two texts under one id
            (None, far[4], "u"), (9, far[4], "v"),                      # an id goes before none
            (2 ** 53 + 1, far[5], "w"), (None, None, "x"), (None, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
    got = sorted(((r.doc_id, r.text or "", r.key) for r in S.keep_one(df).collect()), key=str)
    want = [(None, far[0], "p"), (5, far[2], "s"), (5, far[3], "t"), (9, far[4], "v"), (2 ** 53 + 1, far[5], "w")]
    assert [r for r in got if r[2] not in "qrxy"] == sorted(want, key=str)
    assert len([r for r in got if r[2] in "qr"]) == 1 and len([r for r in got if r[2] in "xy"]) == 1
    again = sorted(((r.doc_id, r.text or "") for r in S.keep_one(df.repartition(2)).collect()), key=str)
    assert again == [r[:2] for r in got]


def test_keep_one_keeps_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d", "k1", 7), (2, "a b c d", "k2", 8), (3, None, "k3", 9)],
                               "doc_id long, text string, _key string, _none int")
    out = S.keep_one(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b c d", "k1", 7), (3, None, "k3", 9)]
