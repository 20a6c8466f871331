import hashlib
import random

import xxhash

from innkeep.llm import suffix as S


def brute(datas, width):
    seen = {}
    for d, x in enumerate(datas):
        for i in range(len(x) - width + 1):
            seen.setdefault(x[i:i + width], []).append((d, i))
    covered = [bytearray(len(x)) for x in datas]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                covered[d][i:i + width] = b"\1" * width
    return covered


def test_suffix_array_is_sorted_order():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice((1, 2, 3, 6))) for _ in range(rng.randint(0, 40))]
        s = s[:10] * rng.randint(1, 4) if rng.random() < 0.3 else s
        assert S.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_removed_bytes_match_brute_force(spark):
    rng = random.Random(2)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 700))) for _ in range(8)]
    rows = [(3, None), (4, ""), (5, "x" * 199), (6, "y" * 200), (7, "z" * 201), (8, "ab" * 400), (None, passages[0])]
    for i in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 20):] if rng.random() < 0.6 else
                 "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(0, 5))]
        rows.append((100 + i, "".join(parts)))
    rows += [(500, passages[1] * 3), (500, passages[1] * 3), (501, "".join(rng.choice("ab") for _ in range(60000)))]
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, at long, h string")
    datas = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), x, c in zip(rows, datas, brute(datas, 200)):
        kept = bytes(b for b, gone in zip(x, c) if not gone)
        spans = sum(1 for k in range(len(c)) if c[k] and not (k and c[k - 1]))
        want.append((i, len(x), sum(c), spans, hashlib.sha256(kept).hexdigest()))
    for limit in (1, S.LIMIT):
        got = [tuple(r) for r in S.deduplicate(df, limit=limit).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert S.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_under_one_id_are_told_apart_by_more_than_31_bits(spark):
    rng = random.Random(3)
    one, two = ("".join(rng.choice("abcd ") for _ in range(n)) for n in (260, 330))

    def short(text):
        return xxhash.xxh64_intdigest(text.encode(), 42) & 0x7FFFFFFF
    of_one = {short(f"{one}{i}"): f"{one}{i}" for i in range(200_000)}
    x, y = next((of_one[short(t)], t) for i in range(200_000) if short(t := f"{i}-{two}") in of_one)
    rows = [(None, x), (None, y), (1, one), (2, two), (3, x)]
    datas = [t.encode() for _, t in rows]
    want = [(i, len(d), sum(c), hashlib.sha256(bytes(b for b, gone in zip(d, c) if not gone)).hexdigest())
            for (i, _), d, c in zip(rows, datas, brute(datas, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1, S.LIMIT):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in S.deduplicate(df, limit=limit).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
