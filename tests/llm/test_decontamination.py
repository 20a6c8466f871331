import random

from innkeep.llm import decontamination as D


def sellers(pattern, text):
    """Least edit distance of the pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        before, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != t))
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[k] = rng.choice("abcxyz")
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, rng.choice("abcxyz"))
    return "".join(out)


def test_matches_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(8, 30))))
             for i in range(12)]
    items += [(90, None), (91, ""), (92, "  "), (93, "short"), (94, items[0][1]), (95, items[1][1].upper())]
    docs = []
    for d in range(50):
        item = rng.choice(items[:12])[1]
        filler = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(0, 30)))
        docs.append((d, filler + "\n" + edited(rng, item, rng.randint(0, len(item) // 8)) + "  " + filler))
    docs += [(100, None), (101, ""), (102, "SHORT"), (103, "a short one"), (104, items[2][1] * 40), (104, items[2][1] * 40)]
    df = spark.createDataFrame([(d, t, 7, 0) for d, t in docs], "doc_id long, text string, item_id int, distance int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for block in (300, D.BLOCK_CHARS):
        got = sorted((r.doc_id, r.item_id, r.distance) for r in D.find(df, bench, block_chars=block).collect())
        want = []
        for d, t in docs:
            norm = D.normalise(t)
            for i, p in items:
                p = D.normalise(p)
                if len(p) >= D.MIN_CHARS:
                    k = sellers(p, norm)
                    if k <= int(D.RATE * len(p)):
                        want.append((d, i, k))
                elif p and p == norm:
                    want.append((d, i, 0))
        assert got == sorted(want)
    kept = {r.doc_id for r in D.keep_clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _, _ in got}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row = row, [i]
        for j, t in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != t)))
    return row[-1]


def test_occurrences_cover_every_place():
    """Against all substrings: those listed are apart and right, and each other one overlaps one."""
    rng = random.Random(8)
    for turn in range(120):
        pattern = "".join(rng.choice("ab" if turn % 2 else "abcd") for _ in range(rng.randint(4, 9)))
        most = rng.randint(0, 2)
        text = "".join(rng.choice([pattern, edited(rng, pattern, 1), rng.choice("abcd") * rng.randint(0, 9)])
                       for _ in range(rng.randint(0, 6)))
        got = D.occurrences(pattern, text, most, 0, len(text))
        assert all(distance(pattern, text[s:e]) == d <= most for d, s, e in got)
        assert all(e <= s for (_, _, e), (_, s, _) in zip(got, got[1:]))
        for s in range(len(text)):
            for e in range(s + 1, min(len(text), s + len(pattern) + most) + 1):
                if distance(pattern, text[s:e]) <= most:
                    assert any(s < end and start < e for _, start, end in got)


def test_every_occurrence_and_short_items(spark):
    item = "which river flows through the old town of the capital"
    docs = [(1, f"X {item.upper()}. {item} or\n{item.replace('river', 'rivr')}"), (2, "xx Short item  here yy, short item here"),
            (3, "unshort item here"), (4, "short item hereby"), (5, "short item here"), (6, None), (7, "42."), (8, "a b 142")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "short item here"), (3, "42")], "item_id long, text string")

    def found(**options):
        return {(r.doc_id, r.item_id): [tuple(o) for o in r.occurrences] for r in D.find(df, bench, **options).collect()}
    first = D.normalise(docs[0][1])
    n = len(item)
    third = first.index("which rivr")
    long = {(1, 1): [(0, 2, 2 + n), (0, 4 + n, 4 + 2 * n), (1, third, third + n - 1)]}
    assert found() == {**long, (5, 2): [(0, 0, 15)]}
    assert found(short_words=True) == {**long, (2, 2): [(0, 3, 18), (0, 23, 38)], (5, 2): [(0, 0, 15)], (7, 3): [(0, 0, 2)]}
    assert {r.doc_id for r in D.keep_clean(df, bench).collect()} == {2, 3, 4, 6, 7, 8}


def test_more_blocks_than_matchers(spark):
    rng = random.Random(5)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6))) for i in range(9)]
    docs = [(i, f"x {t} y") for i, t in items] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in D.find(df, bench, block_chars=1).collect())
    assert got == sorted((i, i) for i, _ in docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert D.find(docs, bench).count() == 0
    assert D.find(some, bench).count() == 0
    assert D.keep_clean(some, bench).count() == 1
