import random

from innkeep.llm import paragraphs as P


def brute(docs):
    rows = [(d, i, P.normal_words(x)) for d, t in docs for i, x in enumerate((t or "").split("\n"))]
    rows = sorted({(d, i, b" ".join(w)) for d, i, w in rows if len(w) >= 5})
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    sets = [P.shingles(r[2]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if len(sets[i] & sets[j]) >= 0.8 * u:
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    gone = {}
    for i, (d, p, _) in enumerate(rows):
        if root(i) != i:
            gone.setdefault(d, set()).add(p)
    return gone


def make(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(5, 120))] for _ in range(30)]
    docs = []
    for d in range(60):
        out = []
        for _ in range(rng.randint(1, 6)):
            p = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2))):
                p[rng.randrange(len(p))] = rng.choice(vocab)
            out.append(" ".join(p))
            out.append(rng.choice(("", "short line", "É x")))
        docs.append((d * 3, "\n".join(out)))
    return docs + [(1, None), (2, ""), (4, "a b c d e"), (5, "A  B c d E\nx"), (7, "w " * 20000), (8, "w " * 20000)]


def test_removed_lines_match_brute_force(spark):
    docs = make()
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, para int, words string")
    want = brute(docs)
    for block in (3, 256):
        got = {r.doc_id: r for r in P.report(df, block=block).collect()}
        assert len(got) == len(docs)
        found = {d: {int(x) for x in r.removed.split(",")} for d, r in got.items() if r.removed}
        missed = sum(len(v - found.get(d, set())) for d, v in want.items())
        assert all(v <= want.get(d, set()) for d, v in found.items())       # nothing wrong
        assert missed <= 0.01 * sum(map(len, want.values()))                # bands: recall by design 0.998


def test_prefix_filter_loses_no_link():
    rng = random.Random(5)
    for _ in range(150):
        base = [str(rng.randrange(30)) for _ in range(rng.randint(5, 60))]
        words = []
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = str(rng.randrange(30))
            words.append(" ".join(w).encode())
        got = P.similar_pairs(list(range(12)), list(range(12)), words, 0.8)
        sets = [P.shingles(w) for w in words]

        def groups(pairs):
            comp = list(range(12))
            for a, b in pairs:
                x, y = comp[a], comp[b]
                comp = [x if c == y else c for c in comp]
            return sorted(sorted(i for i in range(12) if comp[i] == c) for c in set(comp))
        want = [(i, j) for i in range(12) for j in range(i) if P.jaccard_at_least(sets[i], sets[j], 0.8)]
        assert all(P.jaccard_at_least(sets[a], sets[b], 0.8) for a, b in got)
        assert groups(got) == groups(want)


def test_remove_keeps_columns_and_short_lines(spark):
    df = spark.createDataFrame([(1, "a b c d e\nx", "p"), (2, "x\nA b c d e\ny", "q"), (3, None, "r")],
                               "doc_id long, text string, removed string")
    rows = {r.doc_id: (r.text, r.removed) for r in P.remove(df).collect()}
    assert rows == {1: ("a b c d e\nx", "p"), 2: ("x\ny", "q"), 3: (None, "r")}


def test_empty_table(spark):
    assert P.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passage_inside_longer_lines(spark):
    rng = random.Random(9)

    def prose(n):
        return [f"w{rng.randrange(500)}" for _ in range(n)]
    passage = prose(60)
    a, b, c = prose(70), prose(90), prose(80)
    wrapped = "\n".join(" ".join(passage[i:i + 4]) for i in range(0, 60, 4))       # lines too short to count
    docs = [(1, " ".join(a + passage + a[::-1])), (2, "x y\n" + " ".join(b + passage + b[::-1]).upper()),
            (3, " ".join(c) + "\n" + wrapped), (4, " ".join(prose(300))), (None, " ".join(c[::-1])), (2, "other text")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = P.report(df).collect()
    got = {r.doc_id: r for r in rows if r.n_passages or r.doc_id != 2}
    assert len(rows) == 6 and all(r.n_removed == 0 for r in rows)
    assert [got[i].n_passages for i in (1, 2, 3, 4, None)] == [0, 1, 1, 0, 0]
    for i, at in ((2, 92), (3, 80)):
        x, y = map(int, got[i].passages.split("-"))
        assert at <= x <= at + 15 and at + 45 <= y <= at + 60 and got[i].passage_words == y - x
        assert got[i].first_docs == [1]
    x, y = map(int, got[2].passages.split("-"))
    words = docs[1][1].split()
    texts = [r.text for r in P.remove(df).collect()]
    assert docs[0][1] in texts and "other text" in texts
    assert "x y\n" + " ".join(words[2:x] + words[y:]) in texts


def test_passage_in_a_removed_line_is_not_the_first(spark):
    rng = random.Random(10)
    line = [f"w{rng.randrange(500)}" for _ in range(150)]
    near = [*line[:20], "new", *line[21:]]                       # goes as a line: near copy of document 1
    passage = near[:60]
    docs = [(1, " ".join(line)), (2, " ".join(near)), (3, " ".join(["q"] * 3 + passage + [f"z{i}" for i in range(200)]))]
    got = {r.doc_id: r for r in P.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[2].removed == "0" and got[2].n_passages == 0
    assert got[3].first_docs == [1] and all(int(s.split("-")[0]) >= 24 for s in got[3].passages.split(",") if s)


def test_runs_are_taken_by_content_only():
    rng = random.Random(11)
    _, at, k1, _ = P.passage_runs([[b"w"] * 5000])
    assert len(set(k1)) == 1 and len(at) < 700 and max(b - a for a, b in zip(at, at[1:])) <= P.PASSAGE
    for n in (40, 41, 60):
        for _ in range(50):
            run = [b"%d" % rng.randrange(10 ** 6) for _ in range(n)]
            texts = [[b"%d" % rng.randrange(10 ** 6) for _ in range(rng.randrange(90))] for _ in range(4)]
            doc, at, k1, k2 = P.passage_runs([texts[0] + run + texts[1], [], texts[2] + run + texts[3]])
            both = {(a, b) for d, a, b in zip(doc, k1, k2) if d == 0} & {(a, b) for d, a, b in zip(doc, k1, k2) if d == 2}
            place = sorted(p - len(texts[0]) for d, p, a, b in zip(doc, at, k1, k2) if d == 0 and (a, b) in both)
            assert place and 0 <= place[0] <= 15 and n - 40 <= place[-1] <= n - 25
            assert all(y - x <= P.PASSAGE for x, y in zip(place, place[1:]))


def test_texts_under_one_id_or_none_keep_their_own_lines(spark):
    a, b = "a b c d e f", "one two three four five six"
    docs = [(1, f"{a}\n{b}", "p"), (5, f"{a}\nonly in the second text here", "q"),
            (5, f"also only here in this one\nx\n{b}", "r"), (None, f"{b}\nnull one has this line alone", "s"),
            (None, f"null two has this other line\n{a}", "t")]
    # names that the operator uses itself
    df = spark.createDataFrame([(*d, d[2], d[2], d[2], d[2]) for d in docs],
                               "doc_id long, text string, _id string, _gone string, row string, t1 string, removed string")
    got = sorted((r.doc_id is not None, r.removed) for r in P.report(df).collect())
    # a null id is the smallest, so the null rows hold the first of each group
    assert got == sorted([(True, "0,1"), (True, "0"), (True, "2"), (False, ""), (False, "")])
    rows = {r._id: r for r in P.remove(df).collect()}
    assert rows["p"].text == "" and rows["q"].text == "only in the second text here"
    assert rows["r"].text == "also only here in this one\nx"
    assert rows["s"].text == docs[3][1] and rows["t"].text == docs[4][1]
    assert all((r._gone, r.row, r.t1, r.removed) == (k,) * 4 for k, r in rows.items())


def test_documents_that_lose_nothing_name_no_other(spark):
    df = spark.createDataFrame([(1, "a b c d e\nx"), (2, "a b c d e"), (3, "clean text of its own here")],
                               "doc_id long, text string")
    assert {r.doc_id: r.first_docs for r in P.report(df).collect()} == {1: [], 2: [1], 3: []}
