import hashlib
import re

from innkeep.llm import pii as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [None, "", "x", "a@b.c@d.e", "a@b.c_x@d.e f..g@h-i.j.k.", "é a@é.de ü@x.org 😀 me@x.org", "1.2.3.4.5.6.7.8 999.1.1.1 0255.000.1.1",
         "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (0)30 123-456-78 +1 +12 3", "4111111111111111.4.4.4",
         "IBAN DE89 3704 0044 0532 0130 00, GB82 WEST 1234 5698 7654 32; DE88 3704 0044 0532 0130 00",
         'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" nothing 24be64439e3e49cf46b2d7c90f3602a3d0b907fe far',
         "a" * 60000, "1" * 60000, "a." * 30000 + "@x.de", "x@" + "a." * 30000 + "b", "+1" + " " * 60000, "me@x.org " * 3000]


def test_base_spans_match_plain_patterns(spark):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string, kind int")
    got = {r.doc_id: r for r in P.report(df).collect()}
    for i, t in enumerate(TEXTS):
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        for k in P.BASE:
            assert got[i][f"n_{k}"] == sum(s.startswith(k + ":") for s in want)
        assert set(want) <= set(got[i].spans.split(",")) | {""}
    assert got[10].spans.count("iban") == 2 and got[11].spans.count("secret") == 1


# fixed values: published examples of account numbers
IBANS = ["FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "NO93 8601 1117 947",
         "BR97 0036 0305 0000 1000 9795 493P 1", "KW81 CBKU 0000 0000 0000 1234 5601 01", "BE68 5390 0754 7034",
         "LC55 HEMM 0001 0001 0012 0012 0002 3015", "GB82 WEST 1234 5698 7654 32"]


def test_account_numbers_with_letters(spark):
    texts = [f"{a} {n}{b}" for n in IBANS for a, b in (("pay to", ""), ("é x", " OR CALL US 12"), ("(", ")"))]
    texts += [n.replace(" ", "") + "." for n in IBANS]
    wrong = [n[:-1] + ("1" if n[-1] != "1" else "2") for n in IBANS] + [n + "7" for n in IBANS] + ["x" + n for n in IBANS]
    wrong += ["QQ14 2004 1010 0505 0001 3M02 606"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + wrong)], "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban")] for r in P.report(df).collect()}
    for i, t in enumerate(texts):
        number = next(n for n in IBANS if n in t or n.replace(" ", "") in t)
        number = number if number in t else number.replace(" ", "")
        assert got[i] == [f"iban:{t.index(number)}:{t.index(number) + len(number)}"], t
    assert all(not got[i] for i in range(len(texts), len(texts) + len(wrong)))


def test_scores_follow_context(spark):
    df = spark.createDataFrame([(1, "mail me@x.org"), (2, "q me@x.org 1.2.3.4"), (3, "konto " + IBANS[0]), (4, None)],
                               "doc_id long, text string")
    assert {r.doc_id: r.scores for r in P.report(df).collect()} == {1: "90", 2: "60,50", 3: "100", 4: ""}


def test_report_equals_sql(spark):
    import duckdb
    from innkeep.llm.oracle import _pii
    docs = [(i, t) for i, t in enumerate([t for t in TEXTS if t is None or len(t) < 50000] + IBANS
                                         + [f"konto {a} {b}, host 10.0.0.1" for a, b in zip(IBANS, IBANS[1:])])]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    df = P.report(spark.createDataFrame(docs, "doc_id long, text string"))
    want = con.execute(f"select {', '.join(df.columns)} from ({_pii()}) order by doc_id").fetchall()
    assert [tuple(r) for r in df.orderBy("doc_id").collect()] == want


def test_redact_keeps_columns(spark):
    df = spark.createDataFrame([(1, "é me@x.org, call +49 30 12345678!", "a", 1), (2, None, "b", 2), (3, "", "c", 3),
                                (4, "none", "d", 4)], "doc_id long, text string, spans string, _hits_ip int")
    rows = {r.doc_id: tuple(r) for r in P.redact(df).collect()}
    assert rows == {1: (1, "é <EMAIL>, call <PHONE>!", "a", 1), 2: (2, None, "b", 2), 3: (3, "", "c", 3), 4: (4, "none", "d", 4)}


def test_empty_table(spark):
    assert P.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
