"""Brute-force checks on random batches (one Spark job per batch)."""

import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from innkeep.functions import periods as P
from innkeep.operators import invoices as INV
from innkeep.operators import stats
from innkeep.operators.ordering import with_global_index
from tests.helpers import booking_doc, bookings_df, customer_doc, customers_df

day = st.dates(min_value=dt.date(2019, 11, 1), max_value=dt.date(2020, 4, 30))
stay = st.tuples(day, st.integers(0, 80), st.integers(0, 4), st.booleans())


def loop_counts(arrival, departure, n, start, end):
    """Day-by-day count as the original view does it."""
    arrivals = 0 if arrival < start else n
    this = over = 0
    d = max(arrival, start)
    while d <= departure - dt.timedelta(days=1):
        if d <= end:
            this += n
        else:
            over += n
        d += dt.timedelta(days=1)
    return arrivals, this, over


@settings(max_examples=4, deadline=None, derandomize=True)
@given(st.lists(stay, min_size=1, max_size=40), st.sampled_from(
    [dt.date(2019, 12, 1), dt.date(2020, 2, 1), dt.date(2020, 3, 1)]))
def test_month_counts_match_day_loop(spark, stays_, month):
    inv = (None, "A\nB\nC-1 X", None, None, "", "", [], "", 0)
    rows = []
    for i, (a, nights, n, swap) in enumerate(stays_):
        b = a + dt.timedelta(days=nights)
        guests = [("g", "f", None)] * n
        doc = booking_doc(b.isoformat() if swap else a.isoformat(),
                          a.isoformat() if swap else b.isoformat(), guests, invoice=inv)
        rows.append((i, 1, doc))
    book = bookings_df(spark, rows)
    cust = customers_df(spark, [(1, "k", customer_doc())])
    start, end = month, P_last(month)
    got = {r.id: (r.arrivals, r.nights, r.carry)
           for r in stats.statistics_rows(book, cust, month).collect()}
    for i, (a, nights, n, _) in enumerate(stays_):
        d = a + dt.timedelta(days=nights)
        if a <= end and d > start:
            assert got[i] == loop_counts(a, d, n, start, end)
        else:
            assert i not in got


def P_last(m):
    nxt = (m.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return nxt - dt.timedelta(days=1)


position = st.tuples(st.integers(0, 30), st.integers(0, 20000),
                     st.sampled_from([("General19", None), ("Reduced7", None),
                                      ("Reduced7With3EuroDrinks19", None), ("Legacy", 16),
                                      ("Legacy", 5)]))


def float_tax_table(positions):
    """Float accumulation per part as in the original, rounded once to cents."""
    sums = {}
    for q, price, (tax, lr) in positions:
        if tax == "Reduced7With3EuroDrinks19":
            parts = [(7, price - 300), (19, 300)]
        else:
            parts = [({"General19": 19, "Reduced7": 7}.get(tax, lr), price)]
        for rate, value in parts:
            r = rate / 100.0
            v = (q * value) / 100.0
            sums[rate] = sums.get(rate, 0.0) + v * r / (1.0 + r)
    return {rate: math.floor(x * 100 + 0.5) for rate, x in sums.items()}


@settings(max_examples=4, deadline=None, derandomize=True)
@given(st.lists(st.lists(position, min_size=1, max_size=6), min_size=1, max_size=30))
def test_tax_table_matches_float_accumulation(spark, invoices):
    rows = []
    for i, positions in enumerate(invoices):
        pos = [(q, "x", price, tax, lr) for q, price, (tax, lr) in positions]
        inv = (None, "r", None, None, "t", "", pos, "", 0)
        rows.append((i, 1, booking_doc("2020-01-01", "2020-01-02", invoice=inv)))
    got = {}
    for r in INV.tax_table(bookings_df(spark, rows)).collect():
        if r.kind == 0:
            got.setdefault(r.id, {})[r.rate] = r.tax_cents
    for i, positions in enumerate(invoices):
        assert got[i] == float_tax_table(positions)


def py_period_text(a, b):
    f, t = min(a, b), max(a, b)
    tt = f"{t.day}.{t.month}.{t.year}"
    d, m, y = f.day == t.day, f.month == t.month, f.year == t.year
    if d and m and y:
        return tt
    if not d and m and y:
        return f"{f.day}. bis {tt}"
    if not d and not m and y:
        return f"{f.day}.{f.month}. bis {tt}"
    return f"{f.day}.{f.month}.{f.year} bis {tt}"


@settings(max_examples=3, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.dates(dt.date(2019, 1, 1), dt.date(2021, 12, 31)),
                          st.dates(dt.date(2019, 1, 1), dt.date(2021, 12, 31))),
                min_size=1, max_size=60))
def test_period_text_matches_python(spark, pairs):
    df = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a: date, b: date>")
    out = df.select("i", P.period_text(P.arrival_of("p"), P.departure_of("p")).alias("t")).collect()
    for r in out:
        assert r.t == py_period_text(*pairs[r.i])


@settings(max_examples=3, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.integers(0, 50)),
                min_size=1, max_size=200), st.integers(1, 9))
def test_global_index_matches_local_sort(spark, rows, parts):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id int, g string, v int")
    got = {r.id: r.pos for r in with_global_index(df, ["v", "id"], partition_col="g",
                                                   index_col="pos", num_partitions=parts).collect()}
    for g in set(x[0] for x in rows):
        ids = sorted((v, i) for i, (gg, v) in enumerate(rows) if gg == g)
        for k, (_, i) in enumerate(ids):
            assert got[i] == k


words = st.sampled_from(["the", "cat", "dog", "of", "und", "Katze", "é", "x1", "sat"])


@settings(max_examples=3, deadline=None, derandomize=True)
@given(st.lists(st.lists(words, min_size=0, max_size=12), min_size=1, max_size=15),
       st.lists(st.tuples(st.sampled_from(["", "-", "\"", "or"]), words, words),
                min_size=1, max_size=4))
def test_search_equals_plain_evaluation_on_random_queries(spark, texts, parts):
    from innkeep.operators import search as S
    docs = spark.createDataFrame([(i, "en", " ".join(t) + ".") for i, t in enumerate(texts)],
                                 "doc_id long, lang string, text string")
    q = " ".join(f'"{a} {b}"' if op == "\"" else (f"{a} or {b}" if op == "or" else f"{op}{a}")
                 for op, a, b in parts)
    ref = sorted(r.doc_id for r in S.search_documents(docs, q).collect())

    import re

    def matches(tokens, term):
        n = len(term.words)
        hit = any(tokens[k:k + n] == term.words for k in range(len(tokens) - n + 1))
        return not hit if term.negated else hit

    groups = S.parse_websearch(q)
    py = sorted(i for i, t in enumerate(texts)
                if not groups or any(all(matches(re.findall(r"[^\W_]+", (" ".join(t)).lower()), term)
                                         for term in g) for g in groups))
    assert ref == py, q
