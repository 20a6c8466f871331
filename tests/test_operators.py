"""Operators on hand-built frames: statistics boundaries, invoices, search, ordering."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from innkeep.operators import invoices as INV
from innkeep.operators import search as S
from innkeep.operators import stats, stays
from innkeep.operators.ordering import with_global_index
from tests.helpers import booking_doc, bookings_df, customer_doc, customers_df

def _inv(recipient="Max Muster\nAm Weg 1\nD-12345 Musterstadt"):
    return (None, recipient, None, None, "Rechnung", "", [], "", 0)


@pytest.fixture(scope="module")
def stat_frames(spark):
    cust = customers_df(spark, [(1, "muster", customer_doc(code="CH"))])
    g2 = [("A", "B", None), ("C", "D", None)]
    g3 = g2 + [("E", "F", None)]
    rows = [
        (10, 1, booking_doc("2020-02-01", "2020-02-01", g2, invoice=_inv())),       # 1st, 0 nights
        (11, 1, booking_doc("2020-02-15", "2020-02-15", g2, invoice=_inv())),       # mid, 0 nights
        (12, 1, booking_doc("2020-03-05", "2020-01-20", g3, invoice=_inv())),       # spans month
        (13, 1, booking_doc("2020-02-27", "2020-03-02", g2, invoice=_inv("X\nY\n D -1 Z\n"))),
        (14, 1, booking_doc("2020-02-10", "2020-02-12", g2)),                      # no invoice
        (15, 1, booking_doc("2020-02-10", "2020-02-12", g2, invoice=_inv(""))),     # empty recipient
    ]
    return cust, bookings_df(spark, rows)


def test_month_statistics_boundaries(spark, stat_frames):
    cust, book = stat_frames
    rows = {r.id: r for r in stats.statistics_rows(book, cust, "2020-02-01").collect()}
    assert 10 not in rows and 14 not in rows
    assert (rows[11].arrivals, rows[11].nights, rows[11].carry) == (2, 0, 0)
    assert (rows[12].arrivals, rows[12].nights, rows[12].carry) == (0, 3 * 29, 3 * 4)
    assert (rows[13].arrivals, rows[13].nights, rows[13].carry) == (2, 6, 2)   # 2020 is a leap year
    assert rows[13].country == "D" and rows[13].name == "X"
    assert rows[11].country == "D"
    assert (rows[15].name, rows[15].country) == ("muster", "CH")


def test_month_statistics_total_and_invariant(spark, stat_frames):
    cust, book = stat_frames
    s = {r.country: r for r in stats.month_stats(book, cust, "2020-02-01").collect()}
    assert s[None].arrivals == sum(v.arrivals for k, v in s.items() if k is not None)
    # nights before + in month + carry = guests x nights for the spanning stay
    r = [x for x in stats.statistics_rows(book, cust, "2020-02-01").collect() if x.id == 12][0]
    before = 3 * (dt.date(2020, 2, 1) - dt.date(2020, 1, 20)).days
    assert before + r.nights + r.carry == 3 * (dt.date(2020, 3, 5) - dt.date(2020, 1, 20)).days


def test_all_months_equals_single_months(spark, stat_frames):
    cust, book = stat_frames
    allm = {(r.month, r.country): r for r in stats.all_months_stats(book, cust).collect()}
    for m in ("2020-01-01", "2020-02-01", "2020-03-01"):
        single = {r.country: r for r in stats.month_stats(book, cust, m, with_total=False).collect()}
        md = dt.date.fromisoformat(m)
        for c, r in single.items():
            a = allm[(md, c)]
            assert (a.arrivals, a.nights, a.carry) == (r.arrivals, r.nights, r.carry)
        assert len([k for k in allm if k[0] == md]) == len(single)


def test_agenda_kinds(spark):
    cust = customers_df(spark, [(1, "muster", customer_doc())])
    rows = [(1, 1, booking_doc("2020-05-07", "2020-05-10", [("a", "b", None)],
                               [("12", 3000, 1, "Einzelzimmer")])),
            (2, 1, booking_doc("2020-05-01", "2020-05-07", [])),
            (3, 1, booking_doc("2020-05-01", "2020-05-09", [("a", "b", None), ("c", "d", None)])),
            (4, 1, booking_doc("2020-05-07", "2020-05-07", [])),
            (5, 1, booking_doc("2020-05-08", "2020-05-09", []))]
    a = {r.id: r for r in stays.agenda(bookings_df(spark, rows), cust, "2020-05-07").collect()}
    assert set(a) == {1, 2, 3, 4}
    assert (a[1].kind, a[2].kind, a[3].kind, a[4].kind) == ("arrive", "leave", "stay", "arrive")
    assert a[1].card == "1 Person vom 7. bis 10.5.2020  in Zimmer 12"
    assert a[2].card == "0 Personen vom 1. bis 7.5.2020 "


def test_invoice_split_tax_table(spark):
    inv = (None, "r", None, None, "t", "", [(2, "Zimmer", 5000, "Reduced7With3EuroDrinks19", None)],
           "", 0)
    book = bookings_df(spark, [(1, 1, booking_doc("2020-01-01", "2020-01-02", invoice=inv))])
    t = [(r.label, r.rate, r.tax_cents, r.kind) for r in
         INV.tax_table(book).orderBy("label").collect()]
    assert t == [("A", 7, 615, 0), ("B", 19, 96, 0), ("C", None, 0, 1)]
    lab = book.select(INV.position_labels("data.invoice").alias("l")).first().l
    assert lab == ["C"]


def test_invoice_labels_legacy_before_split(spark):
    pos = [(1, "a", 1000, "Legacy", 16), (1, "b", 1000, "Reduced7", None),
           (1, "c", 1000, "Reduced7With3EuroDrinks19", None), (1, "d", 1000, "General19", None)]
    inv = (None, "r", None, None, "t", "", pos, "", 0)
    book = bookings_df(spark, [(1, 1, booking_doc("2020-01-01", "2020-01-02", invoice=inv))])
    t = [(r.label, r.rate) for r in INV.tax_table(book).orderBy("label").collect()]
    assert t == [("A", 7), ("B", 16), ("C", 19), ("D", None)]
    assert book.select(INV.position_labels("data.invoice").alias("l")).first().l == \
        ["B", "A", "D", "C"]


def test_generate_invoice(spark):
    cust = customers_df(spark, [(1, "muster", customer_doc())])
    guests = [("a", "b", "1990-01-01"), ("c", "d", "2015-01-01"), ("e", "f", None)]
    allocs = [("12", 4500, 2, "Doppelzimmer"), ("", 3000, 1, "Einzelzimmer")]
    book = bookings_df(spark, [(1, 1, booking_doc("2022-07-10", "2022-07-13", guests, allocs,
                                                  deposit_got=5000)),
                               (2, 1, booking_doc("2022-07-10", "2022-07-13", guests, allocs,
                                                  tax_free=True))])
    g = {r.id: r.invoice for r in INV.generate_invoices(book, cust, "2022-07-14").collect()}
    i = g[1]
    assert i.id == "220713-012"
    assert i.recipient == "Max Muster\nAm Weg 1\nD-12345 Musterstadt"
    assert i.intro.startswith("Für Ihren Aufenthalt vom 10. bis 13.7.2022")
    q = [(p.quantity, p.description, p.price, p.tax) for p in i.positions]
    assert q == [(6, "Übernachtung im Doppelzimmer", 4500, "Reduced7With3EuroDrinks19"),
                 (3, "Übernachtung im Einzelzimmer", 3000, "Reduced7With3EuroDrinks19"),
                 (6, "Kurtaxe", 250, "Reduced7")]
    assert i.deposit == 5000 and i.invoice_date == dt.date(2022, 7, 14)
    assert len(g[2].positions) == 2 and g[2].deposit == 0


def test_invoice_json_old_shape(spark):
    old = ('{"id":null,"recipient":"r","date":"2019-05-01","title":"t","intro":"",'
           '"positions":[{"quantity":2,"description":"x","price":12.5,"tax":16},'
           '{"quantity":1,"description":"y","price":1.0,"tax":["Reduced7"]}],'
           '"closing":"","deposit":10.0}')
    new = ('{"id":"a","recipient":"r","invoice_date":"2019-05-02","departure_date":"2019-05-01",'
           '"title":"t","intro":"","positions":[],"closing":"","deposit":0}')
    df = spark.createDataFrame([(old,), (new,), ("not json",)], "j string")
    r = df.select(INV.decode_invoice("j").alias("i")).collect()
    assert r[0].i.invoice_date == dt.date(2019, 5, 1) and r[0].i.departure_date is None
    assert [(p.price, p.tax, p.legacy_rate) for p in r[0].i.positions] == \
        [(1250, "Legacy", 16), (100, "Reduced7", None)]
    assert r[0].i.deposit == 1000
    assert r[1].i.departure_date == dt.date(2019, 5, 1)
    assert r[2].i is None


def test_keyword_patterns():
    assert S.keyword_pattern("_ab") == "ab%"
    assert S.keyword_pattern("ab_") == "%ab"
    assert S.keyword_pattern("_ab_") == "ab"
    assert S.keyword_pattern("  ") is None
    assert S.keyword_pattern(" a_b ") == "%a_b%"


def test_websearch(spark):
    df = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, "a cat and the dog"),
                                (4, "Katze über"), (5, "")], "id int, text string")
    from innkeep.functions.text import tokens
    t = df.select("id", tokens("text").alias("tokens"))

    def ids(q):
        return sorted(r.id for r in S.search_text(t, q).collect())

    assert ids("the cat") == [1, 3]
    assert ids('"the cat"') == [1]
    assert ids("the -cat") == [2]
    assert ids("cat or dog") == [1, 2, 3]
    assert ids("ÜBER") == [4]
    assert ids("   ") == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("n_parts", [1, 3, 7])
def test_global_index_matches_row_number(spark, n_parts):
    from pyspark.sql import Window
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", (i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = with_global_index(df, ["v", "id"], partition_col="g", index_col="pos",
                            num_partitions=n_parts)
    w = Window.partitionBy("g").orderBy("v", "id")
    exp = df.withColumn("pos", F.row_number().over(w) - 1)
    assert sorted(got.select("id", "pos").collect()) == sorted(exp.select("id", "pos").collect())
    plain = with_global_index(df, ["v", "id"], index_col="pos", num_partitions=n_parts)
    exp2 = df.withColumn("pos", F.row_number().over(Window.orderBy("v", "id")) - 1)
    assert sorted(plain.select("id", "pos").collect()) == sorted(exp2.select("id", "pos").collect())


def test_search_page_positions(spark):
    cust = customers_df(spark, [(i, f"k{i}", customer_doc(keyword=f"k{i}")) for i in range(600)])
    cust = cust.withColumn("modified", F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")))
    book = bookings_df(spark, [(1, 5, booking_doc("2020-01-01", "2020-01-03")),
                               (2, 5, booking_doc("2020-02-01", "2020-01-28"))])
    p1 = S.search_page(cust, book, None, 1).orderBy("position").collect()
    assert [r.position for r in p1] == list(range(250, 500))
    assert [r.id for r in p1] == list(range(250, 500))
    p0 = {r.id: r for r in S.search_page(cust, book, None, 0).collect()}
    assert (p0[5].from_date, p0[5].till_date) == (dt.date(2020, 1, 28), dt.date(2020, 2, 1))
    more = S.more_pages(cust, 1).first()
    assert (more.rows, more.has_more) == (250, True)
    assert S.more_pages(cust, 2).first().has_more is False


def test_decode_invoices_keeps_corrupt_rows(spark):
    ok = ('{"id":"a","recipient":"r","invoice_date":"2019-05-02","departure_date":null,'
          '"title":"t","intro":"","positions":[],"closing":"","deposit":0}')
    df = spark.createDataFrame([(1, ok), (2, "{broken"), (3, None)], "id int, invoice_json string")
    rows = {r.id: r for r in INV.decode_invoices(df).collect()}
    assert rows[1].invoice.id == "a" and rows[1]._corrupt is None
    assert rows[2].invoice is None and rows[2]._corrupt == "{broken"
    assert rows[3].invoice is None and rows[3]._corrupt is None
