"""Column helpers: periods, money, rooms, taxes, guests (FIXTURES §3 edge rows)."""

import datetime as dt

from pyspark.sql import functions as F

from innkeep.functions import guests as G
from innkeep.functions import money as M
from innkeep.functions import periods as P
from innkeep.functions import rooms as R
from innkeep.functions import taxes as TX
from innkeep.operators.invoices import invoice_number


def test_period_either_order(spark):
    df = spark.createDataFrame([(dt.date(2020, 5, 7), dt.date(2020, 5, 1))], "a date, b date")
    r = df.select(P.arrival_of(F.struct("a", "b")).alias("x"),
                  P.departure_of(F.struct("a", "b")).alias("y")).first()
    assert (r.x, r.y) == (dt.date(2020, 5, 1), dt.date(2020, 5, 7))


def test_period_text(spark):
    cases = [("2020-05-01", "2020-05-07", "1. bis 7.5.2020"),
             ("2020-05-01", "2020-06-02", "1.5. bis 2.6.2020"),
             ("2020-05-01", "2021-01-02", "1.5.2020 bis 2.1.2021"),
             ("2020-05-01", "2020-06-01", "1.5.2020 bis 1.6.2020"),
             ("2020-05-07", "2020-05-07", "7.5.2020")]
    df = spark.createDataFrame([(dt.date.fromisoformat(a), dt.date.fromisoformat(b), e)
                                for a, b, e in cases], "a date, b date, e string")
    for r in df.select(P.period_text("a", "b").alias("t"), "e").collect():
        assert r.t == r.e


def test_money_format_and_decode(spark):
    df = spark.createDataFrame([(1234,), (-150,), (5,), (None,)], "c bigint")
    got = [r.t for r in df.select(M.format_money("c").alias("t")).collect()]
    assert got == ["12,34", "-1,50", "0,05", None]
    units = spark.createDataFrame([(0.125,), (-0.125,), (49.995,)], "u double")
    cents = [r.c for r in units.select(M.cents_of_units("u").alias("c")).collect()]
    assert cents == [13, -12, 5000]
    fl = spark.createDataFrame([(-5,), (5,)], "x bigint").select(M.floor_div("x", 2).alias("q"))
    assert [r.q for r in fl.collect()] == [-3, 2]


def test_rooms_text_first_and_order(spark):
    df = spark.createDataFrame([(["12", "", "A", "3", " 12 "],), ([],), (["", " "],)],
                               "rooms array<string>")
    allocs = F.transform("rooms", lambda r: F.struct(r.alias("room")))
    out = df.select(R.rooms_of(allocs).alias("t")).select(
        R.rooms_text(F.col("t")).alias("txt"), R.first_room(F.col("t")).alias("first"),
        invoice_number(F.col("t"), F.lit(dt.date(2021, 4, 3))).alias("no")).collect()
    assert (out[0].txt, out[0].first, out[0].no) == ("3, 12, A", "3", "210403-003")
    assert (out[1].txt, out[1].first, out[1].no) == (None, None, None)
    assert (out[2].txt, out[2].first, out[2].no) == (None, None, None)


def test_invoice_number_year_mod_1000(spark):
    df = spark.createDataFrame([(["5"], dt.date(1997, 2, 3)), (["B"], dt.date(2001, 12, 24)),
                                (["1234"], dt.date(2005, 1, 1))], "rooms array<string>, d date")
    allocs = F.transform("rooms", lambda r: F.struct(r.alias("room")))
    got = [r.no for r in df.select(invoice_number(R.rooms_of(allocs), F.col("d")).alias("no"))
           .collect()]
    assert got == ["9970203-005", "011224-B", "050101-1234"]


def test_room_sort_key(spark):
    df = spark.createDataFrame([(1, ["B"]), (2, ["2"]), (3, [""]), (4, ["10", "A"]), (5, ["10"]),
                                (6, [])], "id int, rooms array<string>")
    allocs = F.transform("rooms", lambda r: F.struct(r.alias("room")))
    ids = [r.id for r in df.orderBy(R.rooms_of(allocs)).collect()]
    assert ids == [6, 2, 5, 4, 1, 3]


def test_decode_tax(spark):
    raw = ["7", "19", "16", '["Reduced7"]', '["General19"]', '["Reduced7With3EuroDrinks19"]',
           '["Legacy",20]', "nonsense"]
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    got = [(r.t.tax, r.t.legacy_rate) for r in df.select(TX.decode_tax("raw").alias("t")).collect()]
    assert got == [("Reduced7", None), ("General19", None), ("Legacy", 16), ("Reduced7", None),
                   ("General19", None), ("Reduced7With3EuroDrinks19", None), ("Legacy", 20),
                   (None, None)]


def test_tax_keys_round_trip(spark):
    df = spark.createDataFrame([("General19", None), ("Reduced7", None),
                                ("Reduced7With3EuroDrinks19", None), ("Legacy", 16)],
                               "tax string, legacy_rate int")
    back = df.select(TX.tax_of_key(TX.tax_key("tax", "legacy_rate")).alias("b"), "tax",
                     "legacy_rate").collect()
    for r in back:
        assert (r.b.tax, r.b.legacy_rate) == (r.tax, r.legacy_rate)


def test_local_tax(spark):
    df = spark.createDataFrame([(dt.date(2021, 4, 1),), (dt.date(2022, 11, 30),),
                                (dt.date(2026, 7, 1),), (dt.date(2021, 3, 31),)], "d date")
    got = [r.c for r in df.select(TX.local_tax_cents("d").alias("c")).collect()]
    assert got == [200, 100, 330, 80]


def test_included_tax_rounding(spark):
    df = spark.createDataFrame([(9400, 7), (600, 19), (0, 7), (-107, 7)], "s bigint, r int")
    got = [r.t for r in df.select(TX.included_tax_cents("s", "r").alias("t")).collect()]
    assert got == [615, 96, 0, -7]


def test_tax_payer_and_category_boundaries(spark):
    dep = dt.date(2020, 6, 10)
    born = [dt.date(2005, 6, 10), dt.date(2005, 6, 9), dt.date(2005, 6, 11), None,
            dt.date(2016, 1, 1)]
    df = spark.createDataFrame([(b, dep) for b in born], "born date, dep date")
    g = F.struct(F.col("born").alias("born"))
    rows = df.select(G.is_tax_payer(g, F.col("dep")).alias("p"),
                     G.age_category("born", "dep").alias("c")).collect()
    assert [(r.p, r.c) for r in rows] == [(False, "1"), (True, "1"), (False, "8"), (True, "1"),
                                          (False, "7")]


def test_leap_day_cutoff(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29), dt.date(2009, 2, 28))], "dep date, born date")
    g = F.struct(F.col("born").alias("born"))
    r = df.select(G.years_before("dep", 15).alias("cut"), G.is_tax_payer(g, F.col("dep")).alias("p")
                  ).first()
    assert r.cut == dt.date(2009, 2, 28) and r.p is False


def test_cover_update_and_coalesce_helpers(spark):
    from innkeep.functions import text as TXT
    df = spark.createDataFrame([(dt.date(2020, 1, 5), dt.date(2020, 1, 9), dt.date(2020, 1, 1),
                                 dt.date(2020, 1, 6), None, "", "x", " ", "Familie", "Dr.")],
                               "a1 date, b1 date, a2 date, b2 date, n date, e string, x string, "
                               "s string, t1 string, t2 string")
    lo, hi = P.cover("a1", "b1", "a2", "b2")
    upd = P.update_period(F.struct(F.col("a1").alias("a"), F.col("b1").alias("b")), b="n")
    upd2 = P.update_period(F.struct(F.col("a1").alias("a"), F.col("b1").alias("b")), a="a2")
    r = df.select(lo.alias("lo"), hi.alias("hi"), upd.alias("u"), upd2.alias("u2"),
                  TXT.coalesce_blank("e", "x").alias("c1"), TXT.coalesce_blank("x", "e").alias("c2"),
                  TXT.blank_to_null("s").alias("bn"), TXT.letter_for_title("t1").alias("l1"),
                  TXT.letter_for_title("t2").alias("l2")).first()
    assert (r.lo, r.hi) == (dt.date(2020, 1, 1), dt.date(2020, 1, 9))
    assert (r.u.a, r.u.b) == (dt.date(2020, 1, 5), dt.date(2020, 1, 9))
    assert (r.u2.a, r.u2.b) == (dt.date(2020, 1, 1), dt.date(2020, 1, 9))
    assert (r.c1, r.c2, r.bn) == ("x", "x", None)
    assert (r.l1, r.l2) == ("Liebe Familie", None)


def test_month_helpers(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 17),)], "d date")
    r = df.select(P.month_start("d").alias("s"), P.month_end("d").alias("e"),
                  P.month_name("d").alias("n")).first()
    assert (r.s, r.e, r.n) == (dt.date(2020, 2, 1), dt.date(2020, 2, 29), "Februar")
    from innkeep.operators import stays
    assert stays.month_bounds("2020-02-17") == (dt.date(2020, 2, 1), dt.date(2020, 2, 29))
    assert stays.previous_month("2021-01-15") == dt.date(2020, 12, 1)
