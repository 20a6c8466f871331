"""Migration, quality/change operators, restore and exports on hand-built rows."""

import datetime as dt
import os
import tempfile

import pytest

from innkeep.operators import exports as EX
from innkeep.operators import migration as MG
from innkeep.operators import quality as Q
from innkeep.operators import restore as RS
from innkeep.sources import legacy as LG
from innkeep.streaming import changes as ST
from tests.helpers import booking_doc, bookings_df, customer_doc, customers_df


def legacy(spark, rows):
    """rows: dicts of the columns to set; everything else empty text."""
    full = [tuple(r.get(c, "") for c in LG.COLUMNS) for r in rows]
    return spark.createDataFrame(full, LG.LEGACY_SCHEMA)


BASE = {"SUCH": "kw", "VORNAME": "Max", "NAME": "Muster", "STRASSE": "Weg", "HNR": "3"}


def test_legacy_allocs_and_notes(spark):
    row = dict(BASE, RECORDID="7", GROUPID="", ZIMMER=" 12 ", AVON="2020-01-01", ABIS="2020-01-03",
               ANZAHL1="2", ART1="Doppelzimmer", PREIS1="45.00", PROZ1="150",
               ANZAHL2="x", ART2="Einzelzimmer", PREIS2="30.00", PROZ2="",
               ANZAHL3="3", ART3="Kurtaxe", PREIS3="2.00", PROZ3="",
               ANZAHL4="1", ART4="Frei", PREIS4="0.00", PROZ4="", BEMAUFE="  Bemerkung \n",
               AGEF="0.00", AEING="-5.00", TELEFON=" 07531/ ", MOBILTEL="0171/123",
               KUNDENNUMMER="K1", POSTFACH="")
    customers, bookings = MG.migrate(legacy(spark, [row]))
    b = bookings.first()
    assert b.id == 7 and b.customer == 7
    assert [(a.room, a.price_per_bed, a.beds, a.description) for a in b.data.allocs] == \
        [("12", 4500, 2, "Doppelzimmer"), ("", 4500, 2, "Doppelzimmer")]
    assert b.data.deposit_asked is None and b.data.deposit_got is None
    assert b.data.note == ("Importiert aus Combit (7).\n\n- 2x Doppelzimmer à 45.00€ (150%)\n"
                           "- xx Einzelzimmer à 30.00€ (%)\n- 3x Kurtaxe à 2.00€ (%)\n"
                           "- 1x Frei à 0.00€ (%)\n\nBemerkung")   # fields are trimmed
    c = customers.first()
    assert c.id == 7 and c.data.contact.phone == "" and c.data.contact.mobile == "0171/123"
    assert c.data.note == "Importiert aus Combit (7).\nKunden-Nr.: K1\n"
    assert c.data.address.street_with_num == "Weg 3"


def test_legacy_periods_and_guests(spark):
    rows = [dict(BASE, RECORDID="1", GROUPID="9", ANREISE="2020-05-01", ABREISE="2020-05-04"),
            dict(BASE, RECORDID="2", GROUPID="9", ABIS="2020-05-04"),
            dict(BASE, RECORDID="3", GROUPID="9", AVON="2020-05-01"),
            dict(BASE, RECORDID="4", GROUPID="9", VORNAME="", NAME="",
                 P_VORNAME="Eva", GEB_DAT02="2010-01-01", P_NAME5="X")]
    customers, bookings = MG.migrate(legacy(spark, rows))
    got = {r.id: r for r in bookings.collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].arrival, got[1].departure) == (dt.date(2020, 5, 1), dt.date(2020, 5, 4))
    assert (got[2].arrival, got[2].departure) == (dt.date(2020, 5, 3), dt.date(2020, 5, 4))
    assert (got[3].arrival, got[3].departure) == (dt.date(2020, 5, 1), dt.date(2020, 5, 2))
    cs = customers.collect()
    assert len(cs) == 1 and cs[0].id == 9 and cs[0].data.name.given == ""   # highest record id
    typed = MG.cast_legacy(legacy(spark, rows[3:]))
    g = typed.select(MG.legacy_guests().alias("g")).first().g
    assert [(x.given, x.family, x.born) for x in g] == [("Eva", "", dt.date(2010, 1, 1)),
                                                       ("", "X", None)]


def test_legacy_csv_dialects(spark):
    rows = [dict(BASE, RECORDID="5", AVON="01.02.2020", ABIS="03.02.2020", PREIS1="1.234,50",
                 ART1="Suite", ANZAHL1="1", BEMAUFE='zwei\r\nZeilen "zitiert" äöü')]
    root = tempfile.mkdtemp(prefix="legacy-")
    path = os.path.join(root, "export")
    LG.write_legacy_csv(legacy(spark, rows), path, sep=";")
    raw = b"".join(open(os.path.join(path, f), "rb").read()
                   for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    assert b"\r\n" in raw and "äöü".encode("latin-1") in raw
    back = LG.read_legacy_csv(spark, path, sep=";")
    _, bookings = MG.migrate(back, dialect="de")
    b = bookings.first()
    assert (b.arrival, b.departure) == (dt.date(2020, 2, 1), dt.date(2020, 2, 3))
    assert b.data.allocs[0].price_per_bed == 123450
    assert b.data.note.endswith('zwei\r\nZeilen "zitiert" äöü')


def test_master_record_is_partial_aggregate(spark):
    rows = [dict(BASE, RECORDID=str(i), GROUPID="1", SUCH=f"k{i}") for i in range(50)]
    customers, _ = MG.migrate(legacy(spark, rows))
    assert customers.first().data.keyword == "k49"
    plan = customers._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_apply_changes_and_changed(spark):
    table = spark.createDataFrame([(1, "a", dt.datetime(2020, 1, 1)), (2, "b", dt.datetime(2020, 1, 1)),
                                   (3, "c", dt.datetime(2020, 1, 1))],
                                  "id long, keyword string, modified timestamp_ntz")
    ch = spark.createDataFrame([
        (1, "update", dt.datetime(2021, 1, 1), 1, "a1"), (1, "update", dt.datetime(2021, 1, 2), 2, "a2"),
        (2, "delete", dt.datetime(2021, 1, 1), 3, None), (4, "insert", dt.datetime(2021, 1, 1), 4, "d"),
        (3, "update", dt.datetime(2021, 1, 1), 6, "c2"), (3, "delete", dt.datetime(2021, 1, 1), 5, None)],
        "id long, op string, ts timestamp_ntz, change_id long, keyword string")
    out = {r.id: r for r in Q.apply_changes(table, ch).collect()}
    assert set(out) == {1, 3, 4}
    assert (out[1].keyword, out[1].modified) == ("a2", dt.datetime(2021, 1, 2))
    assert out[3].keyword == "c2" and out[4].keyword == "d"
    diff = sorted(r.id for r in Q.changed(table, Q.apply_changes(table, ch), "id", "keyword").collect())
    assert diff == [1, 2, 3, 4]


def test_constraints_and_cascade(spark):
    cust = customers_df(spark, [(1, "a", customer_doc()), (2, " ", customer_doc()),
                                (-1, "x", customer_doc())])
    book = bookings_df(spark, [(10, 1, booking_doc("2020-01-01", "2020-01-02")),
                               (11, 2, booking_doc("2020-01-01", "2020-01-02")),
                               (12, 7, booking_doc("2020-01-01", "2020-01-02"))])
    v = sorted((r.table, r.id, r.rule) for r in Q.violations(cust, book).collect())
    assert v == [("customers", -1, "id >= 0"), ("customers", 2, "keyword not blank")]
    assert [r.id for r in Q.orphans(book, "customer", cust).collect()] == [12]
    nums = spark.createDataFrame([("R1", 11), ("R1", 10), ("R2", 99)], "number string, booking long")
    assert [(r.number, r.n) for r in Q.duplicates(nums, "number").collect()] == [("R1", 2)]
    ids = spark.createDataFrame([(2,)], "id long")
    c, b, blocking = Q.delete_customers(cust, book, nums, ids)
    assert sorted(r.id for r in c.collect()) == [-1, 1]
    assert sorted(r.id for r in b.collect()) == [10, 12]
    assert [r.id for r in blocking.collect()] == [11]
    ok, rej = Q.locked_changes(spark.createDataFrame([(10,), (11,)], "id long"),
                               bookings_df(spark, [(10, 1, booking_doc("2020-01-01", "2020-01-02")),
                                                   (11, 1, booking_doc("2020-01-01", "2020-01-02",
                                                                       invoice=(None, "r", None, None,
                                                                                "", "", [], "", 0)))]))
    assert [r.id for r in ok.collect()] == [10] and [r.id for r in rej.collect()] == [11]


def test_touch_batch_and_stream_agree(spark):
    cust = spark.createDataFrame([(1, dt.datetime(2020, 1, 1)), (2, dt.datetime(2030, 1, 1)),
                                  (3, dt.datetime(2020, 1, 1))], "id long, modified timestamp_ntz")
    root = tempfile.mkdtemp(prefix="touch-")
    src = os.path.join(root, "src")
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 2, 1)),
                                (2, dt.datetime(2024, 1, 1))], "user_id long, ts timestamp_ntz")
    ev.write.parquet(src)
    batch = {r.id: r.modified for r in Q.touch_customers(
        cust, ev.withColumnRenamed("user_id", "customer")).collect()}
    stream = {r.id: r.modified for r in ST.touch_once(spark, cust, src, ev.schema, root).collect()}
    assert batch == stream == {1: dt.datetime(2024, 2, 1), 2: dt.datetime(2030, 1, 1),
                               3: dt.datetime(2020, 1, 1)}


def test_backup_restore_roundtrip(spark):
    cust = customers_df(spark, [(5, "a", customer_doc(keyword="a")), (3, "b", customer_doc(keyword="b"))])
    book = bookings_df(spark, [(100, 5, booking_doc("2020-01-01", "2020-01-02")),
                               (101, 3, booking_doc("2020-02-01", "2020-02-02")),
                               (102, 5, booking_doc("2020-03-01", "2020-03-02"))])
    path = os.path.join(tempfile.mkdtemp(prefix="backup-"), "b")
    RS.backup(cust, book, path)
    c, b = RS.restore(spark, path, 1000, 2000)
    cmap = {r.data._import_key: r.id for r in c.collect()}
    assert cmap == {3: 1000, 5: 1001}
    rows = sorted((r.id, r.old_id, r.customer) for r in b.collect())
    assert rows == [(2000, 102, 1001), (2001, 100, 1001), (2002, 101, 1000)]
    dup = cust.unionByName(cust)
    with pytest.raises(RS.RestoreError):
        RS.remap_ids(dup, book, 1, 1)
    with pytest.raises(RS.RestoreError):
        RS.remap_ids(cust.where("id = 3"), book, 1, 1)


def test_interchange_layout_and_registration(spark):
    cust = customers_df(spark, [(1, "m", customer_doc())])
    allocs = [("12", 5000, 1, "Einzelzimmer"), ("", 5000, 1, "Einzelzimmer"),
              ("3", 8000, 2, "Doppelzimmer")]
    guests = [("Max", "Muster", "1980-01-01"), ("Kim", "Muster", "2018-01-01")]
    book = bookings_df(spark, [(1, 1, booking_doc("2015-10-05", "2015-10-13", guests, allocs,
                                                  deposit_got=2000))])
    text = EX.interchange(book, cust).first().text
    lines = text.split("\n")
    assert len(lines) == 30 and lines[0] == "2014_EXCEL_BR_V2_pQ06eaXd" and lines[1] == "12"
    assert lines[13:15] == ["5.10.2015", "13.10.2015"]
    assert lines[15:23] == ["1", "Doppelzimmer", "80.00", "200", "2", "Einzelzimmer", "50.00", "100"]
    assert lines[23:26] == ["", "", ""]
    assert lines[26:] == ["1", "Kurtaxe", "2.00", "20.00"]
    f = EX.registration_forms(book, cust).first()
    assert (f.kategorie, f.name, f.vorname) == ("1", "Muster", "Max")
    assert [(p.kategorie, p.vorname) for p in f.begleitperson] == [("7", "Kim")]
    out = os.path.join(tempfile.mkdtemp(prefix="xml-"), "forms")
    EX.write_registration_xml(EX.registration_forms(book, cust), out)
    xml = "".join(open(os.path.join(out, p), encoding="utf-8").read()
                  for p in os.listdir(out) if not p.startswith(("_", ".")))
    assert "<meldeschein>" in xml and "<begleitperson>" in xml and "<hotelid>0550</hotelid>" in xml


def test_confirmation_letter_enumeration(spark):
    cust = customers_df(spark, [(1, "m", customer_doc())])
    allocs = [("1", 5000, 1, "Einzelzimmer"), ("2", 4500, 2, "Doppelzimmer"),
              ("3", 4000, 3, "Dreibettzimmer")]
    book = bookings_df(spark, [(1, 1, booking_doc("2020-05-01", "2020-05-07", [], allocs,
                                                  deposit_asked=10000))])
    body = EX.confirmation_letters(book, cust, "1.4.2020").first().letter.body
    assert ("<li>1 Person im Einzelzimmer für 50,00 € pro Nacht,</li>"
            "<li>2 Personen im Doppelzimmer zu je 45,00 € pro Nacht und</li>"
            "<li>3 Personen im Dreibettzimmer zu je 40,00 € pro Nacht</li>") in body
    assert "Anzahlung in Höhe von 100,00 €" in body and "1. bis 7.5.2020" in body


def test_split_legacy_documents(spark):
    df = spark.createDataFrame(
        [(7, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2), ("kw", [("n1",), ("n2",)]))],
        "customer_id long, created timestamp_ntz, modified timestamp_ntz, "
        "data struct<keyword:string, bookings:array<struct<note:string>>>")
    c, b = LG.split_legacy_documents(df)
    assert c.first().data.asDict() == {"keyword": "kw"}
    assert sorted((r.id, r.customer, r.data.note) for r in b.collect()) == \
        [(-1, 7, "n1"), (-1, 7, "n2")]


def test_registration_xml_is_escaped(spark):
    cust = customers_df(spark, [(1, "m", customer_doc(family="Smith & <Sons>"))])
    book = bookings_df(spark, [(1, 1, booking_doc("2020-05-01", "2020-05-03"))])
    out = os.path.join(tempfile.mkdtemp(prefix="xmlesc-"), "forms")
    EX.write_registration_xml(EX.registration_forms(book, cust), out)
    xml = "".join(open(os.path.join(out, p), encoding="utf-8").read()
                  for p in os.listdir(out) if not p.startswith(("_", ".")))
    # '&' and '<' are escaped ('>' may stay literal in XML text)
    assert "Smith &amp; &lt;Sons" in xml and "<Sons" not in xml
