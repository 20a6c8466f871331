"""Input that clean fixtures never hold: foreign layouts, bad cells, broken documents."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from innkeep.functions import taxes as TX
from innkeep.operators import exports as EX
from innkeep.operators import invoices as INV
from innkeep.operators import migration as MG
from innkeep.operators import search as S
from innkeep.operators import stats as ST
from innkeep.sources import legacy as LG
from innkeep.streaming import changes as CH
from helpers import customer_doc, customers_df

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _raw(spark, rows):
    cols = sorted({c for r in rows for c in r})
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols))
    return LG.by_name(df)


def _row(**cells):
    return {"RECORDID": "1", "GROUPID": "", "VORNAME": "V", "NAME": "N", "ANREISE": "2020-01-02", "ABREISE": "2020-01-05"} | cells


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("Firma,x,NAME,vorname,RecordId,GROUPID,ABREISE,ANREISE,kundennr,SUCH\r\n"
                    "Co,1,N,V,9,4,2020-01-05,2020-01-02,K7,kw\r\n", encoding="latin-1")
    r = LG.read_legacy_csv(spark, str(path)).first()
    assert (r.RECORDID, r.GROUPID, r.FIRMA, r.NAME, r.SUCH, r.KUNDENNUMMER, r.ZIMMER) == ("9", "4", "Co", "N", "kw", "K7", None)
    path.write_text("NAME,VORNAME\r\na,b\r\n")
    with pytest.raises(ValueError, match="RECORDID"):
        LG.read_legacy_csv(spark, str(path))


def test_bad_and_repeated_record_ids_are_reported_not_lost(spark):
    raw = _raw(spark, [_row(RECORDID=" "), _row(RECORDID="x7"), _row(RECORDID="9", BEMAUFE="a"),
                       _row(RECORDID="9", BEMAUFE="b"), _row(RECORDID="9", BEMAUFE="b"),
                       _row(RECORDID="5", ANZAHL1="99999999999", ART1="Zimmer", PREIS1="5.00")])
    customers, bookings = MG.migrate(raw)
    assert sorted(r.id for r in customers.collect()) == [5, 9]
    rows = {r.id: r for r in bookings.collect()}
    assert sorted(rows) == [5, 9] and rows[5].data.allocs == []
    problems = sorted(tuple(r) for r in MG.legacy_problems(raw).collect())
    assert problems == [(" ", "record id missing or not a number", 1), ("5", "item count or percent out of range", 1),
                        ("9", "record id occurs several times", 3), ("x7", "record id missing or not a number", 1)]


def test_german_amounts(spark):
    df = spark.createDataFrame([("45.00",), ("45,00",), ("1.234,50",), ("1234.5",), ("",), ("x",)], "a string")
    got = [r[0] for r in df.select(MG.money_cents("a", "de")).collect()]
    assert got == [4500, 4500, 123450, 123450, None, None]


DOC = ('{"id":"1","recipient":"a","invoice_date":null,"departure_date":null,"title":"t","intro":"i",'
       '"positions":[{"quantity":2,"description":"d","price":50.0,"tax":%s}],"closing":"c","deposit":0.0}')


def test_undecodable_documents_are_kept_as_corrupt(spark):
    rows = [(1, DOC % '["General19"]'), (2, DOC % '["Brand16"]'), (3, '{"recipient":"a"}'), (4, "{"), (5, None),
            (6, DOC % "16")]
    got = {r.id: r for r in INV.decode_invoices(spark.createDataFrame(rows, "id int, invoice_json string")).collect()}
    assert [i for i in got if got[i]._corrupt is not None] == [2, 3, 4]
    assert got[1].invoice.positions[0].tax == "General19" and got[6].invoice.positions[0].legacy_rate == 16


def test_rate_of_minus_hundred_does_not_stop_the_job(spark):
    df = spark.createDataFrame([(1000, -100), (1000, -150), (11900, 19), (-11900, 19), (10700, 7)], "s long, r int")
    assert [r[0] for r in df.select(TX.included_tax_cents("s", "r")).collect()] == [None, None, 1900, -1900, 700]


def test_country_of_recipients_that_end_in_empty_lines(spark):
    texts = ["N\nS\nD-1 X", "N\nS\nD-1 X\n", "N\nS\nD-1 X\n\n", "", "N\n \tCH -1"]
    df = spark.createDataFrame([(i, (t,)) for i, t in enumerate(texts)], "i int, inv struct<recipient:string>")
    got = [r[1] for r in df.select("i", ST.invoice_country(F.col("inv"), F.lit("Z"))).orderBy("i").collect()]
    assert got == ["D", "D", "Z", "Z", "CH"]


def test_phrases_stay_within_a_field(spark):
    from innkeep.functions.text import leaf_tokens
    c = customers_df(spark, [(1, "k", customer_doc(given="Max"))]).withColumn("tokens", leaf_tokens("data"))
    hits = {q: S.search_text(c, q).count() for q in ('"herr max"', '"geehrter herr"', "herr max", "max -herr")}
    assert hits == {'"herr max"': 0, '"geehrter herr"': 1, "herr max": 1, "max -herr": 0}


def test_interleaved_pages_are_an_error(spark):
    def pos(*p):
        return spark.createDataFrame([(x,) for x in p], "position int")
    assert S.append_pages(pos(0, 1), pos(2, 3)).count() == 4
    assert S.append_pages(pos(0, 1), pos()).count() == 2
    with pytest.raises(Exception, match="Overlapping"):
        S.append_pages(pos(0, 2), pos(1, 3)).collect()


def test_keyset_pages_follow_each_other(spark):
    df = spark.range(1000).select(F.col("id"), (F.lit("2020-01-01").cast("timestamp_ntz")
                                               + F.make_interval(mins=F.col("id") % 90)).alias("modified"))
    got, last = [], (None, None)
    while rows := S.page_after(df, *last, size=300).collect():
        got += [r.id for r in rows]
        last = (rows[-1].modified, rows[-1].id)
    assert got == [r.id for r in df.orderBy(F.col("modified").desc(), "id").collect()]


def test_letters_escape_markup(spark):
    df = spark.createDataFrame([('A & B <x> "q"',)], "t string")
    assert df.select(EX.escape_html("t")).first()[0] == "A &amp; B &lt;x&gt; &quot;q&quot;"


def test_touches_compact_to_one_row_per_customer(spark, tmp_path):
    rows = [(1, 0, 5), (1, 1, 7), (2, 1, 3)]
    spark.createDataFrame(rows, "customer int, batch int, touched int").write.partitionBy("batch").parquet(str(tmp_path / "t"))
    got = CH.compact_touches(spark, str(tmp_path / "t"), str(tmp_path / "c")).collect()
    assert sorted((r.customer, r.touched) for r in got) == [(1, 7), (2, 3)]


def test_backup_object_of_the_application(spark, tmp_path):
    from innkeep.sources import documents as DOC
    text = """{"customers":[{"id":4,"created":"2020-01-01T00:00:00","modified":"2020-01-02T00:00:00","data":{
      "name":{"title":"","letter":"","given":"G","family":"F"},"company":{"name":"","address":""},
      "address":{"street_with_num":"","postal_code":"","city":"","country":"","country_code":"D"},
      "contact":{"phone":"","phone2":"","mobile":"","fax":"","fax2":"","mail":"","mail2":"","web":""},
      "keyword":"k","note":""}},{"id":5,"data":{"keyword":"x"}}],
     "bookings":[{"id":1,"customer":4,"created":"2020-01-01T00:00:00","modified":"2020-01-02T00:00:00","data":{
      "period":["2020-02-05","2020-02-01"],"deposit_asked":12.34,"deposit_got":null,"tax_free":false,"note":"n",
      "guests":[{"given":"g","family":"f","born":null}],"allocs":[{"room":"7","price_per_bed":45.0,"beds":2,"description":"d"}],
      "invoice":{"id":null,"recipient":"r","date":"2020-02-05","title":"t","intro":"i",
       "positions":[{"quantity":1,"description":"d","price":1.5,"tax":["Legacy",16]},
                    {"quantity":1,"description":"d","price":1.5,"tax":7}],"closing":"c","deposit":0.0}}},
      {"id":2,"customer":4,"data":{"period":["2020-02-05"],"tax_free":false,"note":"","guests":[],"allocs":[]}}]}"""
    (tmp_path / "b.json").write_text(text, encoding="utf-8")
    c, b = DOC.read_backup(spark, str(tmp_path / "b.json"))
    c, b = {r.id: r for r in c.collect()}, {r.id: r for r in b.collect()}
    assert c[4].data.address.country_code == "D" and c[4]._corrupt is None and '"x"' in c[5]._corrupt
    d = b[1].data
    assert (str(d.period.a), str(d.period.b), d.deposit_asked, d.deposit_got) == ("2020-02-05", "2020-02-01", 1234, None)
    assert d.allocs[0].price_per_bed == 4500 and str(d.invoice.invoice_date) == "2020-02-05"
    assert [(p.tax, p.legacy_rate) for p in d.invoice.positions] == [("Legacy", 16), ("Reduced7", None)]
    assert b[2].data is None and "2020-02-05" in b[2]._corrupt


def test_single_table_array(spark, tmp_path):
    from innkeep.sources import documents as DOC
    (tmp_path / "s.json").write_text('[{"customer_id":3,"created":null,"modified":null,"data":{"keyword":"k","bookings":['
                                     '{"period":["2020-01-01","2020-01-03"],"tax_free":true,"note":"","guests":[],"allocs":[]}]}}]')
    c, b = DOC.read_single_table(spark, str(tmp_path / "s.json"))
    assert (c.first().id, b.first().id, b.first().customer, b.first().data.tax_free) == (3, -1, 3, True)


def test_session_starts_without_any_configured_folder(tmp_path):
    code = ("from innkeep.session import get_session, ensure_checkpoint_dir\n"
            "s = get_session(master='local[1]')\nprint(bool(ensure_checkpoint_dir(s)), s.range(3).checkpoint().count())")
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "True 3" in out.stdout, out.stderr[-2000:]


def test_money_that_is_no_number_makes_a_document_corrupt(spark):
    from innkeep.sources import documents as DOC
    head = '{"period":["2020-01-01","2020-01-03"],"tax_free":false,"note":"","guests":[],"allocs":[]'
    cases = {'"deposit_asked":"abc"': None, '"deposit_got":"12"': None, '"deposit_asked":true': None, '"deposit_got":{}': None,
             '"deposit_asked":null': (None, None), '"deposit_asked":12.5,"deposit_got":3': (1250, 300), '"x":1': (None, None)}
    df = spark.createDataFrame([(i, head + "," + c + "}") for i, c in enumerate(cases)], "id long, data string")
    rows = sorted(DOC.decode_rows(df, "bookings").collect(), key=lambda r: r.id)
    got = [None if r.data is None else (r.data.deposit_asked, r.data.deposit_got) for r in rows]
    assert got == list(cases.values())
    assert [r._corrupt is None for r in rows] == [c is not None for c in cases.values()]
