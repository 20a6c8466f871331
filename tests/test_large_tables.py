"""Jobs whose cost has to grow no faster than the tables."""

import os

from pyspark.sql import functions as F

from innkeep.operators import exports as EX
from innkeep.operators import invoices as INV
from innkeep.operators import quality as Q
from innkeep.plans import q_migration as QM
from innkeep.sources import documents as DOC
from innkeep.sources import fixtures, ranges, tables
from tests.helpers import booking_doc, bookings_df, customer_doc, customers_df


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _bookings(spark):
    return bookings_df(spark, [(i, 1, booking_doc(f"20{20 + i % 2}-01-0{i % 7 + 1}", "2022-01-01")) for i in range(1, 20)])


def test_documents_are_built_behind_the_layout(spark, tmp_path):
    """Slim rows are shuffled and sorted, their documents come after that."""
    b = _bookings(spark)
    seen = []

    def document(rows):
        seen.append(rows.columns)
        return rows.join(F.broadcast(b.select("id", "customer", "departure", "data")), "id")
    tables.write_bookings(b.select("id", "arrival"), str(tmp_path / "b"), document)
    assert seen == [["id", "arrival", "arrival_year"]]
    back = spark.read.parquet(str(tmp_path / "b"))
    assert sorted(map(str, back.select(*b.columns[:2], "data").collect())) == sorted(map(str, b.select(*b.columns[:2], "data").collect()))


def test_model_rows_hold_no_documents(spark, tmp_path):
    """Guests, notes, invoices and whole customers are no part of what is shuffled."""
    stamp = F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00"))
    one = spark.range(8).select(F.col("id").alias("o_orderkey"), (F.col("id") % 3).alias("o_custkey"),
                                F.lit("F").alias("o_orderstatus"), stamp.alias("o_orderdate"))
    one.write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(20).selectExpr("id % 7 l_orderkey", "id l_partkey", "id l_suppkey", "cast(id % 4 as int) l_linenumber",
                               "cast(id as double) l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    c = customers_df(spark, [(0, "a", customer_doc()), (1, "b", customer_doc())])
    rows = fixtures.booking_rows(spark, str(tmp_path), c)
    assert not {"data", "guests", "note", "invoice", "cdata"} & set(rows.columns)
    out = {r.id: r for r in fixtures.booking_documents(rows).collect()}
    assert len(out) == 8 and out[7].data.allocs == [] and len(out[3].data.allocs) == 3
    assert out[3].data.invoice.recipient == "Max Muster\nAm Weg 1\nD-12345 Musterstadt"
    assert out[2].data.invoice.recipient == "null null\nnull-null null"       # no such customer


def test_the_legacy_export_is_not_shuffled_again(spark, monkeypatch):
    """the wide rows of the export are written where their join leaves them."""
    model = fixtures.Model(customers_df(spark, [(1, "a", customer_doc())]), _bookings(spark), None)
    written = []
    monkeypatch.setattr(QM, "load_model", lambda *a: model)
    monkeypatch.setattr(QM, "model_location", lambda *a: "none")
    monkeypatch.setattr(QM, "publish_once", lambda s, path, write: write(path))
    monkeypatch.setattr(QM.LG, "write_legacy_csv", lambda df, p: written.append(df))
    monkeypatch.setattr(QM.LG, "read_legacy_csv", lambda *a: None)
    QM.legacy_export(spark, "none")
    assert "Repartition" not in _plan(written[0]) and written[0].count() == 19


def test_heads_and_records_share_a_pass(spark, tmp_path, monkeypatch):
    """One pass finds the first records and all fragments."""
    kept, stable = [], ranges.stable
    monkeypatch.setattr(ranges, "stable", lambda df: kept.append(1) or stable(df))
    for name, text in (("a", 'x,"y\r\nz"\r\n1,2\r\n'), ("b", '\r\n3,"4\r\n\r\n5"\r\n'), ("c", 'x,"y\r\nz"')):
        (tmp_path / name).write_bytes(text.encode())
    heads, records = ranges.csv_records(spark, str(tmp_path))
    assert len(kept) == 1
    assert heads == ['x,"y\nz"']
    assert sorted(r.text for r in records.collect()) == ["1,2", '3,"4\n\n5"']


def test_digests_do_not_list_leaves(spark):
    """a document's digest is that of its JSON text, to the last digit of its times."""
    df = spark.sql("SELECT 1 AS id, named_struct('t', timestamp_ntz'2020-01-01 00:00:00.000001', 'l', array(1, 2)) AS data")
    assert "transform" not in _plan(df.select(Q.document_digest(F.col("data"))))
    later = df.withColumn("data", F.col("data").withField("t", F.expr("timestamp_ntz'2020-01-01 00:00:00.000002'")))
    assert [tuple(r) for r in Q.changed_documents(df, later).collect()] == [(1, "changed", ["t"])]
    assert Q.changed_documents(df, df).count() == 0


def test_xml_files_are_bounded(spark, tmp_path):
    """a file, which one task reads, holds a bounded number of records."""
    forms = spark.range(10).selectExpr("id", "'x' AS name").coalesce(1)
    EX.write_registration_xml(forms, str(tmp_path / "x"), keep_id=True, rows_per_file=4)
    assert sum(n.startswith("part-") for n in os.listdir(tmp_path / "x")) == 3
    back = spark.read.format("xml").option("rowTag", "meldeschein").schema("id long").load(str(tmp_path / "x"))
    assert sorted(r.id for r in back.collect()) == list(range(10))


def test_invoices_are_decoded_once(spark):
    """the check of a booking document and the document share what was decoded."""
    df = spark.createDataFrame([("{}",)], "data string")
    twice = _plan(df.select(DOC.decode_booking("data"))).count("positions")
    once = _plan(df.select(INV.decode_invoice(F.col("data")))).count("positions")
    assert twice == once
