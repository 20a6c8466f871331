"""Texts of every letter and booking are put together without parsing a format for each value."""

from pyspark.sql import functions as F

from innkeep.functions import money as M
from innkeep.functions.util import printed
from innkeep.operators import exports as EX
from innkeep.operators import invoices as INV
from innkeep import schemas


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_amounts_and_letters_parse_no_format(spark):
    bookings = spark.createDataFrame([], "id long, data struct<invoice:%s>" % schemas.INVOICE.simpleString())
    assert "format_string" not in _plan(bookings.select("id", EX.invoice_body("data.invoice"))).lower()


def test_amounts_as_before(spark):
    df = spark.createDataFrame([(0,), (5,), (-150,), (123456789,), (-7,), (None,), (100,)], "c long")
    assert [r[0] for r in df.select(M.format_money("c")).collect()] == [
        "0,00", "0,05", "-1,50", "1234567,89", "-0,07", None, "1,00"]
    old = F.concat(F.format_string("Gast%d", "c"))
    new = F.concat(F.lit("Gast"), printed(F.col("c")))
    assert all(r[0] == r[1] for r in df.select(old, new).collect())


def test_the_tax_of_a_rate_sums_its_parts_once(spark):
    positions = "named_struct('quantity', 2, 'description', 'd', 'price', 5000L, 'tax', 'General19', 'legacy_rate', cast(null as int))"
    df = spark.sql(f"SELECT named_struct('positions', array({positions}, {positions})) AS inv")
    t = df.select(INV.tax_rows(F.col("inv")).alias("t")).first().t
    assert [(x.label, x.rate, x.description, x.tax_cents) for x in t] == [("A", 19, "19%", 3193)]
    rendered = str(INV.tax_rows(F.col("inv")))
    assert rendered.count("aggregate(") == 1
