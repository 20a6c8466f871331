"""Figures of the fixture mapping at sf0.01, as prototyped independently in FIXTURES.md."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_february_1997_totals(spark):
    total = [r for r in E.queries()["a1_month_country_stats"](spark, SF).collect()
             if r.country is None][0]
    assert (total.arrivals, total.nights, total.carry) == (117, 613, 38)


def test_guest_figures(spark):
    a5 = E.queries()["a5_booking_summary"](spark, SF)
    r = a5.where("guests > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("guests").alias("g"),
                                   F.sum("tax_payers").alias("t")).first()
    assert (r.n, r.g, r.t) == (12000, 30000, 25748)


def test_all_months_figures(spark):
    a2 = E.queries()["a2_all_months_stats"](spark, SF)
    r = a2.agg(F.countDistinct("month").alias("m"), F.sum("nights").alias("n")).first()
    assert (r.m, r.n) == (80, 60438)


def test_guests_born_at_cutoff(spark):
    from innkeep.sources.fixtures import load_model
    m = load_model(spark, SF)
    g = m.bookings.select("departure", F.explode("data.guests").alias("g"))
    assert g.where(F.col("g.born") == F.add_months("departure", -180)).count() == 252


def test_all_months_nights_equal_guest_nights(spark):
    from innkeep.sources.fixtures import load_model
    m = load_model(spark, SF)
    invoiced = m.bookings.where(F.col("data.invoice").isNotNull())
    direct = invoiced.agg(F.sum(F.size("data.guests") * F.datediff("departure", "arrival"))
                          .alias("s")).first().s
    months = E.queries()["a2_all_months_stats"](spark, SF).agg(F.sum("nights").alias("s")).first().s
    assert direct == months


def test_split_parts_sum_to_gross(spark):
    from innkeep.functions import taxes as TX
    from innkeep.sources.fixtures import load_model
    m = load_model(spark, SF)
    pos = m.bookings.where(F.col("data.invoice").isNotNull()) \
        .select(F.explode("data.invoice.positions").alias("p"))
    parts = pos.select((F.col("p.quantity").cast("bigint") * F.col("p.price")).alias("gross"),
                       F.aggregate(TX.tax_parts(F.col("p")), F.lit(0).cast("bigint"),
                                   lambda acc, x: acc + x["gross"]).alias("parts"))
    assert parts.where(F.col("gross") != F.col("parts")).count() == 0
