"""A customer holding a third of all bookings: results stay exact and the hot
group is split across tasks."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from innkeep.operators import stats, stays
from tests.helpers import booking_doc, bookings_df, customer_doc, customers_df


def _skewed(spark, n=600):
    inv = (None, "A\nB\nC-1 X", None, None, "", "", [], "", 0)
    rows = []
    for i in range(n):
        cust = 0 if i % 3 == 0 else 1 + i % 40
        a = dt.date(2020, 1, 1) + dt.timedelta(days=i % 90)
        b = a + dt.timedelta(days=i % 7)
        rows.append((i, cust, booking_doc(a.isoformat(), b.isoformat(), [("g", "f", None)] * (i % 3),
                                          invoice=inv if i % 2 else None)))
    custs = customers_df(spark, [(c, f"k{c}", customer_doc()) for c in range(0, 41)])
    return custs, bookings_df(spark, rows)


def test_hot_customer_embed_positions_and_split(spark):
    custs, book = _skewed(spark)
    got = {(r.id, r.booking): r.position for r in stays.embedded_bookings(custs, book).collect()}
    w = Window.partitionBy("customer").orderBy(F.desc("arrival"), F.desc("departure"), F.desc("id"))
    ref = book.withColumn("p", F.row_number().over(w) - 1)
    assert {(r.customer, r.id): r.p for r in ref.collect()} == got
    # range partitioning on (customer, sort keys) spreads the hot customer
    ranged = book.select("customer", "arrival", "departure", "id") \
        .repartitionByRange(8, "customer", F.desc("arrival"), F.desc("departure"), F.desc("id"))
    parts = ranged.where("customer = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 2


def test_hot_customer_aggregates(spark):
    custs, book = _skewed(spark)
    last = {r.customer: (r.last_from, r.last_till, r.last_booking)
            for r in stays.last_stays(book).collect()}
    ref = {}
    for r in book.select("customer", "arrival", "departure", "id").collect():
        ref[r.customer] = max(ref.get(r.customer, (r.arrival, r.departure, r.id)),
                              (r.arrival, r.departure, r.id))
    assert last == ref
    s = {r.country: r for r in stats.month_stats(book, custs, "2020-02-01").collect()}
    rows = stats.statistics_rows(book, custs, "2020-02-01").collect()
    assert s[None].nights == sum(r.nights for r in rows)
    assert s[None].arrivals == sum(r.arrivals for r in rows)
