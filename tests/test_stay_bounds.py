"""The longest stay kept with the tables, and the flag of the total row."""

import tempfile

from innkeep import cli
from innkeep.api import Lodging
from innkeep.operators import stats
from innkeep.sources import tables
from tests.helpers import booking_doc, bookings_df, customer_doc, customers_df


def test_date_filters_prune_years_by_the_stored_bound(spark):
    path = tempfile.mkdtemp(prefix="stay-bounds-") + "/t"
    guests = [("a", "b", None)]
    cust = customers_df(spark, [(1, "muster", customer_doc())])
    book = bookings_df(spark, [(k, 1, booking_doc(f"{year}-02-10", f"{year}-02-13", guests))
                               for k, year in enumerate(range(2015, 2022))])
    assert tables.longest_stay(spark, path) is None
    Lodging(cust, book).save(path)
    lodging = Lodging.open(spark, path)
    assert lodging.max_nights == 3

    def years(df):
        return sorted({f.partition("arrival_year=")[2][:4] for f in df.inputFiles()})
    # the scan of a stored table lists the years that its filters leave
    seen = lodging.overlapping("2020-02-01", "2020-02-29")
    assert [r.arrival.year for r in seen.collect()] == [2020]
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "arrival_year" in plan and "2020" in plan.partition("PartitionFilters")[2].partition("]")[0]
    assert len(years(lodging.bookings)) == 7

    # a longer stay in an appended batch widens the bound before its rows can be read
    long = bookings_df(spark, [(90, 1, booking_doc("2016-01-01", "2020-02-05", guests))])
    tables.append_bookings(long, path)
    again = Lodging.open(spark, path)
    assert again.max_nights == 1496
    assert sorted(r.id for r in again.overlapping("2020-02-01", "2020-02-29").collect()) == [5, 90]
    assert 90 in {r.id for r in again.agenda("2020-02-01").collect()}

    # written anew without it, the bound falls again; an empty table has bound 0
    fresh = path + "2"
    Lodging(cust, book.where("id < 3")).save(fresh)
    Lodging(cust, book.where("id < 0")).save(path)
    assert (tables.longest_stay(spark, fresh), tables.longest_stay(spark, path)) == (3, 0)


def test_jobs_use_the_stored_bound(spark):
    root = tempfile.mkdtemp(prefix="stay-bounds-cli-")
    cust = customers_df(spark, [(1, "muster", customer_doc())])
    book = bookings_df(spark, [(1, 1, booking_doc("2019-12-30", "2020-01-02", [("a", "b", None)])),
                               (2, 1, booking_doc("2018-12-30", "2019-01-02", [("a", "b", None)]))])
    tables.write_tables(cust, book, f"{root}/t")
    args = type("Args", (), {"cmd": "agenda", "tables": f"{root}/t", "day": "2020-01-01", "out": f"{root}/agenda"})
    cli.run(spark, args)
    assert [r.id for r in spark.read.parquet(f"{root}/agenda").collect()] == [1]


def test_total_row_is_told_from_stays_without_a_country(spark):
    rows = spark.createDataFrame([("D", 1, 2, 3), (None, 4, 5, 6)], "country string, arrivals long, nights long, carry long")
    got = {(r.country, r.is_total): (r.arrivals, r.nights, r.carry) for r in stats._with_total(rows).collect()}
    assert got == {("D", False): (1, 2, 3), (None, False): (4, 5, 6), (None, True): (5, 7, 9)}
