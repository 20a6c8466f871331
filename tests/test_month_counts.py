"""Month statistics by sweep and by signed changes against the full count."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from innkeep.operators import stats
from helpers import booking_doc, bookings_df, customer_doc, customers_df

INVOICE = ("1", "Name", dt.date(2020, 1, 1), dt.date(2020, 1, 1), "", "", [], "", None)


def _bookings(spark, rnd, ids):
    rows = []
    for i in ids:
        a = dt.date(2019, 11, 1) + dt.timedelta(days=rnd.choice([rnd.randint(0, 150), 30, 61, 92]))
        b = a + dt.timedelta(days=rnd.choice([0, 0, 1, 2, 5, 28, 31, 59, 400, 1200]))
        guests = [("g", "f", None)] * rnd.randint(0, 3)
        invoice = None if i % 9 == 0 else (*INVOICE[:1], rnd.choice(["", "A\nB-1 X", "A\nx"]), *INVOICE[2:])
        rows.append((i, i % 4, booking_doc(a.isoformat(), b.isoformat(), guests, invoice=invoice)))
    return bookings_df(spark, rows)


@pytest.fixture(scope="module")
def customers(spark):
    return customers_df(spark, [(i, f"k{i}", customer_doc(code=code)) for i, code in enumerate(["D", "CH", None, ""])])


def _rows(df):
    return sorted((tuple(r) for r in df.select("month", "country", "arrivals", "nights", "carry").collect()), key=str)


def test_sweep_equals_the_count_by_month(spark, customers):
    b = _bookings(spark, random.Random(1), range(300))
    want = _rows(stats.all_months_stats(b, customers))
    assert _rows(stats.all_months_sweep(b, customers)) == want and len(want) > 60
    assert {r[1] for r in want} >= {"D", "CH", None, "", "B"}


def test_sweep_makes_two_rows_per_stay(spark, customers):
    """The expansion does not depend on the length of a stay: no sequence of months per stay."""
    b = _bookings(spark, random.Random(2), range(3))
    plan = stats.all_months_sweep(b, customers)._jdf.queryExecution().optimizedPlan().toString()
    generates = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(generates) >= 2
    assert [g for g in generates if "sequence" in g and "arrival" in g] == []       # the calendar's own only


def test_changes_equal_counting_again(spark, customers):
    """Inserts, moves and deletes in three batches; the last one removes every stay of a month."""
    rnd = random.Random(3)
    current = _bookings(spark, rnd, range(120))
    stored = stats.month_counts(current, customers).checkpoint()
    for lo, hi in ((0, 30), (100, 160), (20, 160)):
        inside = F.col("id").between(lo, hi - 1)
        old, kept = current.where(inside), current.where(~inside)
        new = _bookings(spark, rnd, range(lo, hi)) if hi < 160 or lo == 100 else current.limit(0)
        stored = stats.add_counts(stored, stats.month_count_changes(old, new, customers)).checkpoint()
        current = kept.unionByName(new).checkpoint()
        assert _rows(stored) == _rows(stats.all_months_stats(current, customers))
    everything = stats.add_counts(stored, stats.month_count_changes(current, current.limit(0), customers))
    assert everything.collect() == []


def test_a_customer_who_moves(spark, customers):
    b = _bookings(spark, random.Random(4), range(60))
    moved = customers_df(spark, [(0, "k0", customer_doc(code="F"))]).unionByName(customers.where("id <> 0"))
    stored = stats.month_counts(b, customers)
    mine = b.where("customer = 0")
    got = stats.add_counts(stored, stats.month_count_changes(mine, mine, customers, moved))
    assert _rows(got) == _rows(stats.all_months_stats(b, moved))
