"""Month statistics by country (arrivals and guest-nights of invoiced stays).

Per booking with n guests and a month [start, end]:

    arrivals = arrival < start ? 0 : n
    nights   = n * max(0, min(departure, end + 1) - max(arrival, start))
    carry    = n * max(0, departure - max(arrival, start, end + 1))

a closed form of the day-by-day count (nights before the month are dropped,
nights after it are carried over).  Only bookings with an invoice count; the
country comes from the invoice recipient's last line (text before the first
dash) or else the customer's country code.

Scale: one filter pushed to the scan, one join to customers (broadcast only
when AQE measures the side small), and an aggregate with partial
(map-side) sums, so a country holding a third of all rows costs one partial row
per partition in the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innkeep.functions import guests as G
from innkeep.functions.periods import local_date
from innkeep.functions.util import let, spread
from innkeep.operators import stays


def _recipient_lines(invoice: Column) -> Column:
    """Lines of the recipient (one newline at the very end and ``\r`` do not make lines)."""
    return F.split(F.regexp_replace(invoice["recipient"], r"\r?\n\z", ""), r"\r?\n")


def _has_lines(invoice: Column) -> Column:
    return F.coalesce(invoice["recipient"], F.lit("")) != ""


def _country(lines: Column, has_lines: Column, customer_code: Column) -> Column:
    last = F.element_at(lines, -1)
    raw = F.when(F.instr(last, "-") > 0, F.substring_index(last, "-", 1)).otherwise(customer_code)
    return F.when(has_lines, F.btrim(raw, F.lit(" \t\n\r\x0c"))).otherwise(customer_code)


def invoice_country(invoice: Column, customer_code: Column) -> Column:
    """Country of a statistics row: text before the first dash of the recipient's
    last line (trimmed), else the customer's code."""
    return let(_recipient_lines(invoice),
               lambda lines: _country(lines, _has_lines(invoice), customer_code))


def invoice_facts(invoice: Column, customer_keyword: Column, customer_code: Column) -> Column:
    """STRUCT<invoice_no, invoice_date, name, country> of a statistics row.

    Lines of the recipient are split on newlines once per row; no invoice or an
    empty recipient falls back to the customer's keyword and code.
    """
    has_lines = _has_lines(invoice)

    def facts(lines):
        return F.struct(
            F.when(has_lines, F.coalesce(invoice["id"], F.lit(""))).otherwise(F.lit(""))
            .alias("invoice_no"),
            F.when(has_lines, F.coalesce(local_date(invoice["invoice_date"]), F.lit("")))
            .otherwise(F.lit("")).alias("invoice_date"),
            F.when(has_lines, F.element_at(lines, 1)).otherwise(customer_keyword).alias("name"),
            _country(lines, has_lines, customer_code).alias("country"),
        )

    return let(_recipient_lines(invoice), facts)


def _counts(n: Column, start: Column, end: Column) -> list[Column]:
    a, d = F.col("arrival"), F.col("departure")
    after = F.date_add(end, 1)
    arrivals = F.when(a < start, F.lit(0)).otherwise(n)
    nights = n * F.greatest(F.lit(0), F.datediff(F.least(d, after), F.greatest(a, start)))
    carry = n * F.greatest(F.lit(0), F.datediff(d, F.greatest(a, start, after)))
    return [arrivals.alias("arrivals"), nights.alias("nights"), carry.alias("carry")]


def statistics_rows(bookings: DataFrame, customers: DataFrame, month,
                    max_nights: int | None = None) -> DataFrame:
    """Per invoiced booking overlapping the month: facts and counts."""
    start, end = stays.month_bounds(month)
    b = stays.has_invoice(stays.overlapping(bookings, start, end, max_nights))
    b = b.select("id", "customer", "arrival", "departure",
                 F.col("data.invoice").alias("invoice"),
                 G.guest_count("data.guests").alias("n_guests"))
    c = customers.select(F.col("id").alias("customer"), F.col("keyword").alias("ckw"),
                         F.col("data.address.country_code").alias("ccode"))
    j = b.join(c, "customer", "inner")
    facts = invoice_facts(F.col("invoice"), F.col("ckw"), F.col("ccode"))
    return j.select("id", "customer", "arrival", "departure", spread(facts),
                    *_counts(F.col("n_guests"), F.lit(start), F.lit(end))) \
            .select("id", "customer", "invoice_no", "invoice_date", "name", "country",
                    "arrival", "departure", "arrivals", "nights", "carry")


def month_stats(bookings: DataFrame, customers: DataFrame, month, with_total: bool = True,
                max_nights: int | None = None) -> DataFrame:
    """Country summary of one month; ``with_total`` adds the grand-total row
    (country null) and the flag ``is_total``, which tells it from stays without a
    country; the rows are aggregated by country first.  Only the country of
    each row is derived."""
    start, end = stays.month_bounds(month)
    b = stays.has_invoice(stays.overlapping(bookings, start, end, max_nights))
    b = b.select("customer", "arrival", "departure", F.col("data.invoice").alias("invoice"),
                 G.guest_count("data.guests").alias("n_guests"))
    c = customers.select(F.col("id").alias("customer"),
                         F.col("data.address.country_code").alias("ccode"))
    rows = b.join(c, "customer", "inner").select(
        invoice_country(F.col("invoice"), F.col("ccode")).alias("country"),
        *_counts(F.col("n_guests"), F.lit(start), F.lit(end)))
    aggs = [F.sum("arrivals").cast("bigint").alias("arrivals"),
            F.sum("nights").cast("bigint").alias("nights"),
            F.sum("carry").cast("bigint").alias("carry")]
    by_country = rows.groupBy("country").agg(*aggs)
    if not with_total:
        return by_country
    # the total is the sum of the (few) country rows, not a second pass over the stays
    return _with_total(by_country)


def _with_total(by_country: DataFrame) -> DataFrame:
    """Country rows and their grand total (``rollup`` over the aggregated rows)."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("arrivals", "nights", "carry")]
    return by_country.rollup("country").agg(*sums, (F.grouping("country") == 1).alias("is_total"))


def _stays_with_country(bookings: DataFrame, customers: DataFrame) -> DataFrame:
    """(arrival, departure, n_guests, country) of each invoiced stay."""
    b = stays.has_invoice(bookings).select(
        "id", "customer", "arrival", "departure", F.col("data.invoice").alias("invoice"),
        G.guest_count("data.guests").alias("n_guests"))
    c = customers.select(F.col("id").alias("customer"),
                         F.col("data.address.country_code").alias("ccode"))
    # the country is fixed per booking: join and derive it before anything is expanded
    return b.join(c, "customer", "inner").select(
        "arrival", "departure", "n_guests",
        invoice_country(F.col("invoice"), F.col("ccode")).alias("country"))


_SUMS = ("arrivals", "nights", "carry")


def month_counts(bookings: DataFrame, customers: DataFrame) -> DataFrame:
    """``all_months_stats`` with the number of ``stays`` behind each row."""
    j = _stays_with_country(bookings, customers)
    a, d = F.col("arrival"), F.col("departure")
    first = F.trunc(a, "MM")
    months = (F.when(d > a, F.sequence(first, F.trunc(F.date_sub(d, 1), "MM"),
                                       F.expr("INTERVAL 1 MONTH")))
              .when(F.dayofmonth(a) != 1, F.array(first))
              .otherwise(F.array_repeat(first, 0)))
    per_month = j.select("*", F.explode(months).alias("month"))
    start = F.col("month")
    end = F.last_day(start)
    rows = per_month.select("month", "country", *_counts(F.col("n_guests"), start, end))
    return rows.groupBy("month", "country").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in _SUMS], F.count("*").alias("stays"))


def all_months_stats(bookings: DataFrame, customers: DataFrame) -> DataFrame:
    """The month summary for every month at once.

    Each invoiced booking is expanded to the months it overlaps under the same
    predicate as the one-month query (``arrival <= end AND departure > start``):
    the months of its nights, or for a zero-night stay its arrival month unless
    it arrives on the 1st.  The expansion is bounded by the stay length.
    """
    return month_counts(bookings, customers).drop("stays")


def month_count_changes(old: DataFrame, new: DataFrame, customers: DataFrame,
                        new_customers: DataFrame | None = None) -> DataFrame:
    """What replacing the bookings ``old`` by ``new`` changes in ``month_counts``: signed counts.

    An insert is in ``new`` only, a delete in ``old`` only, a changed stay in both.  Only the rows of
    the batch and their customers are read.  ``new_customers`` where customers change as well (the old and new
    bookings of a customer whose country changes belong to the batch).
    """
    minus = month_counts(old, customers)
    plus = month_counts(new, new_customers or customers)
    names = [*_SUMS, "stays"]
    return (minus.select("month", "country", *[(-F.col(c)).alias(c) for c in names]).unionByName(plus)
            .groupBy("month", "country").agg(*[F.sum(c).cast("bigint").alias(c) for c in names]))


def add_counts(stored: DataFrame, *changes: DataFrame) -> DataFrame:
    """Stored ``month_counts`` with changes merged in: equal to counting again.  A row goes with its last stay."""
    every = stored
    for c in changes:
        every = every.unionByName(c)
    return (every.groupBy("month", "country").agg(*[F.sum(c).cast("bigint").alias(c) for c in (*_SUMS, "stays")])
            .where(F.col("stays") > 0))


def all_months_sweep(bookings: DataFrame, customers: DataFrame) -> DataFrame:
    """``all_months_stats`` from arrivals and departures alone: two rows per stay, however long it is.

    A stay counts in the month of its arrival and in that of its last night; what lies between follows from
    running sums over each country's months: the guests who came earlier and are still there spend all
    nights of a month, and those who stay on carry their remaining nights over.  The stays are summed up
    per country and month before anything is ordered, so the running sums go over a calendar's rows, not a
    country's stays.
    """
    a, d, n = F.col("arrival"), F.col("departure"), F.col("n_guests").cast("bigint")
    j = _stays_with_country(bookings, customers).where((d > a) | (F.dayofmonth(a) != 1))
    last_night = F.when(d > a, F.date_sub(d, 1)).otherwise(a)
    left = n * F.unix_date(d)
    event = lambda day, sign: F.struct(
        F.trunc(day, "MM").alias("month"), F.lit(sign).alias("sign"),
        (n * (F.datediff(F.last_day(day), a if sign > 0 else d) + 1)).alias("part"))
    events = j.select("country", n.alias("n"), left.alias("left"),
                      F.explode(F.array(event(a, 1), event(last_night, -1))).alias("e")).select("country", "n", "left", "e.*")
    came, went = F.col("sign") > 0, F.col("sign") < 0
    zero = F.lit(0).cast("bigint")
    sums = events.groupBy("country", "month").agg(
        *[F.sum(F.when(side, x).otherwise(zero)).alias(f"{name}_{what}")
          for side, name in ((came, "in"), (went, "out"))
          for x, what in ((F.col("n"), "n"), (F.col("left"), "left"), (F.lit(1), "stays"))],
        F.sum(F.col("sign") * F.col("part")).alias("part"))
    names = sums.columns[2:]
    between = sums.groupBy("country").agg(F.min("month").alias("x"), F.max("month").alias("y")).select(
        "country", F.explode(F.sequence("x", "y", F.expr("INTERVAL 1 MONTH"))).alias("month"), *[zero.alias(c) for c in names])
    calendar = sums.unionByName(between).groupBy("country", "month").agg(*[F.sum(c).alias(c) for c in names])
    so_far = Window.partitionBy("country").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    run = {c: F.sum(c).over(so_far) for c in names if c != "part"}
    end = F.date_add(F.last_day("month"), 1)
    days = F.dayofmonth(F.last_day("month"))
    on = calendar.select(
        "month", "country", F.col("in_n").alias("arrivals"),
        ((run["in_n"] - F.col("in_n") - run["out_n"] + F.col("out_n")) * days + F.col("part")).alias("nights"),
        (run["in_left"] - run["out_left"] - (run["in_n"] - run["out_n"]) * F.unix_date(end)).alias("carry"),
        (run["in_stays"] - run["out_stays"] + F.col("out_stays")).alias("stays"))
    return on.where("stays > 0").select("month", "country", *[F.col(c).cast("bigint").alias(c) for c in _SUMS])
