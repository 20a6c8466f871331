"""Stay queries over bookings: generated columns, date filters, embeds, agenda.

Filters are plain predicates on the materialised ``arrival``/``departure``
columns so Catalyst pushes them into the Parquet scan; when bookings are
partitioned by ``arrival_year`` an extra, implied bound on that column prunes
whole partitions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.functions import guests as G
from innkeep.functions import periods as P
from innkeep.functions import rooms as R


def _as_date(d) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))


def with_stay_dates(bookings: DataFrame) -> DataFrame:
    """Generated columns: arrival = least(period), departure = greatest(period)."""
    return bookings.withColumn("arrival", P.arrival_of("data.period")) \
                   .withColumn("departure", P.departure_of("data.period"))


def with_keyword(customers: DataFrame) -> DataFrame:
    return customers.withColumn("keyword", F.col("data.keyword"))


def _year_prune(bookings: DataFrame, lo: dt.date | None, hi: dt.date | None) -> DataFrame:
    """Implied bounds on the partition column (no effect on the result)."""
    if "arrival_year" not in bookings.columns:
        return bookings
    out = bookings
    if hi is not None:
        out = out.where(F.col("arrival_year") <= hi.year)
    if lo is not None:
        out = out.where(F.col("arrival_year") >= lo.year)
    return out


def overlapping(bookings: DataFrame, start, end, max_nights: int | None = None) -> DataFrame:
    """Stays overlapping [start, end]: ``arrival <= end AND departure > start``.

    ``max_nights`` (longest stay in the table) adds the implied lower bound
    ``arrival > start - max_nights`` so that old partitions are pruned too.
    """
    s, e = _as_date(start), _as_date(end)
    out = bookings.where((F.col("arrival") <= F.lit(e)) & (F.col("departure") > F.lit(s)))
    lo = None
    if max_nights is not None:
        lo = s - dt.timedelta(days=max_nights)
        out = out.where(F.col("arrival") >= F.lit(lo))
    return _year_prune(out, lo, e)


def in_house(bookings: DataFrame, day, max_nights: int | None = None) -> DataFrame:
    """Stays touching a day, both ends inclusive: ``arrival <= d AND departure >= d``."""
    d = _as_date(day)
    out = bookings.where((F.col("arrival") <= F.lit(d)) & (F.col("departure") >= F.lit(d)))
    lo = None
    if max_nights is not None:
        lo = d - dt.timedelta(days=max_nights)
        out = out.where(F.col("arrival") >= F.lit(lo))
    return _year_prune(out, lo, d)


def lookup(df: DataFrame, key: int) -> DataFrame:
    """rows with the given key."""
    return df.where(F.col("id") == F.lit(key))


def has_invoice(bookings: DataFrame) -> DataFrame:
    """bookings with an invoice.  Uses the stored ``invoiced`` flag when the
    table has it (pushed into the scan, and the invoice struct is not read just
    to test it for null), else the document itself."""
    if "invoiced" in bookings.columns:
        return bookings.where(F.col("invoiced"))
    return bookings.where(F.col("data.invoice").isNotNull())


def with_customer(bookings: DataFrame, customers: DataFrame) -> DataFrame:
    """Booking with its customer (id, keyword, data) as ``customer_*`` columns.

    Inner equi-join on the foreign key; AQE picks broadcast or sort-merge from
    the measured size of the customer side.
    """
    c = customers.select(F.col("id").alias("customer"), F.col("keyword").alias("customer_keyword"),
                         F.col("data").alias("customer_data"))
    return bookings.join(c, "customer", "inner")


def embed_bookings(customers: DataFrame, bookings: DataFrame) -> DataFrame:
    """Customer with its bookings (arrival, departure, id), newest first, as one
    nested list per customer.

    For bounded customer sets (a result page): the list of a customer is
    collected into one row.  For whole tables use ``embedded_bookings``.
    """
    per = (bookings.groupBy(F.col("customer").alias("id"))
           .agg(F.sort_array(F.collect_list(F.struct("arrival", "departure", "id")), asc=False)
                .alias("bookings")))
    empty = F.array_repeat(F.struct(F.lit(None).cast("date").alias("arrival"),
                                    F.lit(None).cast("date").alias("departure"),
                                    F.lit(None).cast("bigint").alias("id")), 0)
    return (customers.join(per, "id", "left")
            .withColumn("bookings", F.coalesce(F.col("bookings"), empty)))


def embedded_bookings(customers: DataFrame, bookings: DataFrame) -> DataFrame:
    """The embed in flat form for whole tables: one row per (customer, booking)
    with the booking's position in the customer's newest-first list and the
    list length; customers without bookings appear once with null booking.

    Positions come from the distributed global index (range partitioning on
    customer and the sort keys), so a customer holding a third of all bookings
    is spread over many tasks instead of one.  List lengths and the check that
    the customer exists act on the table of counts per partition and customer, so
    the bookings are dealt out by range once and joined with that table once.
    """
    from innkeep.operators.ordering import with_global_index
    b = bookings.select(F.col("customer").alias("id"), F.col("id").alias("booking"), "arrival",
                        "departure")
    keyed = b.select("*", F.datediff(F.lit("2100-01-01"), "arrival").alias("_ka"),
                     F.datediff(F.lit("2100-01-01"), "departure").alias("_kd"),
                     (-F.col("booking")).alias("_kb"))
    pos = with_global_index(keyed, ["_ka", "_kd", "_kb"], partition_col="id", index_col="position",
                            total_col="n_bookings", groups=customers.select("id"))
    some = b.select("id").distinct()
    none = (customers.select("id").join(some, "id", "left_anti")
            .select("id", F.lit(0).cast("bigint").alias("n_bookings"),
                    F.lit(None).cast("bigint").alias("position"),
                    F.lit(None).cast("bigint").alias("booking"),
                    F.lit(None).cast("date").alias("arrival"),
                    F.lit(None).cast("date").alias("departure")))
    cols = ["id", "n_bookings", "position", "booking", "arrival", "departure"]
    return pos.select(*cols).unionByName(none.select(*cols))


def last_stays(bookings: DataFrame) -> DataFrame:
    """Last stay per customer: max by (arrival, departure, id).  A plain max
    aggregate: partial per partition, so a customer with a third of all
    bookings costs one row per partition in the shuffle."""
    return (bookings.groupBy("customer")
            .agg(F.max(F.struct("arrival", "departure", "id")).alias("last"))
            .select("customer", F.col("last.arrival").alias("last_from"),
                    F.col("last.departure").alias("last_till"),
                    F.col("last.id").alias("last_booking")))


def merged_last_stays(stored: DataFrame, changes: DataFrame, bookings: DataFrame) -> DataFrame:
    """``stored`` rows of ``last_stays`` after a change batch, equal to computing them again.

    ``changes``: (sign, customer, arrival, departure, id), -1 for a booking as it was (deleted, moved or
    changed), 1 for one as it is now; ``bookings`` are those after the batch.  A new stay only has to be
    compared with the stored one.  Where the stored last stay itself is gone and no new one reaches it, the
    customer's bookings are read again; of no other customer.  A customer without a stay left has
    no row; changes without a customer count for nobody.  A plain max per customer, so a hot
    customer costs one row per partition.
    """
    named = changes.where(F.col("customer").isNotNull())
    stay = F.struct("arrival", "departure", "id")
    came = named.where("sign > 0").groupBy("customer").agg(F.max(stay).alias("came"))
    gone = (named.where("sign < 0").select("customer", F.col("id").alias("last_booking")).distinct()
            .withColumn("gone", F.lit(True)))
    was = F.struct(F.col("last_from").alias("arrival"), F.col("last_till").alias("departure"),
                   F.col("last_booking").alias("id"))
    state = (stored.join(gone, ["customer", "last_booking"], "left").select("customer", was.alias("was"), "gone")
             .join(came, "customer", "full"))
    again = F.col("gone").isNotNull() & (F.col("came").isNull() | (F.col("came") < F.col("was")))
    kept = state.where(~again).select("customer", F.greatest("was", "came").alias("last")).select(
        "customer", F.col("last.arrival").alias("last_from"), F.col("last.departure").alias("last_till"),
        F.col("last.id").alias("last_booking"))
    anew = last_stays(bookings.join(state.where(again).select("customer"), "customer", "left_semi"))
    return kept.unionByName(anew)


def customer_rows(customers: DataFrame, bookings: DataFrame) -> DataFrame:
    """Search-result rows: id, keyword, given, family, company, last stay."""
    last = last_stays(bookings).withColumnRenamed("customer", "id")
    return (customers.select("id", F.col("data.keyword").alias("keyword"),
                             F.col("data.name.given").alias("given"),
                             F.col("data.name.family").alias("family"),
                             F.col("data.company.name").alias("company"), "modified")
            .join(last, "id", "left")
            .select("id", "keyword", "given", "family", "company",
                    F.col("last_from").alias("from_date"), F.col("last_till").alias("till_date"),
                    "modified"))


def agenda(bookings: DataFrame, customers: DataFrame, day, max_nights: int | None = None
           ) -> DataFrame:
    """In-house bookings of a day, split into arrive (checked first) / leave / stay,
    with the card facts (keyword, guests, period text, rooms) and the room sort key."""
    from innkeep.functions.util import let, spread
    d = _as_date(day)
    b = in_house(bookings, d, max_nights)
    kind = (F.when(F.col("arrival") == F.lit(d), F.lit("arrive"))
            .when(F.col("departure") == F.lit(d), F.lit("leave"))
            .otherwise(F.lit("stay")))
    n = G.guest_count("data.guests")
    persons = F.when(n != 1, F.format_string("%d Personen", n)).otherwise(F.lit("1 Person"))

    def facts(rooms):
        rtxt = R.rooms_text(rooms)
        card = F.format_string("%s vom %s %s", persons, P.period_text("arrival", "departure"),
                               F.coalesce(F.concat(F.lit(" in Zimmer "), rtxt), F.lit("")))
        return F.struct(rtxt.alias("rooms"), card.alias("card"), rooms.alias("room_key"))

    out = with_customer(b.select("id", "customer", "data", "arrival", "departure"), customers)
    return out.select("id", "customer", F.col("customer_keyword").alias("keyword"),
                      kind.alias("kind"), n.alias("guests"),
                      spread(let(R.rooms_of("data.allocs"), facts)))


def month_bounds(month) -> tuple[dt.date, dt.date]:
    """First and last day of the month containing ``month``."""
    m = _as_date(month).replace(day=1)
    nxt = (m.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return m, nxt - dt.timedelta(days=1)


def previous_month(today) -> dt.date:
    """Default statistics month: the first of the previous month."""
    t = _as_date(today).replace(day=1)
    return (t - dt.timedelta(days=1)).replace(day=1)


def rebook_template(bookings: DataFrame, today, nights: int = 7) -> DataFrame:
    """A new-booking template per customer from the customer's last booking:
    guests and tax flag copied; allocations, deposits, note and invoice cleared;
    period = today + ``nights`` (7 by default).  The last booking is chosen with a
    partial ``max_by`` aggregate (no per-customer list is collected)."""
    d = _as_date(today)
    last = (bookings.groupBy("customer")
            .agg(F.max_by(F.struct(F.col("data.guests").alias("guests"),
                                   F.col("data.tax_free").alias("tax_free")),
                          F.struct("arrival", "departure", "id")).alias("src")))
    empty_allocs = F.array_repeat(F.struct(F.lit("").alias("room"),
                                           F.lit(0).cast("bigint").alias("price_per_bed"),
                                           F.lit(0).alias("beds"), F.lit("").alias("description")), 0)
    period = F.struct(F.lit(d).alias("a"), F.lit(d + dt.timedelta(days=nights)).alias("b"))
    data = F.struct(period.alias("period"), F.lit(None).cast("bigint").alias("deposit_asked"),
                    F.lit(None).cast("bigint").alias("deposit_got"),
                    F.col("src.tax_free").alias("tax_free"), F.lit("").alias("note"),
                    F.col("src.guests").alias("guests"), empty_allocs.alias("allocs"),
                    F.lit(None).alias("invoice"))
    return last.select("customer", data.alias("data"))
