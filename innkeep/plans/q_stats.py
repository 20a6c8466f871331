"""Statistics queries: A1 (flagship), A2, A3, E15."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from innkeep.operators import stats
from innkeep.plans.catalog import STAT_MONTH, STAT_MONTH_END, register
from innkeep.plans.oracle import stat_rows
from innkeep.session import ensure_checkpoint_dir
from innkeep.sources.fixtures import load_model, model_max_nights

_ROWS = stat_rows(STAT_MONTH, STAT_MONTH_END)


def _model(spark, sf_dir):
    return load_model(spark, sf_dir), model_max_nights(spark, sf_dir)


@register("a1_month_country_stats", _ROWS + """
SELECT country, CAST(sum(arrivals) AS BIGINT) AS arrivals, CAST(sum(nights) AS BIGINT) AS nights,
       CAST(sum(carry) AS BIGINT) AS carry, grouping(country) = 1 AS is_total
FROM scnt GROUP BY ROLLUP (country)
""")
def a1_month_country_stats(spark, sf_dir):
    """A1 + A3: one month's arrivals and guest-nights by country, with total row."""
    m, mx = _model(spark, sf_dir)
    return stats.month_stats(m.bookings, m.customers, STAT_MONTH, with_total=True, max_nights=mx)


@register("a3_month_country_stats_no_total", _ROWS + """
SELECT country, CAST(sum(arrivals) AS BIGINT) AS arrivals, CAST(sum(nights) AS BIGINT) AS nights,
       CAST(sum(carry) AS BIGINT) AS carry
FROM scnt GROUP BY country
""")
def a3_month_country_stats_no_total(spark, sf_dir):
    m, mx = _model(spark, sf_dir)
    return stats.month_stats(m.bookings, m.customers, STAT_MONTH, with_total=False, max_nights=mx)


@register("e15_statistics_rows", _ROWS + """
SELECT scnt.id, coalesce(inv.invoice_no, '') AS invoice_no,
       strftime(inv.invoice_date, '%-d.%-m.%Y') AS invoice_date,
       inv.name_line AS name, scnt.country, scnt.arrival, scnt.departure,
       CAST(scnt.arrivals AS BIGINT) AS arrivals, CAST(scnt.nights AS BIGINT) AS nights,
       CAST(scnt.carry AS BIGINT) AS carry
FROM scnt JOIN inv ON inv.booking = scnt.id
""")
def e15_statistics_rows(spark, sf_dir):
    """E15 + F1 + F6 + J2: the month's invoice rows (number, date, name, country, counts)."""
    m, mx = _model(spark, sf_dir)
    rows = stats.statistics_rows(m.bookings, m.customers, STAT_MONTH, mx)
    return rows.select("id", "invoice_no", "invoice_date", "name", "country", "arrival",
                       "departure", F.col("arrivals").cast("bigint").alias("arrivals"),
                       F.col("nights").cast("bigint").alias("nights"),
                       F.col("carry").cast("bigint").alias("carry"))


def _months_sql(stays: str = "bk") -> str:
    return f"""
, months AS (
  SELECT bk.id, inv.country, coalesce(g.guests, 0) AS n, bk.arrival, bk.departure,
         CAST(unnest(CASE WHEN bk.departure > bk.arrival THEN
                        generate_series(date_trunc('month', bk.arrival),
                                        date_trunc('month', CAST(bk.departure - 1 AS DATE)),
                                        INTERVAL 1 MONTH)
                      WHEN day(bk.arrival) <> 1 THEN [CAST(date_trunc('month', bk.arrival) AS TIMESTAMP)]
                      ELSE [] END) AS DATE) AS month
  FROM {stays} bk JOIN inv ON inv.booking = bk.id LEFT JOIN gsum g ON g.booking = bk.id
), cnt AS (
  SELECT month, country,
         CASE WHEN arrival < month THEN 0 ELSE n END AS arrivals,
         n * greatest(0, date_diff('day', greatest(arrival, month),
                                   least(departure, CAST(last_day(month) + 1 AS DATE)))) AS nights,
         n * greatest(0, date_diff('day', greatest(arrival, month, CAST(last_day(month) + 1 AS DATE)),
                                   departure)) AS carry
  FROM months
)
SELECT month, country, CAST(sum(arrivals) AS BIGINT) AS arrivals,
       CAST(sum(nights) AS BIGINT) AS nights, CAST(sum(carry) AS BIGINT) AS carry
FROM cnt GROUP BY month, country
"""


@register("a2_all_months_stats", _months_sql())
def a2_all_months_stats(spark, sf_dir):
    """A2: every month's statistics by country in one pass."""
    m, _ = _model(spark, sf_dir)
    return stats.all_months_stats(m.bookings, m.customers)


@register("a2_all_months_sweep", _months_sql())
def a2_all_months_sweep(spark, sf_dir):
    """A2 by arrivals and departures alone: two rows per stay, running sums per country."""
    m, _ = _model(spark, sf_dir)
    return stats.all_months_sweep(m.bookings, m.customers)


@register("a2_long_stays_sweep", """
, longer AS (SELECT * REPLACE (CAST(departure + CAST(id % 5 * 300 AS INTEGER) AS DATE) AS departure) FROM bk)
""" + _months_sql("longer"))
def a2_long_stays_sweep(spark, sf_dir):
    """A2 by sweep where stays last up to three years more."""
    m, _ = _model(spark, sf_dir)
    longer = m.bookings.withColumn("departure", F.date_add("departure", (F.col("id") % 5 * 300).cast("int")))
    return stats.all_months_sweep(longer, m.customers)


@register("a2_changed_months_stats", """
, after AS (SELECT * REPLACE (CASE WHEN id % 20 = 4 THEN CAST(arrival + 40 AS DATE) ELSE arrival END AS arrival,
                              CASE WHEN id % 20 = 4 THEN CAST(departure + 45 AS DATE) ELSE departure END AS departure)
            FROM bk WHERE id % 50 <> 7)
""" + _months_sql("after"))
def a2_changed_months_stats(spark, sf_dir):
    """A2 + C6: stored counts of all stays but every tenth, then two batches merged in: the missing stays come;
    every 50th stay goes and every 20th is moved and lengthened."""
    m, _ = _model(spark, sf_dir)
    k = F.col("id")
    first = m.bookings.where(k % 10 != 3)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/innkeep-counts/{uuid.uuid4().hex}"
    stats.month_counts(first, m.customers).write.parquet(path)
    none = m.bookings.limit(0)
    come = stats.month_count_changes(none, m.bookings.where(k % 10 == 3), m.customers)
    old = m.bookings.where((k % 50 == 7) | (k % 20 == 4))
    new = old.where(k % 50 != 7).withColumn("arrival", F.date_add("arrival", 40)).withColumn("departure", F.date_add("departure", 45))
    edits = stats.month_count_changes(old, new, m.customers)
    return stats.add_counts(spark.read.parquet(path), come, edits).drop("stays")


@register("o4_invoice_row_order", _ROWS + """
SELECT scnt.id, CAST(row_number() OVER (ORDER BY coalesce(inv.invoice_no, '') DESC, scnt.id) - 1
                     AS BIGINT) AS position
FROM scnt JOIN inv ON inv.booking = scnt.id
""")
def o4_invoice_row_order(spark, sf_dir):
    """The month's invoice rows by invoice number, descending, missing last."""
    from innkeep.operators.ordering import with_global_index
    m, mx = _model(spark, sf_dir)
    rows = stats.statistics_rows(m.bookings, m.customers, STAT_MONTH, mx)
    keyed = rows.select("id", F.col("invoice_no"))
    return with_global_index(keyed, [F.col("invoice_no").desc(), F.col("id")],
                             index_col="position").select("id", "position")


@register("o6_country_summary_order", _ROWS + """
SELECT country, CAST(row_number() OVER (ORDER BY country IS NULL, country DESC) - 1 AS BIGINT)
         AS position
FROM (SELECT country FROM scnt GROUP BY ROLLUP (country))
""")
def o6_country_summary_order(spark, sf_dir):
    """Country summary in descending key order, total row last."""
    from innkeep.operators.ordering import with_global_index
    m, mx = _model(spark, sf_dir)
    s = stats.month_stats(m.bookings, m.customers, STAT_MONTH, with_total=True, max_nights=mx)
    return with_global_index(s.select("country", F.col("is_total").alias("_total")),
                             ["_total", F.col("country").desc()], index_col="position") \
        .select("country", "position")


@register("e17_month_titles", """
SELECT DISTINCT CAST(date_trunc('month', arrival) AS DATE) AS month,
       'Statistik ' || ['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August',
                        'September', 'Oktober', 'November', 'Dezember'][month(arrival)]
         || ' ' || CAST(year(arrival) AS VARCHAR) AS title,
       strftime(CAST(date_trunc('month', arrival) AS DATE), '%-d.%-m.%Y') AS first_day,
       strftime(last_day(arrival), '%-d.%-m.%Y') AS last_day
FROM bk
""")
def e17_month_titles(spark, sf_dir):
    """E16 + E17: statistics titles and month bounds (local date text) of every
    month with an arrival."""
    from innkeep.functions import periods as P
    m, _ = _model(spark, sf_dir)
    months = m.bookings.select(P.month_start("arrival").alias("month")).distinct()
    return months.select("month", F.concat(F.lit("Statistik "), P.month_name("month"), F.lit(" "),
                                           F.year("month").cast("string")).alias("title"),
                         P.local_date("month").alias("first_day"),
                         P.local_date(P.month_end("month")).alias("last_day"))


@register("e2_customer_stay_span", """
SELECT customer, min(arrival) AS first_arrival, max(departure) AS last_departure,
       CAST(count(*) AS BIGINT) AS n_stays
FROM bk GROUP BY customer
""")
def e2_customer_stay_span(spark, sf_dir):
    """The smallest period covering all stays of a customer (the covering
    period folded as a partial min/max aggregate)."""
    m, _ = _model(spark, sf_dir)
    return (m.bookings.groupBy("customer")
            .agg(F.min("arrival").alias("first_arrival"), F.max("departure").alias("last_departure"),
                 F.count(F.lit(1)).alias("n_stays")))


@register("e3_period_edits", """
SELECT id, CASE WHEN id % 3 = 0 THEN CAST(arrival - 2 AS DATE) ELSE arrival END AS new_from, departure AS new_till,
       least(arrival, DATE '1996-01-01') AS all_from, greatest(departure, DATE '1996-01-08') AS all_till
FROM bk
""")
def e3_period_edits(spark, sf_dir):
    """E2 + E3: every third arrival moved two days ahead, other ends kept; the period
    that covers the stay and a given week."""
    from innkeep.functions import periods as P
    m = load_model(spark, sf_dir)
    moved = P.update_period(F.struct(F.col("arrival").alias("a"), F.col("departure").alias("b")),
                            a=F.when(F.col("id") % 3 == 0, F.date_sub("arrival", 2)))
    lo, hi = P.cover("arrival", "departure", F.lit("1996-01-01").cast("date"), F.lit("1996-01-08").cast("date"))
    return m.bookings.select("id", moved["a"].alias("new_from"), moved["b"].alias("new_till"),
                             lo.alias("all_from"), hi.alias("all_till"))


@register("e9_local_tax_bands", """
SELECT id, CAST(CASE WHEN year(d) <= 2021 THEN CASE WHEN month(d) BETWEEN 4 AND 10 THEN 200 ELSE 80 END
                     WHEN year(d) <= 2025 THEN CASE WHEN month(d) BETWEEN 4 AND 10 THEN 250 ELSE 100 END
                     ELSE CASE WHEN month(d) BETWEEN 4 AND 10 THEN 330 ELSE 150 END END AS BIGINT) AS cents
FROM (SELECT id, CAST(departure + to_years(CAST(24 + id % 8 AS INTEGER)) AS DATE) AS d FROM bk)
""")
def e9_local_tax_bands(spark, sf_dir):
    """The local tax of every booking as if it left 24 to 31 years later, which
    reaches all three bands."""
    from innkeep.functions.taxes import local_tax_cents
    m = load_model(spark, sf_dir)
    later = F.add_months("departure", ((24 + F.col("id") % 8) * 12).cast("int"))
    return m.bookings.select("id", local_tax_cents(later).alias("cents"))


@register("e21_blank_rules", """
SELECT id, CASE WHEN title IN ('Herrn', 'Herrn und Frau', 'Frau', 'Herrn Dr.', 'Frau Dr.', 'Familie') THEN
         CASE title WHEN 'Herrn' THEN 'Sehr geehrter Herr' WHEN 'Herrn und Frau' THEN 'Sehr geehrte Frau, sehr geehrter Herr'
              WHEN 'Frau' THEN 'Sehr geehrte Frau' WHEN 'Herrn Dr.' THEN 'Sehr geehrter Herr Dr.'
              WHEN 'Frau Dr.' THEN 'Sehr geehrte Frau Dr.' ELSE 'Liebe Familie' END END AS letter,
       CASE WHEN mail = '' THEN phone ELSE mail END AS reach, nullif(trim(mail), '') AS mail
FROM cu
""")
def e21_blank_rules(spark, sf_dir):
    """E19 + E21: the greeting of a title, the first non-blank way to reach a customer,
    blank mail addresses as null."""
    from innkeep.functions import text as TXT
    d = F.col("data")
    return load_model(spark, sf_dir).customers.select(
        "id", TXT.letter_for_title(d["name"]["title"]).alias("letter"),
        TXT.coalesce_blank(d["contact"]["mail"], d["contact"]["phone"]).alias("reach"),
        TXT.blank_to_null(d["contact"]["mail"]).alias("mail"))
