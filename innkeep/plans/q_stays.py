"""Stay queries: T1, F1, F2+U4 (agenda), F5, J1, J2, W2, T6, O1, O2, W5."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from innkeep.functions import periods as P
from innkeep.operators import search, stays
from innkeep.plans.catalog import AGENDA_DAY, STAT_MONTH, STAT_MONTH_END, register
from innkeep.session import ensure_checkpoint_dir
from innkeep.sources import versions
from innkeep.sources.fixtures import load_model, model_max_nights

LOOKUP_KEY = 1031

# DuckDB: human period text of (arrival, departure).
PERIOD_TEXT_SQL = """CASE
  WHEN day({a}) = day({d}) AND month({a}) = month({d}) AND year({a}) = year({d})
    THEN strftime({d}, '%-d.%-m.%Y')
  WHEN month({a}) = month({d}) AND year({a}) = year({d})
    THEN CAST(day({a}) AS VARCHAR) || '. bis ' || strftime({d}, '%-d.%-m.%Y')
  WHEN day({a}) <> day({d}) AND year({a}) = year({d})
    THEN CAST(day({a}) AS VARCHAR) || '.' || CAST(month({a}) AS VARCHAR) || '. bis '
         || strftime({d}, '%-d.%-m.%Y')
  ELSE strftime({a}, '%-d.%-m.%Y') || ' bis ' || strftime({d}, '%-d.%-m.%Y') END"""


def period_sql(a: str, d: str) -> str:
    return PERIOD_TEXT_SQL.format(a=a, d=d)


@register("t1_stay_dates", """
SELECT id, arrival, departure, n_nights AS nights FROM bk
""")
def t1_stay_dates(spark, sf_dir):
    """arrival/departure regenerated from the stored period (either order)."""
    m = load_model(spark, sf_dir)
    b = stays.with_stay_dates(m.bookings.select("id", "data"))
    return b.select("id", "arrival", "departure",
                    P.nights("arrival", "departure").alias("nights"))


@register("f1_overlapping_month", f"""
SELECT id, customer, arrival, departure FROM bk
WHERE arrival <= DATE '{STAT_MONTH_END}' AND departure > DATE '{STAT_MONTH}'
""")
def f1_overlapping_month(spark, sf_dir):
    """stays overlapping the statistics month (half-open)."""
    m = load_model(spark, sf_dir)
    b = stays.overlapping(m.bookings, STAT_MONTH, STAT_MONTH_END,
                          model_max_nights(spark, sf_dir))
    return b.select("id", "customer", "arrival", "departure")


@register("u4_agenda_day", f"""
, ih AS (
  SELECT bk.id, bk.customer, cu.keyword, bk.arrival, bk.departure,
         CASE WHEN bk.arrival = DATE '{AGENDA_DAY}' THEN 'arrive'
              WHEN bk.departure = DATE '{AGENDA_DAY}' THEN 'leave' ELSE 'stay' END AS kind,
         CAST(bk.n_guests AS INTEGER) AS guests, r.rooms_text AS rooms
  FROM bk JOIN cu ON cu.id = bk.customer LEFT JOIN rooms r ON r.booking = bk.id
  WHERE bk.arrival <= DATE '{AGENDA_DAY}' AND bk.departure >= DATE '{AGENDA_DAY}'
)
SELECT id, customer, keyword, kind, guests, rooms,
       CASE WHEN guests <> 1 THEN CAST(guests AS VARCHAR) || ' Personen' ELSE '1 Person' END
       || ' vom ' || {period_sql('arrival', 'departure')} || ' '
       || coalesce(' in Zimmer ' || rooms, '') AS card
FROM ih
""")
def u4_agenda_day(spark, sf_dir):
    """F2 + U4 + E4 + E7: who arrives, leaves or stays on a day, with the card text."""
    m = load_model(spark, sf_dir)
    a = stays.agenda(m.bookings, m.customers, AGENDA_DAY, model_max_nights(spark, sf_dir))
    return a.select("id", "customer", "keyword", "kind", "guests", "rooms", "card")


@register("o3_agenda_room_order", f"""
, ih AS (
  SELECT bk.id,
         CASE WHEN bk.arrival = DATE '{AGENDA_DAY}' THEN 'arrive'
              WHEN bk.departure = DATE '{AGENDA_DAY}' THEN 'leave' ELSE 'stay' END AS kind,
         coalesce((SELECT list({{'kind': kind, 'num': coalesce(num, 0), 'txt': coalesce(txt, '')}}
                               ORDER BY kind, num, txt)
                   FROM rtok t WHERE t.booking = bk.id), []) AS rk
  FROM bk
  WHERE bk.arrival <= DATE '{AGENDA_DAY}' AND bk.departure >= DATE '{AGENDA_DAY}'
)
SELECT id, kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY rk, id) - 1 AS BIGINT) AS position
FROM ih
""")
def o3_agenda_room_order(spark, sf_dir):
    """O3: agenda cards ordered by room tokens (number < text < empty, lists
    lexicographic), position within each column; distributed sort + offsets."""
    from innkeep.operators.ordering import with_global_index
    m = load_model(spark, sf_dir)
    a = stays.agenda(m.bookings, m.customers, AGENDA_DAY, model_max_nights(spark, sf_dir))
    return with_global_index(a.select("id", "kind", "room_key"), ["room_key", "id"],
                             partition_col="kind", index_col="position") \
        .select("id", "kind", "position")


@register("f5_lookup_booking", f"""
SELECT id, customer, arrival, departure FROM bk WHERE id = {LOOKUP_KEY}
""")
def f5_lookup_booking(spark, sf_dir):
    """booking by key (a point filter pushed into the scan)."""
    m = load_model(spark, sf_dir)
    return stays.lookup(m.bookings, LOOKUP_KEY).select("id", "customer", "arrival", "departure")


@register("j1_embed_bookings", """
SELECT cu.id, count(bk.id) OVER (PARTITION BY cu.id) AS n_bookings,
       CASE WHEN bk.id IS NOT NULL THEN row_number() OVER (PARTITION BY cu.id ORDER BY bk.arrival DESC,
            bk.departure DESC, bk.id DESC) - 1 END AS position,
       bk.id AS booking, bk.arrival, bk.departure
FROM cu LEFT JOIN bk ON bk.customer = cu.id
""")
def j1_embed_bookings(spark, sf_dir):
    """Every customer's bookings newest first (position in the list), customers
    without bookings once with an empty list."""
    m = load_model(spark, sf_dir)
    return stays.embedded_bookings(m.customers, m.bookings)


@register("j2_with_customer", """
SELECT bk.id, bk.customer, cu.keyword, cu.country_code, bk.arrival, bk.departure
FROM bk JOIN cu ON cu.id = bk.customer
""")
def j2_with_customer(spark, sf_dir):
    """Every booking with its customer."""
    m = load_model(spark, sf_dir)
    j = stays.with_customer(m.bookings.select("id", "customer", "arrival", "departure"),
                            m.customers)
    return j.select("id", "customer", F.col("customer_keyword").alias("keyword"),
                    F.col("customer_data.address.country_code").alias("country_code"),
                    "arrival", "departure")


@register("w2_last_stay", """
SELECT customer, arrival AS last_from, departure AS last_till, id AS last_booking
FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY arrival DESC, departure DESC,
                                   id DESC) AS rn FROM bk)
WHERE rn = 1
""")
def w2_last_stay(spark, sf_dir):
    """Last stay per customer."""
    m = load_model(spark, sf_dir)
    return stays.last_stays(m.bookings.select("id", "customer", "arrival", "departure"))


@register("w2_last_stay_kept", """
SELECT customer, arrival AS last_from, departure AS last_till, id AS last_booking
FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY arrival DESC, departure DESC, id DESC) AS rn
      FROM (SELECT id, customer, arrival - CASE WHEN id % 5 = 1 THEN 400 ELSE 0 END AS arrival,
                   departure - CASE WHEN id % 5 = 1 THEN 400 ELSE 0 END AS departure
            FROM bk WHERE id % 7 <> 0
            UNION ALL
            SELECT -id, customer, arrival + 10, departure + 10 FROM bk WHERE id % 11 = 3 AND id % 7 <> 0 AND id > 0))
WHERE rn = 1
""")
def w2_last_stay_kept(spark, sf_dir):
    """W2 kept up to date in a stored table: bookings deleted in one batch, in the next one stays moved
    400 days back and new ones made; the second batch comes twice."""
    k = F.col("id")
    cols = ["id", "customer", "arrival", "departure"]
    first = load_model(spark, sf_dir).bookings.select(*cols)
    second = first.where(k % 7 != 0)
    move = k % 5 == 1
    made = second.where((k % 11 == 3) & (k > 0)).select(
        (-k).alias("id"), "customer", F.date_add("arrival", 10).alias("arrival"), F.date_add("departure", 10).alias("departure"))
    moved = second.where(move).select(
        "id", "customer", F.date_sub("arrival", 400).alias("arrival"), F.date_sub("departure", 400).alias("departure"))
    third = second.where(~move).unionByName(moved).unionByName(made)
    signed = lambda df, sign: df.select(F.lit(sign).alias("sign"), *cols)
    batches = [(signed(first.where(k % 7 == 0), -1), second),
               (signed(second.where(move), -1).unionByName(signed(moved, 1)).unionByName(signed(made, 1)), third)]
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/innkeep-versions/{uuid.uuid4().hex}"
    versions.create(spark, root, stays.last_stays(first), key="customer")
    for number in (0, 1, 1):
        changes, after = batches[number]
        versions.commit(spark, root, changes, lambda rows, batch, b=after: stays.merged_last_stays(rows, batch, b),
                        "bookings", number)
    return versions.read(spark, root)


@register("t6_customer_rows", """
SELECT cu.id, cu.keyword, cu.given, cu.family, cu.company, l.arrival AS from_date,
       l.departure AS till_date
FROM cu LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY arrival DESC,
                 departure DESC, id DESC) AS rn FROM bk) WHERE rn = 1) l ON l.customer = cu.id
""")
def t6_customer_rows(spark, sf_dir):
    """Search-result rows of all customers (with last stay)."""
    m = load_model(spark, sf_dir)
    return stays.customer_rows(m.customers, m.bookings).drop("modified")


_PAGE_SQL = """
, t6 AS (
  SELECT cu.id, cu.modified, cu.keyword, cu.given, cu.family, cu.company, l.arrival AS from_date,
         l.departure AS till_date
  FROM cu LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY arrival DESC,
                   departure DESC, id DESC) AS rn FROM bk) WHERE rn = 1) l ON l.customer = cu.id
  {where}
), pg AS (
  SELECT *, row_number() OVER (ORDER BY modified DESC, id) - 1 AS rn FROM t6
)
SELECT CAST(rn AS INTEGER) AS position, id, keyword, given, family, company, from_date, till_date
FROM pg WHERE rn >= {lo} AND rn < {hi}
"""


def page_sql(where: str = "", n: int = 0) -> str:
    size = search.PAGE_SIZE
    return _PAGE_SQL.format(where=where, lo=n * size, hi=(n + 1) * size)


@register("o1_first_page", page_sql())
def o1_first_page(spark, sf_dir):
    """O1 + W5: first result page of all customers, newest modified first."""
    m = load_model(spark, sf_dir)
    return search.search_page(m.customers, m.bookings, None, 0)


@register("o1_third_page", page_sql(n=2))
def o1_third_page(spark, sf_dir):
    """O1 + W5: page 2 (rows 500-749) with global positions."""
    m = load_model(spark, sf_dir)
    return search.search_page(m.customers, m.bookings, None, 2)


@register("o1_keyset_page", """
SELECT id, keyword, modified FROM cu ORDER BY modified DESC NULLS LAST, id LIMIT 50 OFFSET 100
""")
def o1_keyset_page(spark, sf_dir):
    """O1 by key: the third page of 50, each page from the last row of the one before it."""
    c = load_model(spark, sf_dir).customers.select("id", "keyword", "modified")
    page = search.page_after(c, size=50)
    for _ in range(2):
        last = page.tail(1)                              # one row reaches the driver
        if not last:
            return page
        page = search.page_after(c, last[0]["modified"], last[0]["id"], size=50)
    return page


@register("o2_more_pages", f"""
SELECT 5 AS page, CAST(least(count(*), {search.PAGE_SIZE}) AS BIGINT) AS rows,
       count(*) > {search.PAGE_SIZE} AS has_more
FROM (SELECT id FROM cu ORDER BY modified DESC, id LIMIT {search.PAGE_SIZE + 1}
      OFFSET {5 * search.PAGE_SIZE})
""")
def o2_more_pages(spark, sf_dir):
    """O2: is there a page after page 5?"""
    m = load_model(spark, sf_dir)
    return search.more_pages(m.customers.select("id", "modified"), 5)


REBOOK_DAY = "2001-09-01"


@register("t20_rebook_template", f"""
SELECT customer, DATE '{REBOOK_DAY}' AS arrival, CAST(DATE '{REBOOK_DAY}' + 7 AS DATE) AS departure,
       CAST(n_guests AS INTEGER) AS n_guests, tax_free, '' AS note
FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY arrival DESC, departure DESC,
                                   id DESC) AS rn FROM bk) WHERE rn = 1
""")
def t20_rebook_template(spark, sf_dir):
    """New-booking template per customer from the last booking (guests and tax
    flag kept, the rest cleared, 7-night default period)."""
    m = load_model(spark, sf_dir)
    t = stays.rebook_template(m.bookings, REBOOK_DAY)
    return t.select("customer", F.col("data.period.a").alias("arrival"),
                    F.col("data.period.b").alias("departure"),
                    F.size("data.guests").alias("n_guests"), F.col("data.tax_free").alias("tax_free"),
                    F.col("data.note").alias("note"))


@register("o5_customers_by_last_departure", """
SELECT cu.id, CAST(row_number() OVER (ORDER BY coalesce(strftime(l.departure, '%Y%m%d'), ''), cu.id) - 1
                AS BIGINT) AS position,
       coalesce(strftime(l.departure, '%Y%m%d'), '') AS sort_key
FROM cu LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY arrival DESC,
                 departure DESC, id DESC) AS rn FROM bk) WHERE rn = 1) l ON l.customer = cu.id
""")
def o5_customers_by_last_departure(spark, sf_dir):
    """The customer table sorted by a date column: basic ISO form, missing as
    empty text (first); global positions from the distributed index."""
    from innkeep.operators.ordering import with_global_index
    m = load_model(spark, sf_dir)
    rows = stays.customer_rows(m.customers, m.bookings)
    keyed = rows.select("id", F.coalesce(F.date_format("till_date", "yyyyMMdd"), F.lit(""))
                        .alias("sort_key"))
    return with_global_index(keyed, ["sort_key", "id"], index_col="position") \
        .select("id", "position", "sort_key")


@register("u2_append_pages", page_sql(n=0).replace("rn < 250", "rn < 500"))
def u2_append_pages(spark, sf_dir):
    """Pages 0 and 1 appended by global position (overlapping keys are an error)."""
    m = load_model(spark, sf_dir)
    p0 = search.search_page(m.customers, m.bookings, None, 0)
    p1 = search.search_page(m.customers, m.bookings, None, 1)
    return search.append_pages(p0, p1)


@register("f8_changed_in_period", """
SELECT id, customer, modified FROM bk
WHERE modified >= TIMESTAMP '1998-01-01 00:00:00' AND modified < TIMESTAMP '1998-07-01 00:00:00'
  AND departure > arrival
""")
def f8_changed_in_period(spark, sf_dir):
    """F8: comparison predicates on the typed columns (modified range, nights > 0)."""
    m = load_model(spark, sf_dir)
    b = m.bookings.where((F.col("modified") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
                         & (F.col("modified") < F.lit("1998-07-01 00:00:00").cast("timestamp_ntz"))
                         & (F.col("departure") > F.col("arrival")))
    return b.select("id", "customer", "modified")
