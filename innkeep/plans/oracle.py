"""DuckDB oracle SQL for the registered queries.

The oracle restates the fixture mapping (``innkeep.sources.fixtures``) as flat
SQL relations, independently of the nested Spark model:

    cu  customers          bk  bookings (one row per order)
    gs  guests             al  room lines (one per lineitem)
    po  invoice positions  (room lines and the local-tax line)

Each query is ``BASE`` followed by its own SELECT; unused CTEs cost nothing.
"""

from __future__ import annotations

BASE = r"""
WITH cu AS (
  SELECT c.c_custkey AS id, c.c_name AS keyword, c.c_mktsegment AS company,
         ['Herrn', 'Herrn und Frau', 'Frau', 'Herrn Dr.', 'Frau Dr.', 'Familie', ''][
           CAST(c.c_custkey % 7 AS INTEGER) + 1] AS title,
         'Vorname' || CAST(c.c_custkey % 89 AS VARCHAR) AS given,
         'Name' || CAST(c.c_custkey % 211 AS VARCHAR) AS family,
         'Weg ' || CAST(c.c_custkey % 50 AS VARCHAR) || ' ' || CAST(c.c_custkey % 9 + 1 AS VARCHAR)
           AS street,
         CAST((c.c_custkey * 7919) % 90000 + 10000 AS VARCHAR) AS postal_code,
         'Ort' || CAST(c.c_custkey % 40 AS VARCHAR) AS city,
         n.n_name AS country, 'X' || n.n_name AS country_code,
         CASE WHEN c.c_custkey % 10 = 0 THEN '07534/'
              ELSE '0' || CAST(c.c_custkey % 900 + 100 AS VARCHAR) || '/'
                   || CAST(c.c_custkey * 31 % 1000000 AS VARCHAR) END AS phone,
         CASE WHEN c.c_custkey % 2 = 0 THEN lower(replace(c.c_name, '#', '.')) || '@example.org'
              ELSE '' END AS mail,
         CAST(DATE '1994-01-01' + CAST(c.c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS created,
         CAST(DATE '1994-01-01' + CAST(c.c_custkey % 365 AS INTEGER) AS TIMESTAMP)
           + to_minutes(CAST((c.c_custkey * 7919) % 20000 AS BIGINT)) AS modified
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
),
bk AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS customer, o.o_orderstatus AS status,
         CAST(o.o_orderdate AS DATE) AS arrival,
         CAST(CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 13 AS INTEGER) AS DATE) AS departure,
         CAST(o.o_orderkey % 13 AS INTEGER) AS n_nights,
         CAST(o.o_orderkey % 5 AS INTEGER) AS n_guests,
         o.o_orderkey % 11 = 0 AS tax_free,
         CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE CAST((o.o_orderkey % 200) * 100 AS BIGINT)
           END AS deposit_got,
         CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE CAST((o.o_orderkey % 150) * 100 AS BIGINT)
           END AS deposit_asked,
         o.o_orderstatus = 'F' AS has_invoice,
         o.o_orderdate AS created,
         o.o_orderdate + to_hours(CAST(o.o_orderkey % 400 AS BIGINT)) AS modified
  FROM orders o
),
gs AS (
  SELECT id AS booking, i, departure, 'Gast' || CAST(i AS VARCHAR) AS given,
         'Name' || CAST(customer % 211 AS VARCHAR) AS family,
         CASE WHEN (id + i) % 4 = 0 THEN NULL
              ELSE CAST(CAST(departure - to_months(CAST(12 * ((7 * id + 13 * i) % 80) AS INTEGER))
                             AS DATE) + CAST(id % 3 - 1 AS INTEGER) AS DATE) END AS born
  FROM (SELECT id, customer, departure, unnest(range(1, n_guests + 1)) AS i FROM bk)
),
gsum AS (
  SELECT booking, count(*) AS guests,
         count(*) FILTER (WHERE born IS NULL OR born < CAST(departure - to_months(180) AS DATE))
           AS tax_payers
  FROM gs GROUP BY booking
),
al AS (
  SELECT l.l_orderkey AS booking, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_suppkey AS sk,
         l.l_quantity AS q,
         CASE WHEN l.l_linenumber % 4 = 0 THEN ''
              WHEN l.l_linenumber % 4 = 1 THEN 'A' || CAST(l.l_linenumber AS VARCHAR)
              ELSE CAST(l.l_partkey % 30 + 1 AS VARCHAR) END AS room,
         CAST(3000 + (l.l_partkey % 50) * 100 AS BIGINT) AS price_per_bed,
         CAST(1 + CAST(trunc(l.l_quantity) AS BIGINT) % 4 AS INTEGER) AS beds,
         ['Einzelzimmer', 'Doppelzimmer', 'Dreibettzimmer', 'Vierbettzimmer',
          'Doppel- als Einzelzimmer'][CAST(l.l_suppkey % 5 AS INTEGER) + 1] AS description
  FROM lineitem l
),
rtok AS (
  SELECT DISTINCT booking,
         CASE WHEN trim(room) = '' THEN 2
              WHEN regexp_matches(trim(room), '^[+-]?[0-9]+$') THEN 0 ELSE 1 END AS kind,
         CASE WHEN regexp_matches(trim(room), '^[+-]?[0-9]+$') THEN CAST(trim(room) AS BIGINT)
           END AS num,
         CASE WHEN trim(room) <> '' AND NOT regexp_matches(trim(room), '^[+-]?[0-9]+$')
              THEN trim(room) END AS txt
  FROM al
),
rooms AS (
  SELECT booking,
         string_agg(CASE WHEN kind = 0 THEN CAST(num AS VARCHAR) ELSE txt END, ', '
                    ORDER BY kind, num, txt) FILTER (WHERE kind < 2) AS rooms_text
  FROM rtok GROUP BY booking
),
first_room AS (
  SELECT booking,
         CASE WHEN kind = 0 THEN CAST(num AS VARCHAR) WHEN kind = 1 THEN txt END AS first_room,
         CASE WHEN kind = 0 THEN printf('%03d', num) WHEN kind = 1 THEN txt END AS room_no
  FROM (SELECT *, row_number() OVER (PARTITION BY booking ORDER BY kind, num, txt) AS rn FROM rtok)
  WHERE rn = 1
),
inv AS (
  SELECT bk.id AS booking, bk.customer, bk.arrival, bk.departure,
         CASE WHEN fr.first_room IS NOT NULL THEN
           printf('%02d%02d%02d-%s', year(bk.departure) % 1000, month(bk.departure),
                  day(bk.departure), fr.room_no) END AS invoice_no,
         bk.departure AS invoice_date,
         cu.given || ' ' || cu.family AS name_line,
         CASE WHEN bk.id % 7 = 1 THEN 'D' ELSE cu.country_code END AS country,
         cu.given || ' ' || cu.family || chr(10) || cu.street || chr(10) ||
           CASE WHEN bk.id % 7 = 0 THEN cu.postal_code || ' ' || cu.city
                WHEN bk.id % 7 = 1 THEN 'D-' || cu.postal_code || ' ' || cu.city
                ELSE cu.country_code || '-' || cu.postal_code || ' ' || cu.city END AS recipient
  FROM bk JOIN cu ON bk.customer = cu.id
  LEFT JOIN first_room fr ON fr.booking = bk.id
  WHERE bk.has_invoice
),
po AS (
  SELECT al.booking, 0 AS grp, al.ln, al.pk, al.sk, al.q,
         CAST(al.beds * bk.n_nights AS INTEGER) AS quantity,
         'Übernachtung im ' || al.description AS description,
         al.price_per_bed AS price,
         CASE WHEN bk.id % 9 = 0 THEN 'Legacy' WHEN bk.id % 9 = 1 THEN 'General19'
              ELSE 'Reduced7With3EuroDrinks19' END AS tax,
         CASE WHEN bk.id % 9 = 0 THEN 16 END AS legacy_rate
  FROM al JOIN bk ON al.booking = bk.id WHERE bk.has_invoice
  UNION ALL
  SELECT bk.id, 1, NULL, NULL, NULL, NULL,
         CAST(g.tax_payers * bk.n_nights AS INTEGER), 'Kurtaxe',
         CAST(CASE WHEN year(bk.departure) <= 2021 THEN
                     CASE WHEN month(bk.departure) < 4 OR month(bk.departure) > 10 THEN 80 ELSE 200 END
                   WHEN year(bk.departure) <= 2025 THEN
                     CASE WHEN month(bk.departure) < 4 OR month(bk.departure) > 10 THEN 100 ELSE 250 END
                   ELSE CASE WHEN month(bk.departure) < 4 OR month(bk.departure) > 10 THEN 150 ELSE 330 END
              END AS BIGINT),
         'Reduced7', NULL
  FROM bk JOIN gsum g ON g.booking = bk.id
  WHERE bk.has_invoice AND g.tax_payers > 0 AND NOT bk.tax_free
)
"""


def q(body: str) -> str:
    return BASE + body


ORACLE: dict[str, str] = {}


def register(name: str, body: str) -> None:
    ORACLE[name] = q(body)


# ---------------------------------------------------------------- statistics
_STAT_ROWS = r"""
, srows AS (
  SELECT bk.id, inv.country AS country, coalesce(g.guests, 0) AS n,
         bk.arrival, bk.departure, DATE '{start}' AS s, DATE '{end}' AS e
  FROM bk JOIN inv ON inv.booking = bk.id LEFT JOIN gsum g ON g.booking = bk.id
  WHERE bk.arrival <= DATE '{end}' AND bk.departure > DATE '{start}'
), scnt AS (
  SELECT id, country, arrival, departure,
         CASE WHEN arrival < s THEN 0 ELSE n END AS arrivals,
         n * greatest(0, date_diff('day', greatest(arrival, s), least(departure, CAST(e + 1 AS DATE))))
           AS nights,
         n * greatest(0, date_diff('day', greatest(arrival, s, CAST(e + 1 AS DATE)), departure))
           AS carry
  FROM srows
)
"""


def stat_rows(start: str, end: str) -> str:
    return _STAT_ROWS.format(start=start, end=end)
