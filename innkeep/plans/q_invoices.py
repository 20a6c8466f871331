"""Invoicing queries: T19, U3, A4, A5, A7 + W3, A9, T4 + T5, E9, E11."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.functions import taxes as TX
from innkeep.operators import invoices as INV
from innkeep.plans.catalog import INVOICE_DATE, register
from innkeep.plans.q_stays import period_sql
from innkeep.sources.fixtures import load_model

# DuckDB: positions of a freshly generated invoice (standard codes) per booking.
_GEN = r"""
, gpo AS (
  SELECT al.booking, 0 AS grp, row_number() OVER (PARTITION BY al.booking ORDER BY al.ln, al.pk,
           al.sk, al.q) AS pos_in_grp,
         CAST(al.beds * bk.n_nights AS INTEGER) AS quantity,
         'Übernachtung im ' || al.description AS description, al.price_per_bed AS price,
         'Reduced7With3EuroDrinks19' AS tax
  FROM al JOIN bk ON al.booking = bk.id
  UNION ALL
  SELECT bk.id, 1, 1, CAST(g.tax_payers * bk.n_nights AS INTEGER), 'Kurtaxe',
         CAST(CASE WHEN year(bk.departure) <= 2021 THEN
                     CASE WHEN month(bk.departure) < 4 OR month(bk.departure) > 10 THEN 80 ELSE 200 END
                   WHEN year(bk.departure) <= 2025 THEN
                     CASE WHEN month(bk.departure) < 4 OR month(bk.departure) > 10 THEN 100 ELSE 250 END
                   ELSE CASE WHEN month(bk.departure) < 4 OR month(bk.departure) > 10 THEN 150 ELSE 330 END
              END AS BIGINT), 'Reduced7'
  FROM bk JOIN gsum g ON g.booking = bk.id
  WHERE g.tax_payers > 0 AND NOT bk.tax_free
), gpos AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY booking ORDER BY grp, pos_in_grp) - 1 AS INTEGER)
           AS pos
  FROM gpo
)
"""


def _model(spark, sf_dir):
    return load_model(spark, sf_dir)


@register("t19_generate_invoices", _GEN + f"""
SELECT bk.id,
       CASE WHEN fr.first_room IS NOT NULL THEN
         printf('%02d%02d%02d-%s', year(bk.departure) % 1000, month(bk.departure),
                day(bk.departure), fr.room_no) END AS invoice_no,
       cu.given || ' ' || cu.family || chr(10) || cu.street || chr(10) || cu.country_code || '-'
         || cu.postal_code || ' ' || cu.city AS recipient,
       DATE '{INVOICE_DATE}' AS invoice_date, bk.departure AS departure_date,
       'Für Ihren Aufenthalt vom ' || {period_sql('bk.arrival', 'bk.departure')}
         || ' stellen wir die folgenden Positionen in Rechnung.' AS intro,
       CAST(count(p.pos) AS INTEGER) AS n_positions,
       CAST(coalesce(sum(CAST(p.quantity AS BIGINT) * p.price), 0) AS BIGINT) AS total,
       coalesce(bk.deposit_got, 0) AS deposit
FROM bk JOIN cu ON cu.id = bk.customer
LEFT JOIN first_room fr ON fr.booking = bk.id
LEFT JOIN gpos p ON p.booking = bk.id
GROUP BY ALL
""")
def t19_generate_invoices(spark, sf_dir):
    """T19 (+ E9, E11, E12, E13, E14, U3, A5): generate an invoice for every booking."""
    m = _model(spark, sf_dir)
    from innkeep.functions.util import let, spread
    g = INV.generate_invoices(m.bookings, m.customers, INVOICE_DATE)
    inv = F.col("invoice")
    # the positions are built once per booking and both counted and summed
    pos = let(inv["positions"], lambda p: F.struct(
        F.size(p).alias("n"), F.aggregate(p, F.lit(0).cast("bigint"),
                                          lambda acc, x: acc + INV.position_total(x)).alias("s")))
    return g.select("id", inv["id"].alias("invoice_no"), inv["recipient"].alias("recipient"),
                    inv["invoice_date"].alias("invoice_date"),
                    inv["departure_date"].alias("departure_date"), inv["intro"].alias("intro"),
                    spread(pos), inv["deposit"].alias("deposit")) \
        .withColumnRenamed("n", "n_positions").withColumnRenamed("s", "total")


@register("u3_invoice_positions", _GEN + """
SELECT booking AS id, pos, quantity, description, price, tax FROM gpos
""")
def u3_invoice_positions(spark, sf_dir):
    """Positions of the generated invoices (room lines, then local tax; x nights)."""
    m = _model(spark, sf_dir)
    g = INV.generate_invoices(m.bookings, m.customers, INVOICE_DATE)
    p = g.select("id", F.posexplode("invoice.positions").alias("pos", "p"))
    return p.select("id", "pos", "p.quantity", "p.description", "p.price", "p.tax")


@register("a4_invoice_totals", """
SELECT inv.booking AS id, inv.invoice_no, CAST(count(po.booking) AS INTEGER) AS n_positions,
       CAST(coalesce(sum(CAST(po.quantity AS BIGINT) * po.price), 0) AS BIGINT) AS total,
       coalesce(bk.deposit_got, 0) AS deposit,
       CAST(coalesce(sum(CAST(po.quantity AS BIGINT) * po.price), 0) - coalesce(bk.deposit_got, 0)
            AS BIGINT) AS rest
FROM inv JOIN bk ON bk.id = inv.booking LEFT JOIN po ON po.booking = inv.booking
GROUP BY inv.booking, inv.invoice_no, bk.deposit_got
""")
def a4_invoice_totals(spark, sf_dir):
    """A4: sum, deposit and rest of every stored invoice."""
    return INV.invoice_totals(_model(spark, sf_dir).bookings)


@register("a5_booking_summary", """
SELECT bk.id, CAST(coalesce(g.guests, 0) AS INTEGER) AS guests,
       CAST(coalesce(g.tax_payers, 0) AS INTEGER) AS tax_payers,
       r.rooms_text AS rooms, fr.first_room
FROM bk LEFT JOIN gsum g ON g.booking = bk.id LEFT JOIN rooms r ON r.booking = bk.id
LEFT JOIN first_room fr ON fr.booking = bk.id
""")
def a5_booking_summary(spark, sf_dir):
    """A5 + E5-E7: guests, tax payers (G5) and rooms of every booking."""
    return INV.summarise(_model(spark, sf_dir).bookings)


_RULES = r"""
, parts AS (
  SELECT booking, 7 AS rate, CAST(quantity AS BIGINT) * (price - 300) AS gross FROM po
    WHERE tax = 'Reduced7With3EuroDrinks19'
  UNION ALL
  SELECT booking, 19, CAST(quantity AS BIGINT) * 300 FROM po WHERE tax = 'Reduced7With3EuroDrinks19'
  UNION ALL
  SELECT booking, CASE tax WHEN 'General19' THEN 19 WHEN 'Reduced7' THEN 7 ELSE legacy_rate END,
         CAST(quantity AS BIGINT) * price FROM po WHERE tax <> 'Reduced7With3EuroDrinks19'
), rules AS (
  SELECT DISTINCT booking, 0 AS kind, rate FROM parts
  UNION
  SELECT DISTINCT booking, 1, CAST(NULL AS INTEGER) FROM po WHERE tax = 'Reduced7With3EuroDrinks19'
), labelled AS (
  SELECT *, chr(CAST(64 + dense_rank() OVER (PARTITION BY booking ORDER BY kind, rate) AS INTEGER))
           AS label
  FROM rules
), sums AS (
  SELECT booking, rate, sum(gross) AS s FROM parts GROUP BY booking, rate
)
"""


@register("a7_tax_table", _RULES + """
SELECT l.booking AS id, inv.invoice_no, l.label, CAST(l.kind AS INTEGER) AS kind,
       CAST(l.rate AS INTEGER) AS rate,
       CASE WHEN l.kind = 0 THEN CAST(l.rate AS VARCHAR) || '%'
            ELSE 'Enthält 3,00€ Getränke-Anteil pro Frühstück zu 19%, Rest 7%' END AS description,
       CASE WHEN l.kind = 0 THEN CAST(floor((2 * s.s * l.rate + (100 + l.rate))
                                            / (2 * (100 + l.rate))) AS BIGINT)
            ELSE CAST(0 AS BIGINT) END AS tax_cents
FROM labelled l JOIN inv ON inv.booking = l.booking
LEFT JOIN sums s ON s.booking = l.booking AND s.rate = l.rate
""")
def a7_tax_table(spark, sf_dir):
    """A7 + W3: tax table of every stored invoice (labels, rates, included tax)."""
    return INV.tax_table(_model(spark, sf_dir).bookings)


@register("w3_position_labels", _RULES + """
, pl AS (
  SELECT booking, row_number() OVER (PARTITION BY booking ORDER BY grp, ln, pk, sk, q) - 1 AS pos,
         CASE WHEN tax = 'Reduced7With3EuroDrinks19' THEN 1 ELSE 0 END AS kind,
         CASE tax WHEN 'General19' THEN 19 WHEN 'Reduced7' THEN 7 WHEN 'Legacy' THEN legacy_rate END
           AS rate
  FROM po
)
SELECT pl.booking AS id, CAST(pl.pos AS INTEGER) AS pos, l.label
FROM pl JOIN labelled l ON l.booking = pl.booking AND l.kind = pl.kind
  AND l.rate IS NOT DISTINCT FROM pl.rate
""")
def w3_position_labels(spark, sf_dir):
    """Each stored invoice position with the label of its tax row."""
    b = _model(spark, sf_dir).bookings.where(F.col("data.invoice").isNotNull())
    return b.select("id", F.posexplode(INV.position_labels("data.invoice")).alias("pos", "label"))


@register("a9_compat_tax_codes", """
SELECT inv.booking AS id,
       coalesce(string_agg(DISTINCT CASE WHEN po.tax = 'Legacy'
                                         THEN 'custom' || CAST(po.legacy_rate AS VARCHAR) END, ','), '')
         AS compat_codes,
       CAST(count(DISTINCT CASE WHEN po.tax = 'Legacy' THEN po.legacy_rate END) AS INTEGER) AS n_compat
FROM inv LEFT JOIN po ON po.booking = inv.booking
GROUP BY inv.booking
""")
def a9_compat_tax_codes(spark, sf_dir):
    """Tax codes of each invoice beyond the three active ones."""
    return INV.compat_tax_codes(_model(spark, sf_dir).bookings)


@register("t4_decode_invoice", """
SELECT inv.booking AS id, inv.invoice_no, inv.invoice_date,
       CASE WHEN inv.booking % 6 = 0 THEN NULL ELSE inv.departure END AS departure_date,
       CAST(count(po.booking) AS INTEGER) AS n_positions,
       CAST(coalesce(sum(CAST(po.quantity AS BIGINT) * po.price), 0) AS BIGINT) AS total,
       coalesce(string_agg(DISTINCT CASE WHEN po.tax = 'Legacy'
                 THEN 'Legacy:' || CAST(po.legacy_rate AS VARCHAR) ELSE po.tax END, ','
                 ORDER BY CASE WHEN po.tax = 'Legacy'
                 THEN 'Legacy:' || CAST(po.legacy_rate AS VARCHAR) ELSE po.tax END), '') AS taxes
FROM inv LEFT JOIN po ON po.booking = inv.booking
GROUP BY ALL
""")
def t4_decode_invoice(spark, sf_dir):
    """T4 + T5: stored invoices written as JSON (older shape for every 6th id, taxes
    partly as bare integers), read back with the shape upgrade and tax decoding."""
    b = _model(spark, sf_dir).bookings.where(F.col("data.invoice").isNotNull())
    js = b.select("id", INV.invoice_json("data.invoice", F.col("id") % 6 == 0).alias("json"))
    dec = js.select("id", INV.decode_invoice("json").alias("inv"))
    inv = F.col("inv")
    codes = F.transform(inv["positions"], lambda p: F.when(
        p["tax"] == TX.LEGACY, F.format_string("Legacy:%d", p["legacy_rate"])).otherwise(p["tax"]))
    return dec.select("id", inv["id"].alias("invoice_no"), inv["invoice_date"].alias("invoice_date"),
                      inv["departure_date"].alias("departure_date"),
                      F.size(inv["positions"]).alias("n_positions"),
                      INV.invoice_sum(inv).alias("total"),
                      F.array_join(F.array_sort(F.array_distinct(codes)), ",").alias("taxes"))


@register("e20_tax_code_labels", """
SELECT DISTINCT tax, legacy_rate,
       CASE tax WHEN 'General19' THEN 'general19' WHEN 'Reduced7' THEN 'reduced7'
                WHEN 'Reduced7With3EuroDrinks19' THEN 'reduced7-3€-drinks19'
                ELSE 'custom' || CAST(legacy_rate AS VARCHAR) END AS tax_key,
       CASE tax WHEN 'General19' THEN 'Generell, 19%' WHEN 'Reduced7' THEN 'Reduziert, 7%'
                WHEN 'Reduced7With3EuroDrinks19' THEN 'Reduziert, 3€ Getränke'
                ELSE CAST(legacy_rate AS VARCHAR) || '% (alt)' END AS tax_label,
       CASE tax WHEN 'General19' THEN '19%' WHEN 'Reduced7' THEN '7%'
                WHEN 'Reduced7With3EuroDrinks19' THEN '7% (*)'
                ELSE CAST(legacy_rate AS VARCHAR) || '%' END AS tax_short
FROM po
""")
def e20_tax_code_labels(spark, sf_dir):
    """The tax codes used by stored invoices with their form key, label and
    printed form (a distinct over all positions, partial per partition)."""
    b = _model(spark, sf_dir).bookings.where(F.col("data.invoice").isNotNull())
    p = b.select(F.explode("data.invoice.positions").alias("p")).select("p.tax", "p.legacy_rate")
    codes = p.distinct()
    return codes.select("tax", "legacy_rate",
                        TX.tax_key("tax", "legacy_rate").alias("tax_key"),
                        TX.tax_label("tax", "legacy_rate").alias("tax_label"),
                        TX.tax_short("tax", "legacy_rate").alias("tax_short"))
