"""Export queries: A8, W4, D1-D6 (+ E4, E8, E10, E18, E19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.operators import exports as EX
from innkeep.plans.catalog import register
from innkeep.plans.q_invoices import _RULES
from innkeep.plans.q_migration import LEGACY_SQL
from innkeep.plans.q_stays import period_sql
from innkeep.sources.fixtures import load_model

LETTER_DATE = "1.9.2001"


def money_sql(x: str, sep: str = ",") -> str:
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || printf('%d{sep}%02d', abs({x}) // 100, "
            f"abs({x}) % 100))")


def local_date_sql(x: str) -> str:
    return f"strftime({x}, '%-d.%-m.%Y')"


_GROUPS = """
, grp AS (
  SELECT booking, price_per_bed, beds, description, count(*) AS n,
         row_number() OVER (PARTITION BY booking ORDER BY price_per_bed DESC, beds DESC,
                            description DESC) AS g
  FROM al GROUP BY booking, price_per_bed, beds, description
)
"""


@register("a8_item_groups", _GROUPS + """
SELECT booking AS id, CAST(g - 1 AS INTEGER) AS pos, CAST(n AS INTEGER) AS n, price_per_bed, beds,
       description
FROM grp
""")
def a8_item_groups(spark, sf_dir):
    """Identical room lines per booking counted (room ignored), largest first."""
    b = load_model(spark, sf_dir).bookings
    g = b.select("id", F.posexplode(EX.item_groups("data.allocs")).alias("pos", "g"))
    return g.select("id", "pos", "g.n", "g.price_per_bed", "g.beds", "g.description")


def _item_cols_sql(i: int, percent: bool = True) -> str:
    cols = [f"coalesce(max(CASE WHEN g = {i} THEN CAST(n AS VARCHAR) END), '') AS item{i}_n",
            f"coalesce(max(CASE WHEN g = {i} THEN description END), '') AS item{i}_description",
            f"coalesce(max(CASE WHEN g = {i} THEN printf('%d.%02d', price_per_bed // 100, "
            f"price_per_bed % 100) END), '') AS item{i}_price"]
    if percent:
        cols.append(f"coalesce(max(CASE WHEN g = {i} THEN CAST(beds * 100 AS VARCHAR) END), '')"
                    f" AS item{i}_percent")
    return ",\n       ".join(cols)


@register("w4_top_items", _GROUPS + f"""
SELECT bk.id, {_item_cols_sql(1)}, {_item_cols_sql(2)}, {_item_cols_sql(3)}
FROM bk LEFT JOIN grp ON grp.booking = bk.id GROUP BY bk.id
""")
def w4_top_items(spark, sf_dir):
    """Top three item groups of every booking spread into columns."""
    b = load_model(spark, sf_dir).bookings
    from innkeep.functions.util import spread
    return b.select("id", spread(EX.top_items(EX.item_groups("data.allocs"))))


def _item_lines_sql(i: int, percent: bool = True) -> str:
    parts = [f"coalesce(max(CASE WHEN g = {i} THEN CAST(n AS VARCHAR) END), '')",
             f"coalesce(max(CASE WHEN g = {i} THEN description END), '')",
             f"coalesce(max(CASE WHEN g = {i} THEN printf('%d.%02d', price_per_bed // 100, "
             f"price_per_bed % 100) END), '')"]
    if percent:
        parts.append(f"coalesce(max(CASE WHEN g = {i} THEN CAST(beds * 100 AS VARCHAR) END), '')")
    return " || chr(10) || ".join(parts)


@register("d2_interchange", LEGACY_SQL + _GROUPS + f"""
, items AS (
  SELECT bk.id, {_item_lines_sql(1)} AS l1, {_item_lines_sql(2)} AS l2,
         {_item_lines_sql(3, percent=False)} AS l3
  FROM bk LEFT JOIN grp ON grp.booking = bk.id GROUP BY bk.id
)
SELECT bk.id, concat_ws(chr(10), '2014_EXCEL_BR_V2_pQ06eaXd', coalesce(a.room1, ''), cu.title,
         coalesce(lt.letter, ''), cu.family, cu.given, '', '', cu.country_code, cu.postal_code,
         cu.city, cu.street, cu.phone, {local_date_sql('bk.arrival')}, {local_date_sql('bk.departure')},
         it.l1, it.l2, it.l3,
         CASE WHEN bk.tax_free THEN '0' ELSE CAST(coalesce(g.tax_payers, 0) AS VARCHAR) END,
         CASE WHEN coalesce(g.tax_payers, 0) < 1 OR bk.tax_free THEN '' ELSE 'Kurtaxe' END,
         CASE WHEN coalesce(g.tax_payers, 0) < 1 OR bk.tax_free THEN '0.00' ELSE '2.00' END,
         printf('%d.%02d', coalesce(bk.deposit_got, 0) // 100, coalesce(bk.deposit_got, 0) % 100))
       AS text
FROM bk JOIN cu ON cu.id = bk.customer LEFT JOIN lt ON lt.title = cu.title
LEFT JOIN alp a ON a.booking = bk.id LEFT JOIN gsum g ON g.booking = bk.id
JOIN items it ON it.id = bk.id
""")
def d2_interchange(spark, sf_dir):
    """The 30-line interchange record of every booking."""
    m = load_model(spark, sf_dir)
    return EX.interchange(m.bookings, m.customers)


_CAT = ("CASE WHEN {b} IS NOT NULL AND CAST({d} - to_months(72) AS DATE) < {b} THEN '7' "
        "WHEN {b} IS NOT NULL AND CAST({d} - to_months(180) AS DATE) < {b} THEN '8' ELSE '1' END")


_D1_SQL = f"""
, cat AS (SELECT booking, i, given, family, {_CAT.format(b='born', d='departure')} AS kategorie FROM gs)
SELECT bk.id, '0550' AS hotelid, strftime(bk.arrival, '%Y-%m-%d') AS anreise,
       strftime(bk.departure, '%Y-%m-%d') AS abreise, cu.street AS strasse, '.' AS hausnummer,
       cu.postal_code AS plz, cu.city AS ort, cu.country AS land,
       coalesce(m.kategorie, '1') AS kategorie, coalesce(m.family, cu.family) AS name,
       coalesce(m.given, cu.given) AS vorname,
       coalesce((SELECT string_agg(kategorie || '|' || family || '|' || given, ';' ORDER BY i)
                 FROM cat WHERE cat.booking = bk.id AND cat.i > 1), '') AS begleitpersonen
FROM bk JOIN cu ON cu.id = bk.customer LEFT JOIN cat m ON m.booking = bk.id AND m.i = 1
"""


@register("d1_registration", _D1_SQL)
def d1_registration(spark, sf_dir):
    """D1 + E10: guest registration record of every booking (first guest main,
    others companions, customer as adult when no guest)."""
    m = load_model(spark, sf_dir)
    f = EX.registration_forms(m.bookings, m.customers)
    comp = F.array_join(F.transform("begleitperson", lambda p: F.concat_ws(
        "|", p["kategorie"], p["name"], p["vorname"])), ";")
    return f.select("id", "hotelid", "anreise", "abreise", "strasse", "hausnummer", "plz", "ort",
                    "land", "kategorie", "name", "vorname", comp.alias("begleitpersonen"))


def _recipient_sql() -> str:
    return ("concat_ws(chr(10), '<br/>', cu.given || ' ' || cu.family, '<br/>', cu.street, '<br/>', "
            "cu.country_code || '-' || cu.postal_code || ' ' || cu.city)")


def _body_sql(parts: str) -> str:
    return (f"concat_ws(chr(10), '<p>' || coalesce(lt.letter, '') || ' ' || cu.family || ',</p>', "
            f"{parts}, '<br/>', '<p>Mit freundlichen Grüßen</p>', '<p>' || 'Ihre Gastgeber' || '</p>')")


@register("d3_confirmation_letters", LEGACY_SQL + f"""
, li AS (
  SELECT booking,
         '<ul>' || string_agg('<li>' || CAST(beds AS VARCHAR) || ' '
           || CASE WHEN beds < 2 THEN 'Person' ELSE 'Personen' END || ' im ' || description || ' '
           || CASE WHEN beds < 2 THEN 'für' ELSE 'zu je' END || ' ' || {money_sql('price_per_bed')}
           || ' € pro Nacht'
           || CASE WHEN cnt - slot = 0 THEN '' WHEN cnt - slot = 1 THEN ' und' ELSE ',' END || '</li>',
           '' ORDER BY slot) || '</ul>' AS ul
  FROM (SELECT *, count(*) OVER (PARTITION BY booking) AS cnt FROM alr) GROUP BY booking
)
SELECT bk.id, 'Reservierungsbestätigung' AS subject, {_recipient_sql()} AS recipient,
       {_body_sql(
           "'<p>vielen Dank für Ihre Bestellung. Hiermit bestätigen wir Ihre Zimmerreservierung über</p>', "
           "coalesce(li.ul, '<ul></ul>'), "
           "'<p>für den Zeitraum vom ' || " + period_sql('bk.arrival', 'bk.departure')
           + " || '. Unsere Preise beinhalten Frühstück vom Buffet.</p>', "
           "'<p>' || CASE WHEN bk.deposit_asked IS NULL THEN 'In Ihrem Fall verzichten wir auf eine "
           "Anzahlung, möchten Sie jedoch bitten, uns rechtzeitig abzusagen, falls bei Ihnen etwas "
           "dazwischen kommen sollte, damit wir das Zimmer noch anderweitig vermieten können. Danke "
           "schön!' ELSE 'Bitte überweisen Sie eine Anzahlung in Höhe von ' || "
           + money_sql('bk.deposit_asked') + " || ' € auf unten angegebenes Konto. Wir erbeten eine "
           "Zahlung innerhalb von 14 Tagen. Nach Eingang Ihrer Anzahlung gilt Ihre Reservierung als "
           "endgültig bestätigt.' END || '</p>', "
           "'<p>Es wäre schön, wenn Sie uns kurz vor Ihrem Aufenthalt Ihre ungefähre Ankunftszeit "
           "mitteilen könnten. Danke schön!</p>'")} AS body
FROM bk JOIN cu ON cu.id = bk.customer LEFT JOIN lt ON lt.title = cu.title
LEFT JOIN li ON li.booking = bk.id
""")
def d3_confirmation_letters(spark, sf_dir):
    """D3 + E4 + E8 + E18 + E19: reservation confirmation letter of every booking."""
    m = load_model(spark, sf_dir)
    c = EX.confirmation_letters(m.bookings, m.customers, LETTER_DATE)
    return c.select("id", "letter.subject", "letter.recipient", "letter.body")


_TDR = '<td style="text-align:right">'


@register("d4_invoice_letters", _RULES + f"""
, pl AS (
  SELECT po.*, row_number() OVER (PARTITION BY booking ORDER BY grp, ln, pk, sk, q) AS pos,
         CASE WHEN tax = 'Reduced7With3EuroDrinks19' THEN 1 ELSE 0 END AS kind,
         CASE tax WHEN 'General19' THEN 19 WHEN 'Reduced7' THEN 7 WHEN 'Legacy' THEN legacy_rate END AS rate
  FROM po
), lines AS (
  SELECT pl.booking, 1 AS sec, pl.pos AS k,
         '<tr><td>' || CAST(pl.quantity AS VARCHAR) || 'x</td><td>' || pl.description || '</td>{_TDR}' || l.label
           || '</td>{_TDR}' || {money_sql('pl.price')} || '€</td>{_TDR}'
           || {money_sql('CAST(pl.quantity AS BIGINT) * pl.price')} || '€</td></tr>' AS line
  FROM pl JOIN labelled l ON l.booking = pl.booking AND l.kind = pl.kind
    AND l.rate IS NOT DISTINCT FROM pl.rate
  UNION ALL
  SELECT l.booking, 3, ascii(l.label),
         CASE WHEN l.kind = 0 THEN '<div><strong>' || l.label || '</strong></div><div class="tax-rate">' || CAST(l.rate AS VARCHAR)
              || '%</div><div class="tax-value">' || {money_sql('CAST(floor((2 * s.s * l.rate + (100 + l.rate)) / (2 * (100 + l.rate))) AS BIGINT)')} || '€</div><div></div>'
              ELSE '<div><strong>' || l.label || '</strong></div><div class="tax-split">Enthält 3,00€ Getränke-Anteil pro Frühstück zu 19%, Rest 7%</div>' END
  FROM labelled l LEFT JOIN sums s ON s.booking = l.booking AND s.rate = l.rate
), tot AS (
  SELECT inv.booking, coalesce(sum(CAST(po.quantity AS BIGINT) * po.price), 0) AS total,
         coalesce(bk.deposit_got, 0) AS dep
  FROM inv JOIN bk ON bk.id = inv.booking LEFT JOIN po ON po.booking = inv.booking
  GROUP BY inv.booking, bk.deposit_got
), all_lines AS (
  SELECT booking, sec, k, line FROM lines
  UNION ALL SELECT booking, 2, 1, '<tr><td></td><td></td><td></td><th style="text-align:right">Summe</th>{_TDR}' || {money_sql('total')} || '€</td></tr>' FROM tot
  UNION ALL SELECT booking, 2, 2, '<tr><td></td><td></td><td></td><th style="text-align:right">Anzahlung</th>{_TDR}' || {money_sql('dep')} || '€</td></tr>' FROM tot
  UNION ALL SELECT booking, 2, 3, '<tr><td></td><td></td><td></td><th style="text-align:right">Restsumme</th>{_TDR}' || {money_sql('total - dep')} || '€</td></tr>' FROM tot
)
SELECT inv.booking AS id, '' AS sender, '' AS attachments, 'Rechnung' AS subject,
       replace(inv.recipient, chr(10), '<br>') AS recipient,
       concat_ws(chr(10) || '<br/>' || chr(10),
                 CASE WHEN inv.invoice_no IS NOT NULL THEN '<b>Rechnungsnummer</b><br/>' || inv.invoice_no END,
                 '<b>Rechnungs-Datum</b><br/>' || {local_date_sql('inv.invoice_date')},
                 '<b>Abreise-Datum</b><br/>' || {local_date_sql('inv.departure')}) AS sidebar,
       '<p>' || 'Für Ihren Aufenthalt vom ' || {period_sql('bk.arrival', 'bk.departure')}
         || ' stellen wir die folgenden Positionen in Rechnung.' || '</p>' || chr(10) || '<table style="width:100%"><thead><tr>'
         || '<th style="text-align:left">Anzahl</th><th style="text-align:left">Beschreibung</th>'
         || '<th style="text-align:right">Steuer</th><th style="text-align:right">Einzelpreis</th>'
         || '<th style="text-align:right">Preis</th></tr></thead>' || chr(10)
         || (SELECT string_agg(line, chr(10) ORDER BY sec, k) FROM all_lines a WHERE a.booking = inv.booking AND sec < 3)
         || chr(10) || '</table>' || chr(10)
         || '<div class="tax-grid"><div class="tax-header"><strong>enthaltene Mehrwertsteuer</strong></div>' || chr(10)
         || coalesce((SELECT string_agg(line, chr(10) ORDER BY sec, k) FROM all_lines a WHERE a.booking = inv.booking AND sec = 3), '')
         || chr(10) || '</div>' || chr(10) || '<p>Wir hoffen, dass es Ihnen bei uns gefallen hat und freuen uns, wenn Sie uns wieder einmal besuchen.</p>' AS body
FROM inv JOIN bk ON bk.id = inv.booking
""")
def d4_invoice_letters(spark, sf_dir):
    """D4 + A4 + A7 + W3: invoice letter of every stored invoice."""
    return EX.invoice_letters(load_model(spark, sf_dir).bookings)


_FLYER_SQL = f"""
, letters AS (
  SELECT cu.id, 'Gästehaus, Musterweg 1, D-12345 Musterstadt' AS sender,
         {_recipient_sql()} AS recipient, '<p>{LETTER_DATE}</p>' AS sidebar, 'Hausprospekt' AS subject,
         {_body_sql(
             "'<p>wir freuen uns sehr über Ihr Interesse an unserem Haus und darüber dass Sie Ihren "
             "Urlaub bei uns verbringen wollen. Anbei erhalten Sie die gewünschten Unterlagen.</p>', "
             "'<p>Wir hoffen, dass Ihnen unser Haus zusagt und freuen uns über Ihren Anruf oder Ihre "
             "schriftliche Zimmerreservierung.</p>'")} AS body,
         '<p><b>Anlagen:</b><br/>Hausprospekt, Preisliste</p>' AS attachments
  FROM cu LEFT JOIN lt ON lt.title = cu.title
)
"""
_LT = """
, lt AS (SELECT * FROM (VALUES ('Herrn', 'Sehr geehrter Herr'),
    ('Herrn und Frau', 'Sehr geehrte Frau, sehr geehrter Herr'), ('Frau', 'Sehr geehrte Frau'),
    ('Herrn Dr.', 'Sehr geehrter Herr Dr.'), ('Frau Dr.', 'Sehr geehrte Frau Dr.'),
    ('Familie', 'Liebe Familie')) v(title, letter))
"""


@register("d5_mailing", _LT + _FLYER_SQL + """
SELECT id, subject, recipient, body, attachments FROM letters
""")
def d5_mailing(spark, sf_dir):
    """D5 + E19: brochure mailing letter for every customer."""
    c = EX.mailing(load_model(spark, sf_dir).customers, LETTER_DATE, "flyer")
    return c.select("id", "letter.subject", "letter.recipient", "letter.body", "letter.attachments")


_BLANK_SQL = f"""
, letters AS (
  SELECT cu.id, {_recipient_sql()} AS recipient, '<p>{LETTER_DATE}</p>' AS sidebar, 'Betreff' AS subject,
         {_body_sql("'<p>...</p>'")} AS body, '' AS attachments
  FROM cu LEFT JOIN lt ON lt.title = cu.title
)
"""


@register("d5_blank_letter", _LT + _BLANK_SQL + """
SELECT id, subject, recipient, sidebar, body, attachments FROM letters
""")
def d5_blank_letter(spark, sf_dir):
    """The blank letter for every customer, to be filled in by hand."""
    c = EX.mailing(load_model(spark, sf_dir).customers, LETTER_DATE, "blank")
    return c.select("id", "letter.subject", "letter.recipient", "letter.sidebar", "letter.body", "letter.attachments")


@register("d6_letter_payload", _LT + _FLYER_SQL + """
SELECT id, to_base64(encode(CAST(to_json({'sender': sender, 'recipient': recipient, 'sidebar': sidebar,
       'subject': subject, 'body': body, 'attachments': attachments}) AS VARCHAR))) AS payload
FROM letters
""")
def d6_letter_payload(spark, sf_dir):
    """Letter record as base64 of its JSON text (the letter page's payload)."""
    c = EX.mailing(load_model(spark, sf_dir).customers, LETTER_DATE, "flyer")
    return c.select("id", EX.letter_payload(F.col("letter")).alias("payload"))


@register("d1_registration_xml", _D1_SQL)
def d1_registration_xml(spark, sf_dir):
    """D1 through the XML sink: the registration records written once as XML
    (``meldeschein`` rows, companions as repeated ``begleitperson`` elements) in
    the shared folder and read back with the XML reader and an explicit schema."""
    from pyspark.sql import types as T
    from innkeep.sources.fixtures import model_location
    from innkeep.sources.shared import publish_once
    m = load_model(spark, sf_dir)
    forms = EX.registration_forms(m.bookings, m.customers)
    loc = model_location(spark, sf_dir)
    path = publish_once(spark, f"{loc}/registrations-xml-v1",
                        lambda p: EX.write_registration_xml(forms, p, keep_id=True))
    person = T.StructType([T.StructField(n, T.StringType())
                           for n in ("kategorie", "name", "vorname")])
    schema = T.StructType(
        [T.StructField("id", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in
           ("hotelid", "anreise", "abreise", "strasse", "hausnummer", "plz", "ort", "land",
            "kategorie", "name", "vorname")]
        + [T.StructField("begleitperson", T.ArrayType(person))])
    forms = (spark.read.format("xml").option("rowTag", "meldeschein").schema(schema)
             .load(path))
    comp = F.array_join(F.transform(F.coalesce("begleitperson", F.array()), lambda p: F.concat_ws(
        "|", p["kategorie"], p["name"], p["vorname"])), ";")
    return forms.select("id", "hotelid", "anreise", "abreise", "strasse", "hausnummer", "plz",
                        "ort", "land", "kategorie", "name", "vorname",
                        comp.alias("begleitpersonen"))
