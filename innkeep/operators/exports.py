"""Per-booking documents as batch jobs: interchange text, registration records,
letters, and the letter payload.

All are row-local projections over bookings ⋈ customers (one join), written
with the text/JSON/XML sinks; the nested arrays of a booking are handled with
higher-order functions (sorting, grouping identical lines, top 3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.functions import guests as G
from innkeep.functions.money import format_money, format_money_dot
from innkeep.functions.periods import local_date, period_text
from innkeep.functions.text import alloc_phrase
from innkeep.functions.util import let, printed
from innkeep.operators import invoices as INV
from innkeep.operators.stays import has_invoice, with_customer

# First line of the interchange record and the property id of
# the registration records.
INTERCHANGE_HEADER = "2014_EXCEL_BR_V2_pQ06eaXd"
PROPERTY_ID = "0550"
# Sender line and signature of the letters: settings of the business running the
# library (neutral defaults; pass your own to the letter functions).
SENDER = "Gästehaus, Musterweg 1, D-12345 Musterstadt"
SIGNER = "Ihre Gastgeber"
# Letter texts.
GREETING = "Mit freundlichen Grüßen"
CONFIRM_SUBJECT = "Reservierungsbestätigung"
CONFIRM_INTRO = ("vielen Dank für Ihre Bestellung. Hiermit bestätigen wir Ihre "
                 "Zimmerreservierung über")
CONFIRM_PERIOD = "für den Zeitraum vom %s. Unsere Preise beinhalten Frühstück vom Buffet."
CONFIRM_NO_DEPOSIT = ("In Ihrem Fall verzichten wir auf eine Anzahlung, möchten Sie jedoch "
                      "bitten, uns rechtzeitig abzusagen, falls bei Ihnen etwas dazwischen "
                      "kommen sollte, damit wir das Zimmer noch anderweitig vermieten können. "
                      "Danke schön!")
CONFIRM_DEPOSIT = ("Bitte überweisen Sie eine Anzahlung in Höhe von %s € auf unten angegebenes "
                   "Konto. Wir erbeten eine Zahlung innerhalb von 14 Tagen. Nach Eingang Ihrer "
                   "Anzahlung gilt Ihre Reservierung als endgültig bestätigt.")
CONFIRM_ARRIVAL = ("Es wäre schön, wenn Sie uns kurz vor Ihrem Aufenthalt Ihre ungefähre "
                   "Ankunftszeit mitteilen könnten. Danke schön!")
FLYER_SUBJECT = "Hausprospekt"
FLYER_ATTACHMENTS = "Hausprospekt, Preisliste"
FLYER_BODY = ("wir freuen uns sehr über Ihr Interesse an unserem Haus und darüber dass Sie "
              "Ihren Urlaub bei uns verbringen wollen. Anbei erhalten Sie die gewünschten "
              "Unterlagen.", "Wir hoffen, dass Ihnen unser Haus zusagt und freuen uns über Ihren "
              "Anruf oder Ihre schriftliche Zimmerreservierung.")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def item_groups(allocs="data.allocs") -> Column:
    """Identical room lines (room ignored) counted, largest (price, beds,
    description) first: ARRAY<STRUCT<n, price_per_bed, beds, description>>."""
    items = F.transform(_c(allocs), lambda a: F.struct(a["price_per_bed"].alias("price_per_bed"),
                                                       a["beds"].alias("beds"),
                                                       a["description"].alias("description")))
    distinct = F.sort_array(F.array_distinct(items), asc=False)
    return F.transform(distinct, lambda x: F.struct(
        F.size(F.filter(items, lambda y: y == x)).alias("n"),
        x["price_per_bed"].alias("price_per_bed"), x["beds"].alias("beds"),
        x["description"].alias("description")))


def top_items(groups: Column, k: int = 3) -> Column:
    """The first k item groups spread into fields item{i}_n, _description,
    _price, _percent (empty text when missing); the groups are bound once."""
    def spread(gs):
        fields = []
        for i in range(1, k + 1):
            g = F.try_element_at(gs, F.lit(i))
            fields += [F.coalesce(g["n"].cast("string"), F.lit("")).alias(f"item{i}_n"),
                       F.coalesce(g["description"], F.lit("")).alias(f"item{i}_description"),
                       F.coalesce(format_money_dot(g["price_per_bed"]), F.lit(""))
                       .alias(f"item{i}_price"),
                       F.coalesce((g["beds"] * 100).cast("string"), F.lit(""))
                       .alias(f"item{i}_percent")]
        return F.struct(*fields)

    return let(groups, spread)


def interchange_text(data="data", cdata="customer_data", arrival="arrival",
                     departure="departure") -> Column:
    """The 30-line interchange record of a booking (item groups and the
    tax-payer count are computed once per booking)."""
    d, c = _c(data), _c(cdata)

    def render(groups, payers):
        no_tax = (payers < 1) | d["tax_free"]

        def item(i, with_percent=True):
            g = F.try_element_at(groups, F.lit(i + 1))
            out = [F.coalesce(g["n"].cast("string"), F.lit("")),
                   F.coalesce(g["description"], F.lit("")),
                   F.coalesce(format_money_dot(g["price_per_bed"]), F.lit(""))]
            if with_percent:
                out.append(F.coalesce((g["beds"] * 100).cast("string"), F.lit("")))
            return out

        lines = [F.lit(INTERCHANGE_HEADER),
                 F.coalesce(F.try_element_at(d["allocs"], F.lit(1))["room"], F.lit("")),
                 c["name"]["title"], c["name"]["letter"], c["name"]["family"], c["name"]["given"],
                 F.lit(""), F.lit(""),
                 c["address"]["country_code"], c["address"]["postal_code"], c["address"]["city"],
                 c["address"]["street_with_num"], c["contact"]["phone"],
                 local_date(arrival), local_date(departure),
                 *item(0), *item(1), *item(2, with_percent=False),
                 F.when(d["tax_free"], F.lit("0")).otherwise(payers.cast("string")),
                 F.when(no_tax, F.lit("")).otherwise(F.lit("Kurtaxe")),
                 F.when(no_tax, F.lit("0.00")).otherwise(F.lit("2.00")),
                 format_money_dot(F.coalesce(d["deposit_got"], F.lit(0).cast("bigint")))]
        return F.concat_ws("\n", *lines)

    return let(item_groups(d["allocs"]), lambda groups: let(
        G.tax_payer_count(d["guests"], departure), lambda payers: render(groups, payers)))


def interchange(bookings: DataFrame, customers: DataFrame) -> DataFrame:
    """D2 for every booking: id, text (30 lines)."""
    j = with_customer(bookings.select("id", "customer", "data", "arrival", "departure"), customers)
    return j.select("id", interchange_text().alias("text"))


def registration_forms(bookings: DataFrame, customers: DataFrame,
                       property_id: str = PROPERTY_ID) -> DataFrame:
    """Guest registration record per booking: the first guest is the main
    person, the others companions; without guests the customer is the adult main
    person.  Categories use the departure date (7 < 6 years, 8 < 15, else 1)."""
    j = with_customer(bookings.select("id", "customer", "data", "arrival", "departure"), customers)
    c = F.col("customer_data")
    guests = F.col("data.guests")
    dep = F.col("departure")

    def person(g):
        return F.struct(G.age_category(g["born"], dep).alias("kategorie"),
                        g["family"].alias("name"), g["given"].alias("vorname"))

    first = F.try_element_at(guests, F.lit(1))
    main = F.when(first.isNull(), F.struct(F.lit("1").alias("kategorie"),
                                           c["name"]["family"].alias("name"),
                                           c["name"]["given"].alias("vorname"))) \
        .otherwise(person(first))
    companions = F.transform(F.slice(guests, 2, F.greatest(F.size(guests) - 1, F.lit(0))), person)
    return j.select(
        "id", F.lit(property_id).alias("hotelid"),
        F.col("arrival").cast("string").alias("anreise"),
        F.col("departure").cast("string").alias("abreise"),
        c["address"]["street_with_num"].alias("strasse"), F.lit(".").alias("hausnummer"),
        c["address"]["postal_code"].alias("plz"), c["address"]["city"].alias("ort"),
        c["address"]["country"].alias("land"),
        main["kategorie"].alias("kategorie"), main["name"].alias("name"),
        main["vorname"].alias("vorname"), companions.alias("begleitperson"))


def write_registration_xml(forms: DataFrame, path: str, keep_id: bool = False, rows_per_file: int = 50_000) -> None:
    """Registration records as XML (one ``meldeschein`` element per booking;
    companions repeat as ``begleitperson`` elements; text is escaped).  The
    booking id is not part of the record unless ``keep_id``.  An XML file is read by one task, so it
    holds at most ``rows_per_file`` records."""
    out = forms if keep_id else forms.drop("id")
    (out.write.mode("overwrite").format("xml").option("maxRecordsPerFile", rows_per_file)
     .option("rootTag", "meldescheine").option("rowTag", "meldeschein").save(path))


def escape_html(x) -> Column:
    """Text as HTML: ``&``, ``<``, ``>`` and double quotes as entities."""
    c = _c(x)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):   # fixed values
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def _p(text: Column) -> Column:
    return F.concat(F.lit("<p>"), text, F.lit("</p>"))


def _letter(subject: Column, body_parts: list[Column], cdata: Column, sidebar: Column,
            attachments: Column, sender: str = SENDER, signer: str = SIGNER) -> Column:
    """Letter record (sender, recipient, sidebar, subject, body, attachments)."""
    recipient = F.concat_ws("\n", F.lit("<br/>"),
                            escape_html(F.format_string("%s %s", cdata["name"]["given"], cdata["name"]["family"])),
                            F.lit("<br/>"), escape_html(cdata["address"]["street_with_num"]), F.lit("<br/>"),
                            escape_html(F.format_string("%s-%s %s", cdata["address"]["country_code"],
                                                        cdata["address"]["postal_code"],
                                                        cdata["address"]["city"])))
    opening = _p(escape_html(F.format_string("%s %s,", cdata["name"]["letter"], cdata["name"]["family"])))
    body = F.concat_ws("\n", opening, *body_parts, F.lit("<br/>"), _p(F.lit(GREETING)),
                       _p(F.lit(signer)))
    return F.struct(F.lit(sender).alias("sender"), recipient.alias("recipient"),
                    sidebar.alias("sidebar"), subject.alias("subject"), body.alias("body"),
                    attachments.alias("attachments"))


def confirmation_letters(bookings: DataFrame, customers: DataFrame, letter_date: str,
                         sender: str = SENDER, signer: str = SIGNER) -> DataFrame:
    """D3: reservation confirmation per booking: enumerated room lines (commas,
    "und" before the last), the period, and a deposit paragraph when one is asked."""
    j = with_customer(bookings.select("id", "customer", "data", "arrival", "departure"), customers)
    d = F.col("data")
    n = F.size(d["allocs"])
    items = F.transform(d["allocs"], lambda a, i: F.concat(
        F.lit("<li>"), escape_html(alloc_phrase(a)),
        F.when(n - i == 1, F.lit("")).when(n - i == 2, F.lit(" und")).otherwise(F.lit(",")),
        F.lit("</li>")))
    deposit = F.when(d["deposit_asked"].isNull(), F.lit(CONFIRM_NO_DEPOSIT)) \
        .otherwise(F.format_string(CONFIRM_DEPOSIT, format_money(d["deposit_asked"])))
    body = [_p(F.lit(CONFIRM_INTRO)),
            F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>")),
            _p(F.format_string(CONFIRM_PERIOD, period_text("arrival", "departure"))),
            _p(deposit), _p(F.lit(CONFIRM_ARRIVAL))]
    letter = _letter(F.lit(CONFIRM_SUBJECT), body, F.col("customer_data"),
                     _p(F.lit(letter_date)), F.lit(""), sender, signer)
    return j.select("id", letter.alias("letter"))


# Headings and labels of the invoice letter.
INVOICE_HEADINGS = (("left", "Anzahl"), ("left", "Beschreibung"), ("right", "Steuer"), ("right", "Einzelpreis"),
                    ("right", "Preis"))
INVOICE_SUMS = ("Summe", "Anzahlung", "Restsumme")
INCLUDED_TAX = "enthaltene Mehrwertsteuer"
_RIGHT = ' style="text-align:right"'


def _cell(text, right: bool = False) -> Column:
    return F.concat(F.lit(f"<td{_RIGHT if right else ''}>"), text, F.lit("</td>"))


def _euro(cents) -> Column:
    return F.concat(format_money(cents), F.lit("€"))


def invoice_body(invoice="data.invoice") -> Column:
    """The letter's body: intro, table of positions with tax labels and sums, the
    included taxes (rate and amount, or the split text), closing.  The tax table,
    labels and sum are bound once per invoice."""
    inv = _c(invoice)
    heading = "".join(f'<th style="text-align:{side}">{name}</th>' for side, name in INVOICE_HEADINGS)

    def row(cells):
        return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))

    def render(table, labels, total):
        positions = F.transform(inv["positions"], lambda p, i: row([
            _cell(F.concat(printed(p["quantity"]), F.lit("x"))), _cell(escape_html(p["description"])),
            _cell(labels[i], True), _cell(_euro(p["price"]), True),
            _cell(_euro(p["quantity"].cast("bigint") * p["price"]), True)]))
        amounts = (total, inv["deposit"], total - inv["deposit"])
        sums = F.array(*[row([F.lit("<td></td>" * 3 + f"<th{_RIGHT}>{name}</th>"), _cell(_euro(x), True)])
                         for name, x in zip(INVOICE_SUMS, amounts)])
        taxes = F.transform(table, lambda r: F.concat(
            F.lit("<div><strong>"), r["label"], F.lit("</strong></div>"),
            F.when(r["kind"] == 0, F.concat(
                F.lit('<div class="tax-rate">'), printed(r["rate"]), F.lit('%</div><div class="tax-value">'),
                _euro(r["tax_cents"]), F.lit("</div><div></div>")))
            .otherwise(F.concat(F.lit('<div class="tax-split">'), escape_html(r["description"]), F.lit("</div>")))))
        return F.concat_ws(
            "\n", _p(escape_html(inv["intro"])),
            F.lit(f'<table style="width:100%"><thead><tr>{heading}</tr></thead>'), F.array_join(
                F.concat(positions, sums), "\n"), F.lit("</table>"),
            F.lit(f'<div class="tax-grid"><div class="tax-header"><strong>{INCLUDED_TAX}</strong></div>'),
            F.array_join(taxes, "\n"), F.lit("</div>"), _p(escape_html(inv["closing"])))

    return let(INV.tax_rows(inv), lambda table: let(
        INV.labels_for(inv["positions"], table), lambda labels: let(
            INV.invoice_sum(inv), lambda total: render(table, labels, total))))


def invoice_letters(bookings: DataFrame) -> DataFrame:
    """The letter record of each stored invoice (sender and attachments empty)."""
    inv = F.col("data.invoice")
    fact = [F.when(value.isNotNull(), F.concat(F.lit(f"<b>{name}</b><br/>"), escape_html(value))) for name, value in
            (("Rechnungsnummer", inv["id"]), ("Rechnungs-Datum", local_date(inv["invoice_date"])),
             ("Abreise-Datum", local_date(inv["departure_date"])))]      # fixed values: names of the facts
    return (has_invoice(bookings)
            .select("id", F.lit("").alias("sender"), inv["title"].alias("subject"),
                    F.regexp_replace(inv["recipient"], "\n", "<br>").alias("recipient"),
                    F.concat_ws("\n<br/>\n", *fact).alias("sidebar"), invoice_body(inv).alias("body"),
                    F.lit("").alias("attachments")))


def mailing(customers: DataFrame, letter_date: str, kind: str = "flyer",
            sender: str = SENDER, signer: str = SIGNER) -> DataFrame:
    """Mailing letters (``blank`` or ``flyer``) for every customer."""
    c = F.col("data")
    if kind == "flyer":
        body = [_p(F.lit(FLYER_BODY[0])), _p(F.lit(FLYER_BODY[1]))]
        subject, att = F.lit(FLYER_SUBJECT), F.lit(f"<p><b>Anlagen:</b><br/>{FLYER_ATTACHMENTS}</p>")
    else:
        body, subject, att = [_p(F.lit("..."))], F.lit("Betreff"), F.lit("")
    letter = _letter(subject, body, c, _p(F.lit(letter_date)), att, sender, signer)
    return customers.select("id", letter.alias("letter"))


def letter_payload(letter: Column) -> Column:
    """The letter record as base64 of its JSON text (one line, no MIME breaks)."""
    return F.regexp_replace(F.base64(F.encode(F.to_json(letter), "UTF-8")), r"[\r\n]", "")
