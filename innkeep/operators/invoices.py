"""Invoicing: generation, positions, totals, booking summary and the tax table.

Everything here is row-local: an invoice lives nested in its booking, so the
positions, rules, labels and tax sums are computed with higher-order functions
on the row (no shuffle, stays in whole-stage code generation).  Only the final
``explode`` turns the per-invoice tax rows into output rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep import schemas
from innkeep.functions import guests as G
from innkeep.functions import money as M
from innkeep.functions import rooms as R
from innkeep.functions import taxes as TX
from innkeep.functions.periods import period_text
from innkeep.functions.text import recipient_block
from innkeep.functions.util import let, printed, spread

# Texts of a generated invoice.
TITLE = "Rechnung"
INTRO = "Für Ihren Aufenthalt vom %s stellen wir die folgenden Positionen in Rechnung."
CLOSING = ("Wir hoffen, dass es Ihnen bei uns gefallen hat und freuen uns, wenn Sie uns "
           "wieder einmal besuchen.")
STAY_DESCRIPTION = "Übernachtung im "
LOCAL_TAX_DESCRIPTION = "Kurtaxe"
ACTIVE_CODES = [TX.GENERAL19, TX.REDUCED7, TX.SPLIT]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def invoice_number(rooms: Column, departure) -> Column:
    """``yymmdd-room`` from the smallest room; year is ``year % 1000`` (so 1997 -> 997,
    2005 -> 05); a numeric room is padded to three digits; null without a room."""
    dep = _c(departure)

    def number(first):
        room = (F.when(first.rlike(r"^[+-]?[0-9]+$"),
                       F.format_string("%03d", first.try_cast("bigint")))
                .otherwise(first))
        return F.when(first.isNotNull(),
                      F.format_string("%02d%02d%02d-%s", F.year(dep) % 1000, F.month(dep),
                                      F.dayofmonth(dep), room))

    return let(R.first_room(rooms), number)


def _position(quantity, description, price, tax, legacy_rate=None) -> Column:
    """An invoice position struct; ``tax`` is a code name or a Column."""
    tax_col = F.lit(tax) if isinstance(tax, str) else tax
    rate_col = F.lit(None) if legacy_rate is None else legacy_rate
    return F.struct(
        quantity.cast("int").alias("quantity"), description.alias("description"),
        price.cast("bigint").alias("price"), tax_col.cast("string").alias("tax"),
        rate_col.cast("int").alias("legacy_rate"),
    )


def invoice_positions(data="data", arrival="arrival", departure="departure",
                      room_tax: Column | None = None) -> Column:
    """Room lines (split tax) plus the local-tax line, quantities times nights.

    ``room_tax`` optionally overrides the tax code of the room lines (a struct
    ``tax, legacy_rate``), as stored invoices may carry older codes.  The
    tax-payer count is bound once per booking.
    """
    d = _c(data)
    n = F.datediff(_c(departure), _c(arrival))

    def room_line(a):
        tax = F.lit(TX.SPLIT) if room_tax is None else room_tax["tax"]
        rate = None if room_tax is None else room_tax["legacy_rate"]
        return _position(a["beds"] * n, F.concat(F.lit(STAY_DESCRIPTION), printed(a["description"])),
                         a["price_per_bed"], tax, rate)

    def with_payers(payers):
        local = F.array(_position(payers * n, F.lit(LOCAL_TAX_DESCRIPTION),
                                  TX.local_tax_cents(departure), TX.REDUCED7))
        empty = F.array_repeat(local[0], 0)
        return F.concat(F.transform(d["allocs"], room_line),
                        F.when((payers > 0) & ~d["tax_free"], local).otherwise(empty))

    return let(G.tax_payer_count(d["guests"], departure), with_payers)


def invoice_document(data="data", customer_data="customer_data", arrival="arrival",
                     departure="departure", invoice_date=None,
                     recipient: Column | None = None,
                     room_tax: Column | None = None) -> Column:
    """Generate the invoice document of a booking (STRUCT of ``schemas.INVOICE``);
    the booking's room tokens are bound once."""
    d = _c(data)
    inv_date = F.lit(None).cast("date") if invoice_date is None else _c(invoice_date)
    return F.struct(
        let(R.rooms_of(d["allocs"]), lambda rooms: invoice_number(rooms, departure)).alias("id"),
        (recipient_block(customer_data) if recipient is None else recipient).alias("recipient"),
        inv_date.cast("date").alias("invoice_date"),
        _c(departure).alias("departure_date"),
        F.lit(TITLE).alias("title"),
        F.format_string(INTRO, period_text(arrival, departure)).alias("intro"),
        invoice_positions(d, arrival, departure, room_tax).alias("positions"),
        F.lit(CLOSING).alias("closing"),
        M.default_zero(d["deposit_got"]).alias("deposit"),
    )


def generate_invoices(bookings: DataFrame, customers: DataFrame, invoice_date=None) -> DataFrame:
    """Booking ⋈ customer -> booking id with a freshly generated invoice."""
    b = bookings.select("id", "customer", "data", "arrival", "departure")
    c = customers.select(F.col("id").alias("customer"), F.col("data").alias("customer_data"))
    joined = b.join(c, "customer", "inner")
    date = F.lit(invoice_date).cast("date") if isinstance(invoice_date, str) else invoice_date
    return joined.select("id", "customer",
                         invoice_document("data", "customer_data", invoice_date=date)
                         .alias("invoice"))


def position_total(p: Column) -> Column:
    return p["quantity"].cast("bigint") * p["price"]


def invoice_sum(invoice="data.invoice") -> Column:
    return F.aggregate(_c(invoice)["positions"], F.lit(0).cast("bigint"),
                       lambda acc, p: acc + position_total(p))


def _invoiced(bookings: DataFrame) -> DataFrame:
    """Bookings with a stored invoice (the pushed-down flag when the table has it)."""
    from innkeep.operators.stays import has_invoice
    return has_invoice(bookings)


def invoice_totals(bookings: DataFrame) -> DataFrame:
    """Per stored invoice: sum of quantity x price, deposit, rest."""
    inv = F.col("data.invoice")
    return (_invoiced(bookings)
            .select(F.col("id"), inv["id"].alias("invoice_no"),
                    F.size(inv["positions"]).alias("n_positions"),
                    invoice_sum(inv).alias("total"),
                    inv["deposit"].alias("deposit"))
            .withColumn("rest", F.col("total") - F.col("deposit")))


def summarise(bookings: DataFrame) -> DataFrame:
    """Guest count, tax-payer count and rooms of every booking."""
    facts = let(R.rooms_of("data.allocs"), lambda rooms: F.struct(
        R.rooms_text(rooms).alias("rooms"), R.first_room(rooms).alias("first_room")))
    return bookings.select(
        "id",
        G.guest_count("data.guests").alias("guests"),
        G.tax_payer_count("data.guests", "departure").alias("tax_payers"),
        spread(facts),
    )


def _rule_of(p: Column) -> Column:
    """Tax rules a position needs in the table: its own rule, and for the split
    rule also the simple 7 % and 19 % rows.  kind 0 = simple rate, 1 = split."""
    simple = F.array(F.struct(F.lit(0).alias("kind"),
                              TX.simple_rate(p["tax"], p["legacy_rate"]).alias("rate")))
    split = F.array(F.struct(F.lit(0).alias("kind"), F.lit(7).alias("rate")),
                    F.struct(F.lit(0).alias("kind"), F.lit(19).alias("rate")),
                    F.struct(F.lit(1).alias("kind"), F.lit(None).cast("int").alias("rate")))
    return F.when(p["tax"] == TX.SPLIT, split).otherwise(simple)


def tax_rows(invoice="data.invoice") -> Column:
    """ARRAY<STRUCT<label, kind, rate, description, tax_cents>> of one invoice.

    Rows: simple rates ascending, then the split rule; labels A, B, C… in that
    order.  The tax of a rate is Σ gross·r/(100+r) over all parts at that rate,
    rounded once (half up) in integer arithmetic.
    """
    positions = _c(invoice)["positions"]
    rules = F.array_sort(F.array_distinct(F.flatten(F.transform(positions, _rule_of))))

    def row(rule, i, parts):
        gross = F.aggregate(parts, F.lit(0).cast("bigint"),
                            lambda acc, x: acc + F.when(x["rate"] == rule["rate"], x["gross"])
                            .otherwise(F.lit(0).cast("bigint")))
        return F.struct(
            F.chr(F.lit(65) + i).alias("label"),
            rule["kind"].alias("kind"),
            rule["rate"].alias("rate"),
            F.when(rule["kind"] == 0, F.concat(printed(rule["rate"]), F.lit("%")))
            .otherwise(F.lit(TX.SPLIT_DESCRIPTION)).alias("description"),
            F.when(rule["kind"] == 0, let(gross, lambda s: TX.included_tax_cents(s, rule["rate"])))
            .otherwise(F.lit(0).cast("bigint")).alias("tax_cents"),
        )

    # the taxed parts are bound once per invoice, not recomputed per rule
    return let(F.flatten(F.transform(positions, TX.tax_parts)),
               lambda parts: F.transform(rules, lambda rule, i: row(rule, i, parts)))


def tax_table(bookings: DataFrame) -> DataFrame:
    """One row per invoice and tax rule (stored invoices only)."""
    inv = F.col("data.invoice")
    rows = (_invoiced(bookings)
            .select("id", inv["id"].alias("invoice_no"), F.explode(tax_rows(inv)).alias("t")))
    return rows.select("id", "invoice_no", "t.label", "t.kind", "t.rate", "t.description",
                       "t.tax_cents")


def labels_for(positions: Column, table: Column) -> Column:
    """Label of each position's rule in a bound tax table (``?`` when absent)."""
    def label(p):
        kind = F.when(p["tax"] == TX.SPLIT, F.lit(1)).otherwise(F.lit(0))
        rate = F.when(p["tax"] == TX.SPLIT, F.lit(None).cast("int")) \
            .otherwise(TX.simple_rate(p["tax"], p["legacy_rate"]))
        hit = F.filter(table, lambda r: (r["kind"] == kind) & r["rate"].eqNullSafe(rate))
        return F.coalesce(F.try_element_at(hit, F.lit(1))["label"], F.lit("?"))

    return F.transform(positions, label)


def position_labels(invoice="data.invoice") -> Column:
    """Label of each position's rule (``?`` when the table has none); the tax
    table is computed once per invoice."""
    inv = _c(invoice)
    return let(tax_rows(inv), lambda table: labels_for(inv["positions"], table))


def compat_tax_codes(bookings: DataFrame) -> DataFrame:
    """Tax codes an invoice uses beyond the three active ones, last first-seen first."""
    inv = F.col("data.invoice")
    extra = F.filter(inv["positions"], lambda p: ~p["tax"].isin(*ACTIVE_CODES))
    keys = F.reverse(F.array_distinct(F.transform(extra, lambda p: TX.tax_key(p["tax"],
                                                                             p["legacy_rate"]))))
    return (_invoiced(bookings)
            .select("id", F.array_join(keys, ",").alias("compat_codes"),
                    F.size(keys).alias("n_compat")))


def invoice_json(invoice="data.invoice", old_shape=None) -> Column:
    """Serialise an invoice as its JSON document (money in units, tax variant form).

    With ``old_shape`` true the older layout is written: one ``date`` field in
    place of ``invoice_date``/``departure_date``, taxes as bare integers where a
    simple rate allows it.
    """
    inv = _c(invoice)
    old = F.lit(False) if old_shape is None else _c(old_shape)

    def pos(p):
        rate = TX.simple_rate(p["tax"], p["legacy_rate"])
        tax_json = F.when(old & rate.isNotNull(), rate.cast("string")) \
            .otherwise(TX.encode_tax(p["tax"], p["legacy_rate"]))
        return F.struct(p["quantity"].alias("quantity"), p["description"].alias("description"),
                        M.units_of_cents(p["price"]).alias("price"),
                        F.parse_json(tax_json).alias("tax"))

    common_head = [inv["id"].alias("id"), inv["recipient"].alias("recipient")]
    common_tail = [inv["title"].alias("title"), inv["intro"].alias("intro"),
                   F.transform(inv["positions"], pos).alias("positions"),
                   inv["closing"].alias("closing"),
                   M.units_of_cents(inv["deposit"]).alias("deposit")]
    new = F.to_json(F.struct(*common_head, inv["invoice_date"].alias("invoice_date"),
                             inv["departure_date"].alias("departure_date"), *common_tail))
    older = F.to_json(F.struct(*common_head, inv["invoice_date"].alias("date"), *common_tail))
    return F.when(old, older).otherwise(new)


def decode_invoice(json_text) -> Column:
    """JSON text -> invoice struct; the older shape (single ``date``) is upgraded:
    invoice_date = date, departure_date = null.  Unparsable text -> null.

    The text is parsed once per row (the parsed document is bound with ``let``;
    every field reads the bound value) and each position's tax is decoded once.
    """
    def pos(p):
        def build(t):
            return F.struct(p["quantity"].alias("quantity"),
                            p["description"].alias("description"),
                            M.cents_of_units(p["price"]).alias("price"), t["tax"].alias("tax"),
                            t["legacy_rate"].alias("legacy_rate"))
        return let(TX.decode_tax(p["tax"]), build)

    def upgrade(doc):
        # The older shape carries ``date`` and neither newer date.  An old document
        # whose date is null decodes the same way under both readings (both dates
        # null), so the parsed fields suffice.
        is_old = (doc["date"].isNotNull() & doc["invoice_date"].isNull()
                  & doc["departure_date"].isNull())
        parsed = F.struct(
            doc["id"].alias("id"), doc["recipient"].alias("recipient"),
            F.when(is_old, doc["date"]).otherwise(doc["invoice_date"]).alias("invoice_date"),
            F.when(is_old, F.lit(None).cast("date")).otherwise(doc["departure_date"])
            .alias("departure_date"),
            doc["title"].alias("title"), doc["intro"].alias("intro"),
            F.transform(doc["positions"], pos).alias("positions"),
            doc["closing"].alias("closing"), M.cents_of_units(doc["deposit"]).alias("deposit"),
        )
        # a document counts only if its required fields are there and every
        # position, its tax included, decodes
        complete = (doc["recipient"].isNotNull() & doc["title"].isNotNull() & doc["intro"].isNotNull()
                    & doc["positions"].isNotNull() & doc["closing"].isNotNull() & doc["deposit"].isNotNull())
        usable = let(parsed, lambda d: F.when(F.forall(d["positions"], lambda p: p["quantity"].isNotNull()
                                                       & p["description"].isNotNull() & p["price"].isNotNull()
                                                       & p["tax"].isNotNull()), d))
        return F.when(doc.isNotNull() & complete, usable)

    return let(F.from_json(_c(json_text), schemas.INVOICE_JSON), upgrade)


def decode_invoices(df: DataFrame, json_col: str = "invoice_json") -> DataFrame:
    """T4 on a frame: adds ``invoice`` (decoded, older shape upgraded) and
    ``_corrupt`` (the raw text of rows that decode to nothing, else null), so bad
    documents are kept and can be inspected instead of being dropped."""
    decoded = df.withColumn("invoice", decode_invoice(json_col))
    return decoded.withColumn(
        "_corrupt", F.when(F.col("invoice").isNull() & F.col(json_col).isNotNull(),
                           F.col(json_col)))
