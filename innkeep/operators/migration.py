"""Legacy migration: wide text rows -> customers and bookings.

Steps (all per row, no shuffle) except the master-record choice:

    select needed columns (T7) -> trim/convert types (T8) -> default group (T9)
    -> drop negative deposits (T10) -> stay period with fallbacks (T11)
    -> blank prefix-only phone numbers (T12) -> customer document (T13, T14)
    -> booking document (T15-T18, U1) ; one master record per group (W1)

W1 keeps, per group, the row with the highest record id: a fixed-width ``max``
per group (partial per partition before the shuffle), kept as a narrow table and joined
back on the unique (group, record) key, so a group holding a third of all rows never lands in one
task.  Where that table is too large to be broadcast, a bitmap of bounded size first drops
most wide rows that it does not name, so that they do not move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep import schemas
from innkeep.functions.money import cents_of_units
from innkeep.functions.util import in_short_methods, session_cached
from innkeep.sources import shared
from innkeep.sources.legacy import COLUMNS, GUEST_SLOTS

# Whitespace removed by trimming (space, tab, newline, carriage return, form feed).
WS = " \t\n\r\x0c"
PHONE_COLUMNS = ["TELEFON", "TELEFON2", "TELEFAX", "TELEFAX2", "MOBILTEL"]
# The import lines of the notes, the labelled optional fields of
# the customer note, the booking-note item line and the local-tax item name.
IMPORT_NOTE = "Importiert aus Combit (%s).\n"
BOOKING_IMPORT_NOTE = "Importiert aus Combit (%s).\n\n"
NOTE_FIELDS = [("KUNDENNUMMER", "Kunden-Nr."), ("KATEGORIE", "Kategorie"), ("PLZP", "Plzp"),
               ("POSTFACH", "Fach")]
ITEM_LINE = "- %sx %s à %s€ (%s%%)\n"
LOCAL_TAX_ITEM = "Kurtaxe"
# Largest believable item count and percent of a legacy row.
MAX_COPIES = 999
MAX_PERCENT = 100_000
_INT = r"^[+-]?[0-9]+$"
# Bits (8 MB) that name the winning rows of more groups than FEW_GROUPS.
FILTER_BITS = 1 << 26
FEW_GROUPS = 1 << 18


def _t(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(WS))


def _int_opt(c) -> Column:
    s = _t(c)
    return F.when(s.rlike(_INT), s.try_cast("bigint"))


def _bounded(c: str, most: int, default: int) -> Column:
    """Whole number of a cell within -most..most, else the default (such cells are
    reported by ``legacy_problems``)."""
    n = _int_opt(c)
    return F.when(F.abs(n) <= most, n).otherwise(F.lit(default))


def needed_columns(raw: DataFrame) -> DataFrame:
    """Keep the columns the migration reads (Catalyst prunes the rest)."""
    present = raw.columns
    if present == COLUMNS:
        return raw
    return raw.select(*[c for c in COLUMNS if c in present])


def _date(c, dialect: str) -> Column:
    fmt = "yyyy-MM-dd" if dialect == "iso" else "dd.MM.yyyy"
    s = _t(c)
    return F.when(s != "", F.try_to_date(s, fmt))


def money_cents(c, dialect: str = "iso") -> Column:
    """Text amount -> cents (null when blank or unparsable)."""
    s = _t(c)
    if dialect != "iso":        # dots group thousands only where a comma marks the decimals
        s = F.when(s.contains(","), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))) \
            .otherwise(s)
    return F.when(s != "", cents_of_units(s.try_cast("double")))


def cast_legacy(raw: DataFrame, dialect: str = "iso", drop_negative_deposits: bool = True
                ) -> DataFrame:
    """Typed view of the legacy rows.

    Text columns are trimmed (empty when missing); ``recordid``/``groupid`` are
    integers (group defaults to the record, T9); dates parse in the dialect's
    format (blank or invalid -> null); ``agef``/``aeing`` are cents with zero
    (T17) and negative amounts (T10) -> null; ``price1_cents..price4_cents`` are
    cents; phone numbers holding only an area-code prefix ending in ``/`` are
    blanked (T12).
    """
    d = needed_columns(raw)
    return d.select(*_typed_columns(tuple(d.columns), dialect, drop_negative_deposits))


@session_cached
def _typed_columns(columns: tuple, dialect: str, drop_negative_deposits: bool) -> list:
    rid = _int_opt("RECORDID")
    out = [rid.alias("recordid"), F.coalesce(_int_opt("GROUPID"), rid).alias("groupid"),
           _t("RECORDID").alias("RECORDID_text"), _t("GROUPID").alias("GROUPID_text")]
    dates = ["ANREISE", "ABREISE", "AVON", "ABIS"] + [g[2] for g in GUEST_SLOTS]
    out += [_date(c, dialect).alias(c.lower()) for c in dates]
    for c in ("AGEF", "AEING"):
        cents = money_cents(c, dialect)
        keep = (cents != 0) & (cents >= 0) if drop_negative_deposits else (cents != 0)
        out.append(F.when(keep, cents).alias(c.lower()))
    out += [money_cents(f"PREIS{i}", dialect).alias(f"price{i}_cents") for i in range(1, 5)]
    for c in columns:
        if c in ("RECORDID", "GROUPID") or c in dates or c in ("AGEF", "AEING"):
            continue
        v = _t(c)
        if c in PHONE_COLUMNS:
            v = F.when(v.endswith("/"), F.lit("")).otherwise(v)
        out.append(v.alias(c))
    return out


def legacy_period(df: DataFrame) -> Column:
    """Stay from AVON/ABIS, else the master-data dates; one side only -> ±1 day;
    neither -> null (no booking).  Returns STRUCT<a, b>."""
    f = F.coalesce(F.col("avon"), F.col("anreise"))
    t = F.coalesce(F.col("abis"), F.col("abreise"))
    a = F.when(f.isNotNull(), f).when(t.isNotNull(), F.date_sub(t, 1))
    b = F.when(t.isNotNull(), t).when(f.isNotNull(), F.date_add(f, 1))
    return F.when(f.isNotNull() | t.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def customer_note(id_text: Column) -> Column:
    """Import line plus the labelled optional fields that are not blank."""
    parts = [F.format_string(IMPORT_NOTE, id_text)]
    for key, label in NOTE_FIELDS:
        v = F.col(key)
        parts.append(F.when(v != "", F.format_string(f"{label}: %s\n", v)).otherwise(F.lit("")))
    return F.concat(*parts)


@session_cached
def legacy_customer() -> Column:
    """Customer document of a (typed) legacy row."""
    id_text = F.when(F.col("GROUPID_text") != "", F.col("GROUPID_text")) \
        .otherwise(F.col("RECORDID_text"))
    return F.struct(
        F.struct(F.col("ANREDE").alias("title"), F.col("ANREDEBR").alias("letter"),
                 F.col("VORNAME").alias("given"), F.col("NAME").alias("family")).alias("name"),
        F.struct(F.col("FIRMA").alias("name"), F.col("ABTEILUNG").alias("address"))
        .alias("company"),
        F.struct(F.btrim(F.concat_ws(" ", F.col("STRASSE"), F.col("HNR")), F.lit(WS))
                 .alias("street_with_num"),
                 F.col("PLZZ").alias("postal_code"), F.col("ORT").alias("city"),
                 F.col("LAND___ausgeschrieben").alias("country"),
                 F.col("LAND").alias("country_code")).alias("address"),
        F.struct(*[F.col(c).alias(n) for c, n in
                   (("TELEFON", "phone"), ("TELEFON2", "phone2"), ("MOBILTEL", "mobile"),
                    ("TELEFAX", "fax"), ("TELEFAX2", "fax2"), ("EMAIL", "mail"),
                    ("EMAIL2", "mail2"), ("INTERNET", "web"))]).alias("contact"),
        F.col("SUCH").alias("keyword"),
        customer_note(id_text).alias("note"),
        F.lit(None).cast("bigint").alias("_import_key"),
    )


@session_cached
def booking_note(dialect: str = "iso") -> Column:
    """Import line, one line per non-empty item slot, then the remark."""
    zero = "0.00" if dialect == "iso" else "0,00"
    head = F.format_string(BOOKING_IMPORT_NOTE, F.col("RECORDID_text"))
    lines = []
    for i in range(1, 5):
        art, preis = F.col(f"ART{i}"), F.col(f"PREIS{i}")
        lines.append(F.when((art == "") & (preis == zero), F.lit("")).otherwise(
            F.format_string(ITEM_LINE, F.col(f"ANZAHL{i}"), art, preis,
                            F.col(f"PROZ{i}"))))
    return F.btrim(F.concat(head, *lines, F.lit("\n"), F.col("BEMAUFE")), F.lit(WS))


@session_cached
def legacy_guests() -> Column:
    """U1 + F7: six guest slots -> guests, slot order 1..6, blank slots dropped."""
    slots = F.array(*[F.struct(F.col(g).alias("given"), F.col(f).alias("family"),
                               F.col(b.lower()).alias("born"))
                      for g, f, b in GUEST_SLOTS])
    return F.filter(slots, lambda s: ~((s["given"] == "") & (s["family"] == "")
                                       & s["born"].isNull()))


@session_cached
def legacy_allocs() -> Column:
    """Item slots 1-4 -> room lines.

    The local-tax item and zero/blank prices are skipped; ``ANZAHL`` copies
    (unparsable -> 0); beds = ceil(percent / 100) with percent defaulting to
    100; the room number goes only on the first copy of slot 1.
    """
    # plain expressions: lambdas are interpreted, and would work out a cell anew wherever it is used
    def line(i, room):
        beds = ((_bounded(f"PROZ{i}", MAX_PERCENT, 100) + 99) / 100).cast("int")
        return F.struct(room.alias("room"), F.col(f"price{i}_cents").alias("price_per_bed"), beds.alias("beds"),
                        F.col(f"ART{i}").alias("description"))
    parts, blank = [], F.lit("")
    for i in range(1, 5):
        art, price = F.col(f"ART{i}"), F.col(f"price{i}_cents")
        valid = (art != LOCAL_TAX_ITEM) & price.isNotNull() & (price != 0)
        amount = F.when(valid, F.greatest(_bounded(f"ANZAHL{i}", MAX_COPIES, 0).cast("int"), F.lit(0))).otherwise(0)
        if i == 1:
            parts.append(F.array_repeat(line(i, F.col("ZIMMER")), F.least(amount, F.lit(1))))
            amount = amount - 1                     # none if negative
        parts.append(F.array_repeat(line(i, blank), amount))
    return in_short_methods(F.concat(*parts))


def migrate(raw: DataFrame, dialect: str = "iso", materialize: bool = False
            ) -> tuple[DataFrame, DataFrame]:
    """Legacy rows -> (customers, bookings).

    customers: one per group (highest record id wins, W1), id = group id.
    bookings: one per row with a stay (T11), id = record id, customer = group id.

    With ``materialize`` the typed rows are parsed once and kept through a
    reliable checkpoint (columnar, in the shared folder), for jobs that write
    both tables from one export.  Without it each output re-reads the export;
    the master-record aggregate then parses only the two id columns.
    """
    from innkeep.operators.ordering import stable
    every = cast_legacy(raw, dialect)
    typed = valid_records(every)
    if materialize:
        typed = every = stable(typed)
    rows = typed.select(
        "recordid", "groupid",
        legacy_period(typed).alias("period"),
        F.col("agef").alias("deposit_asked"), F.col("aeing").alias("deposit_got"),
        booking_note(dialect).alias("note"),
        legacy_guests().alias("guests"),
        legacy_allocs().alias("allocs"),
    )
    customers = master_customers(every)        # its own choice of winners needs no valid rows first
    bookings = rows.where(F.col("period").isNotNull()).select(
        F.col("recordid").alias("id"), F.col("groupid").alias("customer"),
        F.struct(F.col("period"), F.col("deposit_asked"), F.col("deposit_got"),
                 F.lit(False).alias("tax_free"), F.col("note"), F.col("guests"),
                 F.col("allocs"), F.lit(None).cast(schemas.INVOICE).alias("invoice")).alias("data"),
        F.least("period.a", "period.b").alias("arrival"),
        F.greatest("period.a", "period.b").alias("departure"))
    return customers, bookings


def migrate_customers(raw: DataFrame, dialect: str = "iso") -> DataFrame:
    """The customers of ``migrate`` alone."""
    return master_customers(cast_legacy(raw, dialect))


def _record_ids(typed: DataFrame) -> DataFrame:
    """(recordid, _n, groupid): each record id with its number of rows and its smallest group.
    Only the two id columns are read."""
    return typed.where(F.col("recordid").isNotNull()).groupBy("recordid").agg(
        F.count(F.lit(1)).alias("_n"), F.min("groupid").alias("groupid"))


def _marked(typed: DataFrame) -> DataFrame:
    """Rows with ``_mark``, a hash of all their columns."""
    return typed.withColumn("_mark", F.xxhash64(*[F.col(f"`{c}`") for c in sorted(typed.columns)]))


def _one_each(marked: DataFrame) -> DataFrame:
    """Of rows with one record id the one with the smallest row hash; only the columns used later move."""
    rest = [c for c in marked.columns if c not in ("recordid", "_mark")]
    return marked.groupBy("recordid").agg(*[F.min_by(F.col(f"`{c}`"), F.col("_mark")).alias(c) for c in rest])


def valid_records(typed: DataFrame) -> DataFrame:
    """Rows with a record id, one per id (C3 on the import).

    Of several rows with one id the one with the smallest group, then the smallest row hash stays, so the
    choice does not depend on partitions.  Repeated ids are found first, on the id columns alone, and kept as a
    table: where there are none, the wide rows are passed on as they are; otherwise only those of repeated
    ids are hashed and compared.  ``legacy_problems`` reports the rows left out.
    """
    named = typed.where(F.col("recordid").isNotNull())
    several = shared.kept(_record_ids(typed).where("_n > 1").select("recordid", "groupid"), "import-ids")
    if several.isEmpty():
        return named
    single = named.join(several.select("recordid"), "recordid", "left_anti")
    chosen = _one_each(_marked(_may_match(typed, several, ["recordid", "groupid"])).join(
        several, ["recordid", "groupid"]))
    return single.unionByName(chosen.select(*single.columns))


def legacy_problems(raw: DataFrame) -> DataFrame:
    """Cells of the import that cannot be used: (RECORDID, problem, n) with the number of
    rows: record id missing or not a number, record id given several times (n rows), and item counts or
    percents beyond what is believable."""
    rid = _int_opt("RECORDID")
    text = F.coalesce(F.col("RECORDID"), F.lit(""))
    huge = F.lit(False)
    for i in range(1, 5):
        for c, most in ((f"ANZAHL{i}", MAX_COPIES), (f"PROZ{i}", MAX_PERCENT)):
            if c in raw.columns:
                huge = huge | (_t(c).rlike(_INT) & F.coalesce(F.abs(_int_opt(c)) > most, F.lit(True)))
    rows = raw.select(text.alias("RECORDID"), rid.alias("_id"), huge.alias("_huge"))
    bad = rows.where(F.col("_id").isNull()).groupBy("RECORDID").agg(F.count(F.lit(1)).alias("n")) \
        .select("RECORDID", F.lit("record id missing or not a number").alias("problem"), "n")
    several = rows.where(F.col("_id").isNotNull()).groupBy(F.col("_id").cast("string").alias("RECORDID")) \
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select("RECORDID", F.lit("record id occurs several times").alias("problem"), "n")
    counts = rows.where("_huge").groupBy("RECORDID").agg(F.count(F.lit(1)).alias("n")) \
        .select("RECORDID", F.lit("item count or percent out of range").alias("problem"), "n")
    return bad.unionByName(several).unionByName(counts)


def _may_match(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` without most of those whose key is not in ``wanted``: the hash of each wanted key sets one of
    ``FILTER_BITS`` bits, which are broadcast (their size does not depend on the tables).  No row with a wanted key goes.
    The exact join that follows is an inner one on unique keys: a semi join would be moved in front of this."""
    slot = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS)) + 1
    bits = (wanted.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "_bucket")
            .where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns))


def master_records(typed: DataFrame) -> DataFrame:
    """W1 on a typed frame (before or after ``valid_records``): per group the row with the highest record id.

    The winning record id per group comes from the id columns alone (partial aggregates) and is kept as a
    table; wide rows are read once and joined on the (group, record) key, so a group holding a third of all rows is
    spread by record id, and the documents are built for the winners only.  Only winners of which there are several
    rows are hashed and compared, and only if there are any.
    """
    best = _record_ids(typed).groupBy("groupid").agg(F.max(F.struct("recordid", "_n")).alias("w"))
    win = shared.kept(best.select("groupid", "w.recordid", "w._n"), "import-ids")
    key = ["groupid", "recordid"]
    found = win.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("_n") > 1).alias("repeated")).first()
    once = win.where("_n = 1").select(*key)
    rows = _may_match(typed, once, key) if found["groups"] > FEW_GROUPS else typed
    single = rows.join(once, key)
    if not found["repeated"]:
        return single
    several = shared.kept(win.where("_n > 1").select(*key), "import-ids")
    chosen = _one_each(_marked(_may_match(typed, several, key)).join(several, key))
    return single.unionByName(chosen.select(*single.columns))


def master_customers(typed: DataFrame) -> DataFrame:
    """W1 + T13 + T14: one customer per legacy group, id = group id."""
    return master_records(typed).select(F.col("groupid").alias("id"),
                                        legacy_customer().alias("data"))


def guests_per_booking(guest_rows: DataFrame) -> DataFrame:
    """Guest rows (booking_id, slot, given, family, born) -> ordered array.
    A booking has at most six guest slots, which bounds the collected list."""
    return (guest_rows.groupBy("booking_id")
            .agg(F.sort_array(F.collect_list(F.struct("slot", "given", "family", "born")))
                 .alias("g"))
            .select("booking_id", F.transform("g", lambda x: x.dropFields("slot")).alias("guests")))


def attach_guests(bookings: DataFrame, per_booking: DataFrame) -> DataFrame:
    """Bookings with their aggregated guests (left join; none -> empty)."""
    j = bookings.join(per_booking.withColumnRenamed("booking_id", "id"), "id", "left")
    return j.withColumn("guests", F.coalesce("guests", F.array()))


def import_summary(customers: DataFrame) -> DataFrame:
    """A10: highest id (for the sequence restart) and number of customers."""
    return customers.agg(F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n_customers"))
