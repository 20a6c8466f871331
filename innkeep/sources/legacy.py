"""Legacy wide export (all text, repeated slots) and legacy JSON documents.

* ``legacy_rows`` writes the model into the wide legacy layout (record id =
  booking id, group id = customer id, blank for every 17th record) so the
  migration can be exercised on data that grows with the tables.
* ``read_legacy_csv`` / ``write_legacy_csv``: header, double-quote escaping,
  Latin-1, CRLF, multi-line cells; the separator and the number/date dialect
  differ between the two known exports (``,`` + ISO + decimal point, ``;`` +
  ``dd.MM.yyyy`` + decimal comma).
* ``split_legacy_documents``: single-table JSON (bookings nested in the
  customer document) -> customers and bookings.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innkeep.functions.money import format_money_dot
from innkeep.functions.util import in_short_methods
from innkeep.sources import shared
from innkeep.sources.ranges import csv_records

GUEST_SLOTS = [("VORNAME", "NAME", "GEB_DAT01"), ("P_VORNAME", "P_NAME", "GEB_DAT02")] + [
    (f"P_VORNAME{i}", f"P_NAME{i}", f"GEB_DAT0{i}") for i in range(3, 7)]

COLUMNS = (["RECORDID", "GROUPID", "ANREDE", "ANREDEBR", "VORNAME", "NAME", "FIRMA", "ABTEILUNG",
            "SUCH", "STRASSE", "HNR", "PLZZ", "PLZP", "POSTFACH", "ORT", "LAND",
            "LAND___ausgeschrieben", "TELEFON", "TELEFON2", "MOBILTEL", "TELEFAX", "TELEFAX2",
            "EMAIL", "EMAIL2", "INTERNET", "KUNDENNUMMER", "KATEGORIE", "ANREISE", "ABREISE",
            "AVON", "ABIS", "AGEF", "AEING", "ZIMMER", "BEMAUFE"]
           + [f"{p}{i}" for i in range(1, 5) for p in ("ANZAHL", "ART", "PREIS", "PROZ")]
           + [f"GEB_DAT0{i}" for i in range(1, 7)]
           + ["P_VORNAME", "P_NAME"] + [f"P_{p}{i}" for i in range(3, 7) for p in ("VORNAME", "NAME")])

EXPORT_VERSION = 4
# Rows of a compressed file of the export.
LINES = 200_000
LEGACY_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def legacy_rows(bookings: DataFrame, customers: DataFrame) -> DataFrame:
    """Bookings ⋈ customers in the wide legacy layout (ISO dates, decimal point)."""
    c = customers.select(F.col("id").alias("customer"), F.col("data").alias("c"))
    # of a booking only what the layout has room for moves to its customer: four room lines, the first one's room
    d = F.col("data")
    line = F.transform(F.slice(d["allocs"], 1, 4), lambda a: F.when(a.isNotNull(), F.struct(
        a["description"].alias("description"), a["price_per_bed"].alias("price_per_bed"), a["beds"].alias("beds"))))
    j = bookings.select("id", "customer", "arrival", "departure", F.struct(
        d["deposit_asked"].alias("deposit_asked"), d["deposit_got"].alias("deposit_got"), d["note"].alias("note"),
        F.slice(d["guests"], 1, 6).alias("guests"), line.alias("allocs"),
        F.try_element_at(d["allocs"], F.lit(1))["room"].alias("room")).alias("data")).join(c, "customer")
    k = F.col("id")
    cd = F.col("c")
    a_iso, d_iso = F.col("arrival").cast("string"), F.col("departure").cast("string")
    no_dates = k % 23 == 0
    no_from = no_dates | (k % 19 == 0)
    no_till = no_dates | (k % 31 == 0)
    allocs = F.col("data.allocs")
    guests = F.col("data.guests")
    street = cd["address"]["street_with_num"]
    cols = {
        "RECORDID": k.cast("string"),
        "GROUPID": F.when(k % 17 == 0, F.lit("")).otherwise(F.col("customer").cast("string")),
        "ANREDE": cd["name"]["title"], "ANREDEBR": cd["name"]["letter"],
        "VORNAME": cd["name"]["given"], "NAME": cd["name"]["family"],
        "FIRMA": cd["company"]["name"], "ABTEILUNG": F.lit(""), "SUCH": cd["keyword"],
        "STRASSE": F.regexp_extract(street, r"^(.*) [^ ]*$", 1),
        "HNR": F.regexp_extract(street, r" ([^ ]*)$", 1),
        "PLZZ": cd["address"]["postal_code"],
        "PLZP": F.when(k % 13 == 0, F.lit("78401")).otherwise(F.lit("")),
        "POSTFACH": F.when(k % 26 == 0, F.lit("12 34")).otherwise(F.lit("")),
        "ORT": cd["address"]["city"], "LAND": cd["address"]["country_code"],
        "LAND___ausgeschrieben": cd["address"]["country"],
        "TELEFON": cd["contact"]["phone"], "TELEFON2": F.lit(""),
        "MOBILTEL": F.when(k % 6 == 0, F.lit("0171/")).otherwise(F.lit("")),
        "TELEFAX": F.when(k % 4 == 0, F.lit(" 07531/ ")).otherwise(F.lit("")),
        "TELEFAX2": F.lit(""), "EMAIL": cd["contact"]["mail"], "EMAIL2": F.lit(""),
        "INTERNET": F.lit(""),
        "KUNDENNUMMER": F.when(k % 2 == 0, F.format_string("K%d", F.col("customer")))
        .otherwise(F.lit("")),
        "KATEGORIE": F.when(k % 3 == 0, F.lit("Stamm")).otherwise(F.lit("")),
        "ANREISE": F.when(no_from, F.lit("")).otherwise(a_iso),
        "ABREISE": F.when(no_till, F.lit("")).otherwise(d_iso),
        "AVON": F.when(no_from | (k % 8 == 0), F.lit("")).otherwise(a_iso),
        "ABIS": F.when(no_till, F.lit("")).otherwise(d_iso),
        "AGEF": F.when(F.col("data.deposit_asked").isNull(), F.lit("0.00"))
        .otherwise(format_money_dot("data.deposit_asked")),
        "AEING": F.when(k % 29 == 0, F.lit("-5.00"))
        .when(F.col("data.deposit_got").isNull(), F.lit("0.00"))
        .otherwise(format_money_dot("data.deposit_got")),
        # seventy cells in one generated method would be interpreted
        "ZIMMER": _s(in_short_methods(F.array(F.col("data.room")))[0]),
        "BEMAUFE": F.when(k % 10 == 0, F.concat(F.col("data.note"), F.lit('\nzweite "Zeile"')))
        .otherwise(F.col("data.note")),
    }
    for i in range(1, 5):
        a = F.try_element_at(allocs, F.lit(i))
        kurtaxe = (F.lit(i) == 4) & (k % 5 == 4)
        cols[f"ANZAHL{i}"] = (F.when(kurtaxe, F.lit("4"))
                              .when(a.isNull(), F.lit(""))
                              .otherwise(((k + i) % 2 + 1).cast("string")))
        cols[f"ART{i}"] = F.when(kurtaxe, F.lit("Kurtaxe")).otherwise(_s(a["description"]))
        cols[f"PREIS{i}"] = (F.when(kurtaxe, F.lit("2.00")).when(a.isNull(), F.lit("0.00"))
                             .otherwise(format_money_dot(a["price_per_bed"])))
        cols[f"PROZ{i}"] = F.when(kurtaxe | a.isNull(), F.lit("")) \
            .otherwise((a["beds"] * 100).cast("string"))
    for i in range(1, 7):
        g = F.try_element_at(guests, F.lit(i))
        cols[f"GEB_DAT0{i}"] = _s(g["born"])
        if i >= 2:
            gn, fn, _ = GUEST_SLOTS[i - 1]
            cols[gn] = _s(g["given"])
            cols[fn] = _s(g["family"])
    return j.select(*[_s(cols[c]).alias(c) for c in COLUMNS])


def write_legacy_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Write rows as the legacy export: header, Latin-1, CRLF, quoted cells; below a path that ends in ``.gz``
    compressed, ``LINES`` rows a file."""
    writer = df.write.mode("overwrite")
    ((shared.packed(writer, LINES) if path.endswith(".gz") else writer).option("header", True).option("sep", sep)
     .option("encoding", "ISO-8859-1").option("lineSep", "\r\n").option("quote", '"')
     .option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


# Columns without which an export cannot be migrated, and other
# names under which exports carry a column.
REQUIRED = ("RECORDID", "GROUPID", "VORNAME", "NAME", "ANREISE", "ABREISE")
ALIASES = {"KUNDENNR": "KUNDENNUMMER"}


def by_name(raw: DataFrame) -> DataFrame:
    """The known columns of an export, found by name (any case, any order, aliases).

    Unknown columns are left out, missing optional ones are null, a missing
    required one is an error, and so is a known name that occurs twice.
    """
    found: dict[str, str] = {}
    for c in raw.columns:
        name = ALIASES.get(c.strip().upper(), c.strip().upper())
        known = next((k for k in COLUMNS if k.upper() == name), None)
        if known is None:
            continue
        if known in found:
            raise ValueError(f"legacy export: column {known} occurs twice")
        found[known] = c
    missing = [c for c in REQUIRED if c not in found]
    if missing:
        raise ValueError(f"legacy export: missing columns {', '.join(missing)}")
    return raw.select(*[(F.col(f"`{found[c]}`") if c in found else F.lit(None)).cast("string").alias(c)
                        for c in COLUMNS])


def read_legacy_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "ISO-8859-1") -> DataFrame:
    """Read the legacy export: columns by header name, all as text, cells may span lines.

    A file is cut into records in byte ranges, so one large file is many tasks.  All files
    of a folder carry the same header; a file with another one is an error.
    """
    heads, records = csv_records(spark, path, encoding)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    if not heads:
        return by_name(spark.createDataFrame([], "nothing string"))
    if len(heads) > 1:
        raise ValueError("legacy export: files with different headers")
    names = next(csv.reader([heads[0]], delimiter=sep))
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = records.select(F.from_csv("text", cells.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return by_name(rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)]))


def write_raw(df: DataFrame, path: str) -> None:
    """Keep an untouched copy of the raw import (bronze table)."""
    df.write.mode("overwrite").parquet(path)


def write_import_json(customers: DataFrame, path: str) -> None:
    """Imported customers as JSON Lines of ``{"data": {...}}``."""
    customers.select(F.struct("data").alias("row")).select("row.*").write.mode("overwrite").json(path)


def split_legacy_documents(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legacy single-table documents -> (customers, bookings).

    Input rows: ``customer_id, created, modified, data`` with ``data.bookings[]``.
    Each booking gets the placeholder id -1 and the customer id copied.
    """
    customers = df.select(F.col("customer_id").alias("id"), "created", "modified",
                          F.col("data").dropFields("bookings").alias("data"))
    bookings = df.select(F.lit(-1).cast("bigint").alias("id"),
                         F.col("customer_id").alias("customer"), "created", "modified",
                         F.explode("data.bookings").alias("data"))
    return customers, bookings
