"""The lodging model derived from the TPC-H-like test tables.

customer ⋈ nation           -> customers  (id = c_custkey, keyword = c_name)
orders (+ lineitem lines)   -> bookings   (id = o_orderkey, customer = o_custkey)
invoiced bookings           -> invoice_numbers

With k = o_orderkey: arrival = o_orderdate, departure = arrival + k % 13 days,
period stored swapped when k % 4 = 0, k % 5 guests, tax free when k % 11 = 0,
deposit null when k % 3 = 0, an invoice when o_orderstatus = 'F', one room line
per lineitem.  The moduli are pairwise coprime so the properties vary
independently.  The DuckDB oracle (``innkeep.plans.oracle``) restates the same
mapping in SQL.

Scale: what is shuffled are bare order lines, orders with what an invoice names of their
customers, and, to be laid out, slim rows; documents are built after the last shuffle.  The room lines of a booking are part of
its document, so they are gathered per order; an order has at most 7 lines by
the TPC-H rules (13 in these fixtures), which bounds that list.  customer ⋈
nation and orders ⋈ customers are equi-joins that AQE turns into broadcasts
only when the measured size of the small side allows.  When the session names a shared checkpoint folder the
model is written there once (bookings partitioned by arrival year, sorted by
arrival inside the files, so that date filters prune by statistics) and every
later query reads it.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.functions import periods as P
from innkeep.functions.text import ROOM_DESCRIPTIONS, LETTER_BY_TITLE, leaf_tokens
from innkeep.functions.util import printed
from innkeep.operators.invoices import invoice_document
from innkeep.session import ensure_checkpoint_dir
from innkeep.sources import shared
from innkeep.sources.tables import read_table, write_bookings

MODEL_VERSION = "3"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@dataclass
class Model:
    customers: DataFrame
    bookings: DataFrame
    invoice_numbers: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given test table."""
    return read_table(spark, os.path.join(sf_dir, f"{name}.parquet"))


def _titles() -> Column:
    # Titles of the salutation lookup plus one empty title (index 6).
    return F.array(*[F.lit(t) for t, _ in LETTER_BY_TITLE], F.lit(""))


def derive_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer ⋈ nation -> customers (id, created, modified, data, keyword, tokens)."""
    return customer_documents(customer_rows(spark, sf_dir))


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer ⋈ nation: what the customers are made of."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey",
                                                "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey, "inner").select("c_custkey", "c_name", "c_mktsegment", "n_name")


def customer_documents(rows: DataFrame) -> DataFrame:
    """``customer_rows`` -> customers, row by row."""
    k = F.col("c_custkey")
    title = F.element_at(_titles(), (k % 7 + 1).cast("int"))
    letters = F.create_map(*[F.lit(x) for pair in LETTER_BY_TITLE for x in pair])
    created = F.to_timestamp_ntz(F.date_add(F.lit("1994-01-01").cast("date"),
                                            (k % 365).cast("int")).cast("string"))
    phone = (F.when(k % 10 == 0, F.lit("07534/"))
             .otherwise(F.format_string("0%d/%d", (k % 900 + 100), (k * 31 % 1000000))))
    data = F.struct(
        F.struct(title.alias("title"),
                 F.coalesce(F.try_element_at(letters, title), F.lit("")).alias("letter"),
                 F.format_string("Vorname%d", k % 89).alias("given"),
                 F.format_string("Name%d", k % 211).alias("family")).alias("name"),
        F.struct(F.col("c_mktsegment").alias("name"), F.lit("").alias("address")).alias("company"),
        F.struct(F.format_string("Weg %d %d", k % 50, k % 9 + 1).alias("street_with_num"),
                 ((k * 7919) % 90000 + 10000).cast("string").alias("postal_code"),
                 F.format_string("Ort%d", k % 40).alias("city"),
                 F.col("n_name").alias("country"),
                 F.concat(F.lit("X"), F.col("n_name")).alias("country_code")).alias("address"),
        F.struct(phone.alias("phone"), F.lit("").alias("phone2"), F.lit("").alias("mobile"),
                 F.lit("").alias("fax"), F.lit("").alias("fax2"),
                 F.when(k % 2 == 0, F.concat(F.lower(F.regexp_replace("c_name", "#", ".")),
                                             F.lit("@example.org")))
                 .otherwise(F.lit("")).alias("mail"),
                 F.lit("").alias("mail2"), F.lit("").alias("web")).alias("contact"),
        F.col("c_name").alias("keyword"),
        F.lit("").alias("note"),
        F.lit(None).cast("bigint").alias("_import_key"),
    )
    out = rows.select(k.alias("id"), created.alias("created"),
                      F.timestamp_add("MINUTE", (k * 7919) % 20000, created).alias("modified"),
                      data.alias("data"))
    return out.select("*", F.col("data.keyword").alias("keyword"),
                      leaf_tokens("data").alias("tokens"))


def _allocs_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                 "l_linenumber", "l_quantity")
    li = li.repartition("l_orderkey")          # bare lines are shuffled; room lines are made and gathered behind it
    ln = F.col("l_linenumber")
    room = (F.when(ln % 4 == 0, F.lit(""))
            .when(ln % 4 == 1, F.concat(F.lit("A"), ln.cast("string")))
            .otherwise((F.col("l_partkey") % 30 + 1).cast("string")))
    descr = F.element_at(F.array(*[F.lit(d) for d in ROOM_DESCRIPTIONS[:5]]),
                         (F.col("l_suppkey") % 5 + 1).cast("int"))
    # (l_orderkey, l_linenumber) is not unique: order lines by all their columns.
    line = F.struct(ln.alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
                    F.col("l_quantity").alias("q"),
                    F.struct(room.alias("room"),
                             (3000 + (F.col("l_partkey") % 50) * 100).cast("bigint")
                             .alias("price_per_bed"),
                             (1 + F.col("l_quantity").cast("int") % 4).cast("int").alias("beds"),
                             descr.alias("description")).alias("alloc"))
    return (li.groupBy("l_orderkey")
            .agg(F.array_sort(F.collect_list(line)).alias("lines"))
            .select(F.col("l_orderkey").alias("id"),
                    F.transform("lines", lambda x: x["alloc"]).alias("allocs")))


def _guests(k: Column, departure: Column, custkey: Column) -> Column:
    n = (k % 5).cast("int")

    def guest(_, i0):
        i = i0 + 1
        born = F.date_add(F.add_months(departure, (-12 * ((7 * k + 13 * i) % 80)).cast("int")),
                          ((k % 3) - 1).cast("int"))
        return F.struct(F.concat(F.lit("Gast"), printed(i)).alias("given"),
                        F.concat(F.lit("Name"), printed(custkey % 211)).alias("family"),
                        F.when((k + i) % 4 == 0, F.lit(None).cast("date")).otherwise(born)
                        .alias("born"))

    return F.transform(F.array_repeat(F.lit(0), n), guest)


def derive_bookings(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    """orders + lineitem lines (+ customers for the stored invoices) -> bookings."""
    return booking_documents(booking_rows(spark, sf_dir, customers))


def _period(k: Column, orderdate: Column) -> tuple[Column, Column, Column]:
    """(arrival, departure, stored period) of an order."""
    arrival = orderdate.cast("date")
    departure = F.date_add(arrival, (k % 13).cast("int"))
    swap = k % 4 == 0
    return arrival, departure, F.struct(F.when(swap, departure).otherwise(arrival).alias("a"),
                                        F.when(swap, arrival).otherwise(departure).alias("b"))


def booking_rows(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    """What the bookings are made of: orders, their room lines and of their customers what an invoice
    names; ``id`` and ``arrival`` are those of the bookings."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                              "o_orderdate")
    base = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"),
                    F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created"))
    d = F.col("data")
    cust = customers.select(F.col("id").alias("customer"), *[x.alias(f"c_{n}") for n, x in (
        ("given", d["name"]["given"]), ("family", d["name"]["family"]),
        *[(n, d["address"][n]) for n in ("street_with_num", "postal_code", "city", "country_code")])])
    allocs = _allocs_per_order(spark, sf_dir).hint("merge")      # its estimated size leaves out the lists
    rows = base.join(cust, "customer", "left").join(allocs, "id", "left")
    return rows.withColumn("arrival", P.arrival_of(_period(F.col("id"), F.col("created"))[2]))


def booking_documents(rows: DataFrame) -> DataFrame:
    """``booking_rows`` -> bookings, row by row."""
    k = F.col("id")
    arrival, departure, period = _period(k, F.col("created"))
    j = rows.select(
        "id", "customer", "status", "created", "allocs", *[c for c in rows.columns if c.startswith("c_") or c == "arrival_year"],
        F.timestamp_add("HOUR", k % 400, F.col("created")).alias("modified"),
        arrival.alias("arrival"), departure.alias("departure"), period.alias("period"),
        F.when(k % 5 == 0, F.lit(None)).otherwise((k % 150) * 100).cast("bigint")
        .alias("deposit_asked"),
        F.when(k % 3 == 0, F.lit(None)).otherwise((k % 200) * 100).cast("bigint")
        .alias("deposit_got"),
        (k % 11 == 0).alias("tax_free"),
        F.when(k % 10 == 0, F.format_string("Notiz %d", k)).otherwise(F.lit("")).alias("note"),
        _guests(k, departure, F.col("customer")).alias("guests"),
    )
    empty_allocs = F.array_repeat(F.struct(F.lit("").alias("room"),
                                           F.lit(0).cast("bigint").alias("price_per_bed"),
                                           F.lit(0).alias("beds"),
                                           F.lit("").alias("description")), 0)
    allocs_col = F.coalesce(F.col("allocs"), empty_allocs)
    doc_wo_invoice = F.struct(
        F.col("period").alias("period"), F.col("deposit_asked").alias("deposit_asked"),
        F.col("deposit_got").alias("deposit_got"), F.col("tax_free").alias("tax_free"),
        F.col("note").alias("note"), F.col("guests").alias("guests"),
        allocs_col.alias("allocs"))
    # Stored invoices: generated at departure; recipients were partly edited by
    # hand (k % 7 = 0: no dash in the last line, k % 7 = 1: code "D"), older
    # invoices carry other room tax codes (k % 9 = 0: legacy 16 %, = 1: 19 %).
    name_line = F.format_string("%s %s", "c_given", "c_family")
    last = (F.when(k % 7 == 0, F.format_string("%s %s", "c_postal_code", "c_city"))
            .when(k % 7 == 1, F.format_string("D-%s %s", "c_postal_code", "c_city"))
            .otherwise(F.format_string("%s-%s %s", "c_country_code", "c_postal_code", "c_city")))
    recipient = F.concat_ws("\n", name_line, "c_street_with_num", last)
    room_tax = F.struct(
        F.when(k % 9 == 0, F.lit("Legacy")).when(k % 9 == 1, F.lit("General19"))
        .otherwise(F.lit("Reduced7With3EuroDrinks19")).alias("tax"),
        F.when(k % 9 == 0, F.lit(16)).cast("int").alias("legacy_rate"))
    invoice = invoice_document(doc_wo_invoice, None, "arrival", "departure",
                               invoice_date=F.col("departure"), recipient=recipient,
                               room_tax=room_tax)
    data = F.struct(*[doc_wo_invoice[f].alias(f) for f in
                      ("period", "deposit_asked", "deposit_got", "tax_free", "note", "guests",
                       "allocs")],
                    F.when(F.col("status") == "F", invoice).alias("invoice"))
    return j.select("id", "customer", "created", "modified", data.alias("data"),
                    P.arrival_of(F.col("period")).alias("arrival"),
                    P.departure_of(F.col("period")).alias("departure"),
                    *[c for c in rows.columns if c == "arrival_year"])


def derive_invoice_numbers(bookings: DataFrame) -> DataFrame:
    """The invoice numbers of the stored invoices (number, booking)."""
    inv = F.col("data.invoice")
    return (bookings.where(inv.isNotNull() & inv["id"].isNotNull())
            .select(inv["id"].alias("number"), F.col("id").alias("booking")))


def derive_model(spark: SparkSession, sf_dir: str) -> Model:
    """The lazily derived model of a scale-factor folder (no writes)."""
    customers = derive_customers(spark, sf_dir)
    bookings = derive_bookings(spark, sf_dir, customers)
    return Model(customers, bookings, derive_invoice_numbers(bookings))


def _model_key(spark: SparkSession, sf_dir: str) -> str:
    h = hashlib.sha1(MODEL_VERSION.encode())
    pkg = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for sub in ("sources", "functions", "operators"):
        folder = os.path.join(pkg, sub)
        for name in sorted(os.listdir(folder)):
            if name.endswith(".py"):
                with open(os.path.join(folder, name), "rb") as fh:
                    h.update(fh.read())
    for name in ("customer", "nation", "orders", "lineitem"):
        for status in shared.file_states(spark, f"{sf_dir}/{name}.parquet"):
            h.update(status.encode())
    return h.hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    return shared.exists(spark, path)


def model_location(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the published model, below the cluster's shared folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/innkeep-model/{_model_key(spark, sf_dir)}"


_LOADED: dict[tuple[str, str], tuple[Model, int | None]] = {}


def _write_model(spark: SparkSession, sf_dir: str, loc: str) -> None:
    rows = customer_rows(spark, sf_dir).repartitionByRange("c_custkey").sortWithinPartitions("c_custkey")
    (customer_documents(rows)
     .write.mode("overwrite").parquet(f"{loc}/customers"))
    customers = spark.read.parquet(f"{loc}/customers")
    write_bookings(booking_rows(spark, sf_dir, customers), f"{loc}/bookings", booking_documents)
    bookings = spark.read.parquet(f"{loc}/bookings")
    derive_invoice_numbers(bookings).write.mode("overwrite").parquet(f"{loc}/invoice_numbers")
    stats = bookings.agg(F.max(F.datediff("departure", "arrival")).alias("max_nights")).first()
    meta = {"max_nights": int(stats["max_nights"] or 0), "version": MODEL_VERSION}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{loc}/_meta")


def _load(spark: SparkSession, sf_dir: str) -> tuple[Model, int | None]:
    loc = model_location(spark, sf_dir)
    key = (spark.sparkContext.applicationId, loc)   # a JVM session here (see model_location)
    if key not in _LOADED:
        # written into a temporary folder and published with one rename
        shared.publish_once(spark, loc, lambda target: _write_model(spark, sf_dir, target))
        model = Model(spark.read.parquet(f"{loc}/customers"),
                      spark.read.parquet(f"{loc}/bookings"),
                      spark.read.parquet(f"{loc}/invoice_numbers"))
        meta = json.loads(spark.read.text(f"{loc}/_meta").first()["value"])
        _LOADED[key] = (model, int(meta["max_nights"]))
    return _LOADED[key]


def load_model(spark: SparkSession, sf_dir: str, materialize: bool = True) -> Model:
    """The model for ``sf_dir``: read from the shared folder (written there first
    if missing; plans are reused within a session)."""
    if not materialize:
        return derive_model(spark, sf_dir)
    return _load(spark, sf_dir)[0]


def model_max_nights(spark: SparkSession, sf_dir: str) -> int | None:
    """Longest stay recorded when the model was written (for partition pruning)."""
    return _load(spark, sf_dir)[1]
