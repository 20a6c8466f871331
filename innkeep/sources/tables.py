"""Readers and writers of the stored tables.

Scans are left as Spark splits them; how many files a table has is the business
of whoever writes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep import schemas
from innkeep.sources import shared


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a parquet table (optionally with a known schema)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_bookings(bookings: DataFrame, path: str, document: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Bookings laid out for date filters: partitioned by arrival year, sorted by
    arrival inside the files (row-group statistics skip the rest); the
    generated flag ``invoiced`` is stored next to the stay dates.

    Rows are range-partitioned on (arrival, id) before the write, so every task
    writes an equal slice of one or two years; partitioning by the year itself
    would send a whole year to one task.  Ids and customers have Bloom filters, sized
    by what a row group holds, so a lookup by either skips the row groups without it.

    ``document`` builds the stored columns, row by row, of slimmer rows (with ``arrival`` and ``id``) once
    these are in their place, so whole documents are neither shuffled nor sorted; it keeps ``arrival_year``.
    """
    _store_bookings(bookings, path, "overwrite", document)


def _store_bookings(bookings: DataFrame, path: str, mode: str,
                    document: Callable[[DataFrame], DataFrame] | None = None) -> None:
    # sorted by the year first, as the writer needs it: it would sort the rows again otherwise
    laid = (bookings.withColumn("arrival_year", F.year("arrival"))
            .repartitionByRange("arrival", "id").sortWithinPartitions("arrival_year", "arrival", "id"))
    stored = laid if document is None else document(laid)
    (stored.withColumn("invoiced", F.col("data.invoice").isNotNull())
     .write.mode(mode).partitionBy("arrival_year")
     .option("parquet.bloom.filter.adaptive.enabled", "true")
     .option("parquet.bloom.filter.enabled#id", "true")
     .option("parquet.bloom.filter.enabled#customer", "true").parquet(path))


def _note_longest_stay(bookings: DataFrame, path: str) -> None:
    """Adds the longest stay of these bookings to the table's ``stay_bounds``."""
    nights = F.coalesce(F.greatest(F.lit(0), F.max(F.datediff("departure", "arrival"))), F.lit(0))
    bookings.agg(nights.cast("int").alias("max_nights")).write.mode("append").parquet(f"{path}/stay_bounds")


def longest_stay(spark: SparkSession, path: str) -> int | None:
    """A bound on the nights of every booking below ``path``; None if none is stored.

    Date filters use it to skip the years before (``stays.overlapping``).  Writers keep it
    at or above the truth at any time: it goes before the bookings are replaced, and an
    appended batch adds its own bound before its rows.
    """
    if not shared.exists(spark, f"{path}/stay_bounds"):
        return None
    bounds = read_table(spark, f"{path}/stay_bounds", "max_nights int")
    return bounds.agg(F.max("max_nights").alias("n")).first().n


def _with_generated(bookings: DataFrame) -> DataFrame:
    """The stored columns of bookings; generated ones come from the document when absent."""
    from innkeep.functions.periods import arrival_of, departure_of
    b = bookings
    for col, typ in (("created", "timestamp_ntz"), ("modified", "timestamp_ntz")):
        if col not in b.columns:
            b = b.withColumn(col, F.lit(None).cast(typ))
    if "arrival" not in b.columns:
        b = b.withColumn("arrival", arrival_of("data.period"))
    if "departure" not in b.columns:
        b = b.withColumn("departure", departure_of("data.period"))
    return b


def append_bookings(bookings: DataFrame, path: str) -> None:
    """Adds bookings to the tables below ``path``, in the same layout."""
    b = _with_generated(bookings)
    _note_longest_stay(b, path)
    _store_bookings(b, f"{path}/bookings", "append")




def write_tables(customers: DataFrame, bookings: DataFrame, path: str,
                 invoice_numbers: DataFrame | None = None) -> None:
    """Store a model under ``path`` (customers by id, bookings by arrival layout)."""
    from innkeep.functions.text import leaf_tokens
    c = customers
    if "keyword" not in c.columns:
        c = c.withColumn("keyword", F.col("data.keyword"))
    if "tokens" not in c.columns:
        c = c.withColumn("tokens", leaf_tokens("data"))
    for col, typ in (("created", "timestamp_ntz"), ("modified", "timestamp_ntz")):
        if col not in c.columns:
            c = c.withColumn(col, F.lit(None).cast(typ))
    c.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/customers")
    spark = bookings.sparkSession
    shared.delete(spark, f"{path}/stay_bounds")
    write_bookings(_with_generated(bookings), f"{path}/bookings")
    _note_longest_stay(read_table(spark, f"{path}/bookings", "arrival date, departure date"), path)
    if invoice_numbers is not None:
        invoice_numbers.write.mode("overwrite").parquet(f"{path}/invoice_numbers")


def open_tables(spark: SparkSession, path: str):
    """(customers, bookings) of a folder written by ``write_tables``."""
    return spark.read.parquet(f"{path}/customers"), spark.read.parquet(f"{path}/bookings")
