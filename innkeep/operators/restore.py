"""Backup and restore with new ids.

Backup writes both tables (ids and both timestamps kept) under one prefix.
Restore re-creates them with *new* ids: customers are numbered from a start
id in ascending order of their old id and carry the old id as
``data._import_key``; bookings follow their customer through that key and are
numbered from their own start id (customers in descending old id, then
bookings in descending old id, the order in which the original tool created
them).  Duplicate old customer ids and bookings whose customer is missing are
errors, as before.

Dense numbering uses the distributed global index (range partitioning +
per-partition offsets), never a single-task ``row_number``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep import schemas
from innkeep.operators.ordering import with_global_index


def backup(customers: DataFrame, bookings: DataFrame, path: str, fmt: str = "json") -> None:
    """Both tables under ``path`` (JSON Lines by default, or parquet)."""
    c = customers.select("id", "data", "created", "modified")
    b = bookings.select("id", "customer", "data", "created", "modified")
    c.write.mode("overwrite").format(fmt).save(f"{path}/customers")
    b.write.mode("overwrite").format(fmt).save(f"{path}/bookings")


def read_backup(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Read a backup with the explicit schemas (unknown keys are ignored)."""
    cs = schemas.T.StructType([f for f in schemas.CUSTOMERS.fields if f.name in
                               ("id", "data", "created", "modified")])
    bs = schemas.T.StructType([f for f in schemas.BOOKINGS.fields if f.name in
                               ("id", "customer", "data", "created", "modified")])
    reader = spark.read.format(fmt)
    return reader.schema(cs).load(f"{path}/customers"), reader.schema(bs).load(f"{path}/bookings")


class RestoreError(ValueError):
    pass


def check_unique_customers(customers: DataFrame) -> None:
    """Raise when old customer ids repeat (only the tiny violation frame is read)."""
    dup = customers.groupBy("id").count().where(F.col("count") > 1)
    if dup.limit(1).count() > 0:
        raise RestoreError("duplicate customer ids in backup")


def check_restorable(customers: DataFrame, bookings: DataFrame) -> None:
    """Raise when old customer ids repeat or a booking's customer is missing.
    Only the (empty or tiny) violation frames are looked at."""
    check_unique_customers(customers)
    lost = bookings.join(customers.select(F.col("id").alias("customer")), "customer", "left_anti")
    if lost.limit(1).count() > 0:
        raise RestoreError("customer id mismatch")


def remap_customers(customers: DataFrame, customer_start: int, check: bool = True
                    ) -> DataFrame:
    """New customer ids in ascending order of the old ids; the old id is kept in
    ``data._import_key``."""
    if check:
        check_unique_customers(customers)
    n = with_global_index(customers.select("id"), ["id"], index_col="_n")   # documents are not moved to count
    return customers.join(n, "id").select(
        (F.col("_n") + customer_start).alias("id"),
        F.col("data").withField("_import_key", F.col("id")).alias("data"), "created", "modified")


def remap_ids(customers: DataFrame, bookings: DataFrame, customer_start: int,
              booking_start: int, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """New ids for a restore.  Returns (customers, bookings) with new ids;
    customers keep the old id in ``data._import_key``."""
    if check:
        check_restorable(customers, bookings)
    new_c = remap_customers(customers, customer_start, check=False)
    key = new_c.select(F.col("data._import_key").alias("_old"), F.col("id").alias("_new"))
    numbered = with_global_index(bookings.select(
        "id", "customer", (-F.col("customer")).alias("_c_desc"), (-F.col("id")).alias("_b_desc")),
        ["_c_desc", "_b_desc"], index_col="_n")
    ids = numbered.join(key, numbered["customer"] == key["_old"], "inner").select(
        F.col("id").alias("old_id"), (F.col("_n") + booking_start).alias("_id"), F.col("_new").alias("_customer"))
    # ids only so far; each document moves once, to its new id
    new_b = (bookings.select("id", "data", "created", "modified").join(ids, F.col("id") == F.col("old_id"))
             .select(F.col("_id").alias("id"), F.col("_customer").alias("customer"), "data", "created", "modified",
                     "old_id"))
    return new_c, new_b


def restore(spark: SparkSession, path: str, customer_start: int, booking_start: int,
            fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Read a backup and re-create it with new ids."""
    customers, bookings = read_backup(spark, path, fmt)
    return remap_ids(customers, bookings, customer_start, booking_start)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Bulk create (append a batch of rows to a stored table)."""
    df.write.mode("append").format(fmt).save(path)
