"""Change propagation as a Structured Streaming job.

Every booking insert/update/delete touches the owning customer's ``modified``.
The stream keeps one state row per customer (latest change time) through a
streaming aggregation; each micro-batch of updated rows is appended to a touch
table, one partition per batch id written in overwrite mode, so a replayed
batch after a failure replaces its own output (exactly-once with the
checkpoint).  Readers take the maximum per customer, so the table never needs
rewriting; ``touched_customers`` applies it to the customers table.

``run_table_stream`` keeps the customers in a versioned table instead: no state and no
touch table, each micro-batch is one version of the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innkeep.operators.quality import touch_customers
from innkeep.sources import versions


def change_stream(spark: SparkSession, source: str, schema: T.StructType,
                  max_files_per_trigger: int | None = None, files: str | None = None) -> DataFrame:
    """Booking changes (customer, ts) from the parquet files of a folder (those named ``files``)."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(source)
    return events.select(F.col("user_id").alias("customer"), F.col("ts"))


def run_touch_stream(changes: DataFrame, table_path: str, checkpoint: str,
                     available_now: bool = True):
    """Start the touch job; returns the StreamingQuery.

    The state is one row per customer (the key is not a time, so no watermark
    could evict it); ``compact_touches`` bounds the table it writes.
    """
    latest = changes.groupBy("customer").agg(F.max("ts").alias("touched"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(table_path))

    w = (latest.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def compact_touches(spark: SparkSession, table_path: str, compacted_path: str) -> DataFrame:
    """One row per customer from all batches so far, written to ``compacted_path``
    (run while the stream is stopped; the stream then goes on in a new table)."""
    (spark.read.parquet(table_path).groupBy("customer").agg(F.max("touched").alias("touched"))
     .withColumn("batch", F.lit(-1)).write.mode("overwrite").partitionBy("batch").parquet(compacted_path))
    return spark.read.parquet(compacted_path)


def touched_customers(spark: SparkSession, customers: DataFrame, table_path: str) -> DataFrame:
    """Customers with ``modified`` advanced to their latest recorded change."""
    touches = spark.read.parquet(table_path).select("customer", F.col("touched").alias("ts"))
    return touch_customers(customers, touches)


def run_table_stream(changes: DataFrame, table_root: str, checkpoint: str, available_now: bool = True):
    """Touch the customers of a versioned table; returns the StreamingQuery.

    The stream has no state of its own: each micro-batch is reduced to one row per customer and merged
    into the stored ``modified`` as one version.  The version records the query's id and the batch
    number, so a batch that is run again after a failure, whether before or after its version was
    published, is applied exactly once.
    """
    def merge(rows: DataFrame, batch: DataFrame) -> DataFrame:
        return touch_customers(rows, batch, "id", "ts")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        writer = "stream:" + (spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint)
        last = batch.groupBy(F.col("customer").alias("id")).agg(F.max("ts").alias("ts"))
        versions.commit(spark, table_root, last.where("id is not null"), merge, writer, batch_id)

    w = changes.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def touch_once(spark: SparkSession, customers: DataFrame, source: str, schema: T.StructType,
               root: str, files: str | None = None) -> DataFrame:
    """Run the stream over everything available now (a fresh folder per run under
    ``root``) and return the touched customers."""
    run = f"{root.rstrip('/')}/innkeep-touch/{uuid.uuid4().hex}"
    q = run_touch_stream(change_stream(spark, source, schema, files=files), f"{run}/table", f"{run}/checkpoint")
    q.awaitTermination()
    return touched_customers(spark, customers, f"{run}/table")
