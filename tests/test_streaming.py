"""The change-propagation stream across several micro-batches and a restart."""

import datetime as dt
import os
import tempfile

from innkeep.operators import quality as Q
from innkeep.sources import versions as V
from innkeep.streaming import changes as ST


def test_multi_batch_stream_and_restart(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    src = os.path.join(root, "src")
    batches = [
        [(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 5))],
        [(1, dt.datetime(2024, 3, 1)), (3, dt.datetime(2019, 1, 1))],
        [(1, dt.datetime(2024, 2, 1)), (2, dt.datetime(2024, 6, 1))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").coalesce(1) \
            .write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    table, ckpt = os.path.join(root, "table"), os.path.join(root, "ckpt")

    def run():
        q = ST.run_touch_stream(
            ST.change_stream(spark, src, schema, max_files_per_trigger=1), table, ckpt)
        q.awaitTermination()
        return q

    q = run()
    assert len([p for p in os.listdir(table) if p.startswith("batch=")]) == 3
    customers = spark.createDataFrame([(1, dt.datetime(2020, 1, 1)), (2, dt.datetime(2020, 1, 1)),
                                       (3, dt.datetime(2020, 1, 1))], "id long, modified timestamp_ntz")
    streamed = {r.id: r.modified for r in ST.touched_customers(spark, customers, table).collect()}
    events = spark.read.parquet(src).withColumnRenamed("user_id", "customer")
    batch = {r.id: r.modified for r in Q.touch_customers(customers, events).collect()}
    assert streamed == batch == {1: dt.datetime(2024, 3, 1), 2: dt.datetime(2024, 6, 1),
                                 3: dt.datetime(2020, 1, 1)}
    assert q.lastProgress is not None
    run()   # restart from the checkpoint: nothing new, nothing duplicated
    assert len([p for p in os.listdir(table) if p.startswith("batch=")]) == 3
    again = {r.id: r.modified for r in ST.touched_customers(spark, customers, table).collect()}
    assert again == streamed


def test_stream_into_a_stored_table_with_restart_and_replay(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    src, table, ckpt = (os.path.join(root, n) for n in ("src", "customers", "ckpt"))
    start = dt.datetime(2020, 1, 1)
    V.create(spark, table, spark.createDataFrame([(i, start) for i in range(40)], "id long, modified timestamp_ntz"), block_rows=10)

    def deliver(*rows):
        spark.createDataFrame(list(rows), "user_id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(src)

    def run():
        ST.run_table_stream(ST.change_stream(spark, src, schema, max_files_per_trigger=1, files="*.parquet"),
                            table, ckpt).awaitTermination()

    deliver((1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 3, 1)), (99, start), (None, start))
    schema = spark.read.parquet(src).schema
    deliver((25, dt.datetime(2024, 1, 5)), (1, dt.datetime(2024, 2, 1)))
    run()
    want = {i: start for i in range(40)} | {1: dt.datetime(2024, 3, 1), 25: dt.datetime(2024, 1, 5)}
    now = lambda: {r.id: r.modified for r in V.read(spark, table).collect()}
    assert now() == want and V.versions(spark, table) == [0, 1, 2]
    # the version was published, but the stream failed before it noted the batch as done
    for name in ("1", ".1.crc"):
        os.remove(os.path.join(ckpt, "commits", name))
    run()
    assert now() == want and V.versions(spark, table) == [0, 1, 2]
    deliver((39, dt.datetime(2025, 1, 1)))
    run()
    assert now() == want | {39: dt.datetime(2025, 1, 1)} and V.versions(spark, table) == [0, 1, 2, 3]
    assert not any("state" in p for p in os.listdir(ckpt))
