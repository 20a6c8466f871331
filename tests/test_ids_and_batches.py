"""Reserved id blocks and checks of change batches."""

import datetime as dt
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from innkeep.operators import quality as Q
from innkeep.sources import ids as IDS
from innkeep.sources import versions as V


def test_concurrent_appends_get_dense_blocks(spark):
    root = tempfile.mkdtemp(prefix="ids-") + "/seq"
    sizes = {f"job{i}": i * 3 + 1 for i in range(6)}

    def append(name):
        rows = spark.range(sizes[name]).select((F.col("id") * 7 % 50).alias("old"))
        return name, sorted((r.old, r.id) for r in IDS.numbered(rows, root, name, ["old"], start=1000).collect())
    with ThreadPoolExecutor(6) as pool:
        got = dict(pool.map(append, sizes))
    every = sorted(i for rows in got.values() for _, i in rows)
    assert every == list(range(1000, 1000 + sum(sizes.values())))
    for rows in got.values():                                 # each block is dense and in order
        assert [i for _, i in rows] == list(range(rows[0][1], rows[0][1] + len(rows)))
    assert append("job3")[1] == got["job3"]                   # run again: the same block
    assert len(IDS.reservations(spark, root)) == 6
    with pytest.raises(ValueError):
        IDS.reserve(spark, root, "job3", 1)


BATCH = "id long, op string, ts timestamp_ntz, change_id long, country long"


def _at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def test_a_batch_with_a_duplicate_and_an_orphan_is_refused(spark):
    root = tempfile.mkdtemp(prefix="batch-") + "/t"
    V.create(spark, root, spark.range(1000).select("id"), block_rows=100)
    rows = [(5, "insert", 1, 1), (2000, "insert", 2, 5), (2000, "update", 3, 5), (2000, "insert", 4, 5), (2001, "update", 5, 5),
            (6, "delete", 6, None), (6, "update", 7, 5), (6, "insert", 8, 5), (7, "update", 9, 4711), (None, "insert", 10, 5), (8, "update", 11, 5)]
    batch = spark.createDataFrame([(i, op, _at(n), n, c) for i, op, n, c in rows], BATCH)
    stored = V.rows_of(spark, root, batch.select("id"))
    parents = V.rows_of(spark, root, batch.select("country"))
    got = sorted((r.change_id, r.rule) for r in Q.refused_changes(batch, stored, "id", {"country": parents}).collect())
    assert got == [(1, "id exists"), (4, "id exists"), (5, "id unknown"), (7, "id unknown"), (9, "country without a parent"), (10, "id missing")]
    # only the blocks of the batch are read: 0 (ids 5 to 8); 2000, 2001 and 4711 have none
    assert {p.split("block=")[1].split("/")[0] for p in stored.inputFiles()} == {"0"}
    assert {p.split("block=")[1].split("/")[0] for p in parents.inputFiles()} == {"0"}
