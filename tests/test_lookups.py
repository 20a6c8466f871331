"""Point lookups that skip row groups, and paging by key with rows that were never modified."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from innkeep.operators import search
from innkeep.sources import tables


@pytest.mark.parametrize("column,rows_per_key", [("id", 1), ("customer", 8)])
def test_bloom_filters_skip_row_groups(spark, tmp_path, column, rows_per_key):
    years = 8
    b = spark.range(4000).select(
        (F.col("id") * 2).alias("id"), F.pmod("id", F.lit(500)).alias("customer"),
        F.make_date(F.lit(2000) + F.pmod(F.xxhash64("id"), F.lit(years)).cast("int"), F.lit(1), F.lit(1)).alias("arrival"),
        F.struct(F.lit(None).cast("string").alias("invoice")).alias("data"))
    path = str(tmp_path / column)
    tables.write_bookings(b, path)

    def scanned(value):
        df = spark.read.parquet(path).where(F.col(column) == value).select("id", "customer", "arrival")
        n = len(df.collect())
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return n, scan.metrics().get("numOutputRows").get().value()
    found, read = scanned(200)
    assert found == rows_per_key
    if column == "id":
        assert read < 4000 / years * 3                 # its own row group; more only by chance
        assert scanned(201)[0] == 0 and scanned(201)[1] < 4000 / years * 3     # inside the range of every file


def test_pages_by_key_reach_rows_never_modified(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 3 == 0 else t + dt.timedelta(days=i % 4)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, modified timestamp_ntz")
    got, page = [], search.page_after(df, size=4).collect()
    while page:
        got += [r.id for r in page]
        page = search.page_after(df, page[-1].modified, page[-1].id, size=4).collect()
    never = dt.datetime(1900, 1, 1)
    assert got == [i for i, m in sorted(rows, key=lambda r: (-(r[1] or never).timestamp(), r[0]))]
