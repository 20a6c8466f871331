"""Plan rules of the distributed numbering: rows move once, hot groups are split."""

import datetime as dt

from pyspark.sql import functions as F

from innkeep.operators import search, stays


def _hot(spark, n=6000):
    book = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 400).alias("customer"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") * 7 % 900).cast("int")).alias("arrival"),
        F.date_add(F.lit(dt.date(2020, 1, 3)), (F.col("id") * 7 % 900).cast("int")).alias("departure"))
    return spark.range(500).select("id"), book


def test_hot_customer_is_spread_and_bookings_move_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        custs, book = _hot(spark)
        out = stays.embedded_bookings(custs, book)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") <= 3          # numbering, its existence check, customers without bookings
        sizes = out.where("booking is not null").groupBy(F.spark_partition_id()).count().collect()
        rows = out.collect()
        assert sum(r["count"] for r in sizes) == 6000
        hot = [r for r in rows if r.id == 7]
        assert sorted(r.position for r in hot) == list(range(len(hot))) and {r.n_bookings for r in hot} == {len(hot)}
        none = {r.id for r in rows if r.booking is None}
        assert none == {r.id for r in custs.collect()} - {r.customer for r in book.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_keyset_page_is_a_filter_and_a_small_top_k(spark, tmp_path):
    df = spark.range(5000).select("id", (F.lit("2020-01-01").cast("timestamp_ntz")
                                        + F.make_interval(mins=F.col("id") % 90)).alias("modified"))
    df.write.parquet(str(tmp_path / "t"))
    last = dt.datetime(2020, 1, 1, 0, 40)
    plan = search.page_after(spark.read.parquet(str(tmp_path / "t")), last, 40)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=250" in plan and "PushedFilters: [Or(" in plan
