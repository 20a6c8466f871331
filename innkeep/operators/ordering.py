"""Global positions in a sort order without funnelling rows into one task.

``row_number()`` over an unpartitioned window (or one partitioned by a hot
group) moves every row of the group through a single task.  Instead:

1. range-partition on the (group, order) keys and sort inside partitions;
2. tag each row with its partition id and ``monotonically_increasing_id``
   (consecutive inside a partition, in sorted order);
3. cut lineage with a reliable checkpoint so both uses below see the same
   partitioning (range bounds come from sampling);
4. count rows per (partition, group) - a table bounded by
   partitions + groups - and turn the counts into running offsets;
5. position = offset of (partition, group) + local index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stable(df: DataFrame) -> DataFrame:
    """Materialise once so that both uses see the same rows and partitioning: a
    reliable checkpoint in the shared folder; without one (no
    ``spark.checkpoint.dir``), a persisted copy (recomputed only if lost)."""
    from innkeep.session import has_jvm, scratch_root
    spark = df.sparkSession
    reliable = (spark.sparkContext.getCheckpointDir() if has_jvm(spark)
                else scratch_root(spark))
    if reliable:
        return df.checkpoint(eager=True)
    kept = df.persist()
    kept.count()
    return kept


def with_global_index(df: DataFrame, order_cols: list, partition_col: str | None = None,
                      index_col: str = "index", num_partitions: int | None = None,
                      total_col: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Add ``index_col``: the 0-based position of each row in the order of
    ``order_cols`` (within ``partition_col`` when given), computed without
    funnelling a group into one task (see the module docstring).

    ``total_col`` adds the size of the row's group, ``groups`` (a frame with the
    partition column) drops the rows of other groups; both act on the table of
    counts, so the rows themselves do not move again."""
    spark = df.sparkSession
    grp = [partition_col] if partition_col else []
    keys = grp + list(order_cols)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = stable(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                     .withColumn("_pid", F.spark_partition_id())
                     .withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_pid", *grp).agg(F.count(F.lit(1)).alias("_n"),
                                             F.min("_mid").alias("_first"))
    w = (Window.partitionBy(*grp) if grp else Window.partitionBy(F.lit(0))).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    extra = []
    if total_col:
        every = Window.partitionBy(*grp) if grp else Window.partitionBy(F.lit(0))
        offsets, extra = offsets.withColumn(total_col, F.sum("_n").over(every)), [total_col]
    if groups is not None:
        offsets = offsets.join(groups.select(*grp), grp, "left_semi")
    out = tagged.join(offsets.select("_pid", *grp, "_off", "_first", *extra), ["_pid", *grp], "inner")
    return (out.withColumn(index_col, (F.col("_off") + F.col("_mid") - F.col("_first"))
                           .cast("bigint"))
            .drop("_pid", "_mid", "_off", "_first"))
