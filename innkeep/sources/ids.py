"""Blocks of new ids for jobs that append at the same time.

A sequence is a folder of reservations ``<n>``, each with its first id, its length and the name of
the batch it was made for.  Reservation n + 1 begins where n ends and becomes visible with one rename that does not
overwrite, so of two jobs that try for the same number one is refused and takes the next.
A batch that has a reservation already (a job run again) gets the same one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.operators.ordering import with_global_index
from innkeep.sources import shared


def reservations(spark: SparkSession, root: str) -> list[dict]:
    """All reservations in order."""
    names = [n for n in shared.names(spark, root) if n.isdigit()]
    if not names:
        return []
    lines = spark.read.text([f"{root}/{n}" for n in names]).collect()
    return sorted((json.loads(r["value"]) for r in lines), key=lambda x: x["no"])


def reserve(spark: SparkSession, root: str, batch: str, count: int, start: int = 1, tries: int = 20) -> int:
    """The first of ``count`` ids that no other batch has; a new sequence begins at ``start``."""
    for _ in range(tries):
        known = reservations(spark, root)
        for x in known:
            if x["batch"] == batch:
                if x["count"] != count:
                    raise ValueError(f"batch {batch} had {x['count']} rows, now {count}")
                return x["first"]
        first = known[-1]["first"] + known[-1]["count"] if known else start
        mine = {"no": len(known), "batch": batch, "first": first, "count": count}
        tmp = f"{root}/tmp-{uuid.uuid4().hex}"
        spark.createDataFrame([(json.dumps(mine),)], "value string").coalesce(1).write.text(tmp)
        if shared.rename_once(spark, tmp, f"{root}/{len(known):012d}"):
            return first
        shared.delete(spark, tmp)
    raise RuntimeError(f"{root}: {tries} tries were overtaken")


def numbered(rows: DataFrame, root: str, batch: str, order: list, id_col: str = "id", start: int = 1) -> DataFrame:
    """``rows`` with new dense ids in a given order, from a block reserved for the batch."""
    placed = with_global_index(rows, order, index_col="_n")
    first = reserve(rows.sparkSession, root, batch, placed.count(), start)
    return placed.withColumn(id_col, F.col("_n") + F.lit(first)).drop("_n")
