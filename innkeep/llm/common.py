"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.session import ensure_checkpoint_dir
from innkeep.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a documents-like frame; a null text counts as empty.

    Only these two columns are read, so extra columns of any name do no harm.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (one job); survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Parquet tables of one run in the shared folder, each freed once its successor is written.

    Lineage is cut as by a reliable checkpoint, but the rows are compressed and the
    space can be given back while the run goes on.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def free(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in frames:
            _, path = self.paths.pop(id(df))
            shared.delete(self.spark, path)


def _pairs(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Rows (u, v) for each of the named column pairs."""
    rows = [F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in columns]
    return df.select(F.explode(F.array(*rows)).alias("x")).select("x.u", "x.v")


def connected_components(edges: DataFrame, max_rounds: int = 60, tables: Tables | None = None) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b).

    Every node that occurs in an edge gets the smallest node reachable from
    it.  Alternating large-star / small-star contraction: each round joins the
    edges with one pre-aggregated minimum per node (partial ``min`` before the
    shuffle, so a hub costs one row per partition) and is checkpointed; the
    number of rounds is logarithmic in the longest chain.  No part of the graph
    is brought to the driver; only the count and an order-free hash of the
    edges are, to see whether a round still changed anything.  With ``tables`` each
    round's edges are written there and the round before is freed.
    """
    keep = tables.keep if tables else cut_lineage
    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .where("u <> v").distinct())
    e = keep(e)
    before = None
    for _ in range(max_rounds):
        both = _pairs(e, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = _pairs(joined, ("v", "m"), ("u", "m")).where("u <> v").distinct()
        last, e = e, keep(small)
        if tables:
            tables.free(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (_pairs(e, ("u", "v"), ("v", "v")).groupBy(F.col("u").alias("node"))
            .agg(F.min("v").alias("component")))
