"""Stored tables that take change batches (S9, C5, C6): copy on write in versions.

A table lies under one folder::

    data/commit=<c>/block=<k>/part-*.parquet   rows of ids k*block_rows .. (k+1)*block_rows - 1
    versions/<n>/files                         the files of version n: (path, block, bytes)
    versions/<n>/meta                          key, block size, schema, last batch of each writer

A commit rewrites the blocks that its batch touches into a new commit folder and
publishes the list of files of the next version with one rename that does not
overwrite.  Files are never changed, so a reader sees one version whole; files of untouched blocks
keep their names.  Of two commits on one version the second rename is refused, and that commit is made again
on the newer version.  A batch carries its writer's name and a number that rises; a
number not above the writer's last one has been applied already and changes nothing, so
a batch may be replayed.

Ids are unique, so a block has at most ``block_rows`` rows and a hot range of ids is a range of
blocks.  The driver handles file names only.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innkeep.sources import shared

BLOCK_ROWS = 200_000
_FILES = "path string, block long, bytes long"


class Conflict(RuntimeError):
    """Other writers published first, more often than a commit was tried."""


def block_of(key: str, block_rows: int) -> Column:
    """The block of an id column (floor division, so ids below 0 have blocks too)."""
    return F.expr(f"(`{key}` - pmod(`{key}`, {block_rows}L)) div {block_rows}L")


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions, ascending."""
    return sorted(int(name) for name in shared.names(spark, f"{root}/versions") if name.isdigit())


def latest(spark: SparkSession, root: str) -> int | None:
    return max(versions(spark, root), default=None)


def _meta(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/versions/{version:012d}/meta").first()["value"])


def files(spark: SparkSession, root: str, version: int) -> DataFrame:
    """(path, block, bytes) of the files of a version; paths are relative to its data folder."""
    return spark.read.schema(_FILES).parquet(f"{root}/versions/{version:012d}/files")


def _open(spark: SparkSession, root: str, meta: dict, paths: list[str]) -> DataFrame:
    """The rows of some files, with their block."""
    schema = T.StructType.fromJson(meta["schema"])
    whole = T.StructType([*schema.fields, T.StructField("commit", T.StringType()), T.StructField("block", T.LongType())])
    if not paths:
        return spark.createDataFrame([], whole)
    data = f"{root}/data"
    return spark.read.schema(whole).option("basePath", data).parquet(*[f"{data}/{p}" for p in paths])


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the latest one)."""
    version = latest(spark, root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no version under {root}")
    paths = [r["path"] for r in files(spark, root, version).select("path").collect()]
    return _open(spark, root, _meta(spark, root, version), paths).drop("commit", "block")


def find(spark: SparkSession, root: str, ids: list[int], version: int | None = None) -> DataFrame:
    """the rows of a few ids.  Only files of the ids' blocks are opened, and within them the
    sorted ids skip row groups."""
    version = latest(spark, root) if version is None else version
    meta = _meta(spark, root, version)
    blocks = sorted({i // meta["block_rows"] for i in ids})
    paths = [r["path"] for r in files(spark, root, version).where(F.col("block").isin(blocks)).collect()]
    return _open(spark, root, meta, paths).where(F.col(meta["key"]).isin(list(ids))).drop("commit", "block")


def rows_of(spark: SparkSession, root: str, keys: DataFrame, version: int | None = None) -> DataFrame:
    """The stored rows of the keys in ``keys`` (its only column): files of other blocks are not opened."""
    version = latest(spark, root) if version is None else version
    meta = _meta(spark, root, version)
    mine = keys.toDF(meta["key"]).where(F.col(meta["key"]).isNotNull()).distinct()
    blocks = mine.select(block_of(meta["key"], meta["block_rows"]).alias("block")).distinct()
    paths = [r["path"] for r in files(spark, root, version).join(blocks, "block", "left_semi").select("path").collect()]
    return _open(spark, root, meta, paths).drop("commit", "block").join(mine, meta["key"], "left_semi")


def _write_files(spark: SparkSession, root: str, rows: DataFrame, key: str, block_rows: int) -> list[tuple]:
    """Rows as files of their blocks in a commit folder of their own."""
    commit = uuid.uuid4().hex
    path = f"{root}/data/commit={commit}"
    (rows.withColumn("block", block_of(key, block_rows)).repartition("block").sortWithinPartitions("block", key)
     .write.partitionBy("block").parquet(path))
    found = []
    for file, size in shared.files(spark, path):
        part = re.search(r"/(commit=[0-9a-f]+/block=(-?[0-9]+)/[^/]+\.parquet)$", file)
        if part:
            found.append((part[1], int(part[2]), size))
    return found


def _publish(spark: SparkSession, root: str, version: int, listed: DataFrame, meta: dict) -> bool:
    """Make a version visible; False if another writer was first."""
    tmp = f"{root}/versions/tmp-{uuid.uuid4().hex}"
    listed.coalesce(1).write.parquet(f"{tmp}/files")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{tmp}/meta")
    return shared.rename_once(spark, tmp, f"{root}/versions/{version:012d}")


def create(spark: SparkSession, root: str, rows: DataFrame, key: str = "id", block_rows: int = BLOCK_ROWS) -> int:
    """Version 0 with the given rows, unless the table is there already."""
    if latest(spark, root) is None:
        if rows.where(F.col(key).isNull()).limit(1).count():
            raise ValueError(f"rows without {key}")
        meta = {"key": key, "block_rows": block_rows, "schema": rows.schema.jsonValue(), "writers": {}}
        listed = spark.createDataFrame(_write_files(spark, root, rows, key, block_rows), _FILES)
        _publish(spark, root, 0, listed, meta)
    return latest(spark, root)


def commit(spark: SparkSession, root: str, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame],
           writer: str, number: int, tries: int = 5) -> int:
    """Apply a batch and return the version that holds it.

    ``batch`` has the table's key; ``merge(rows, batch)`` gets the rows of all touched blocks and
    returns what these blocks hold afterwards.
    """
    for _ in range(tries):
        base = latest(spark, root)
        meta = _meta(spark, root, base)
        if number <= meta["writers"].get(writer, -1):
            return base
        key, block_rows = meta["key"], meta["block_rows"]
        touched = batch.select(block_of(key, block_rows).alias("block")).distinct()
        listed = files(spark, root, base)
        old = listed.join(touched, "block", "left_semi")
        rows = _open(spark, root, meta, [r["path"] for r in old.select("path").collect()]).drop("commit", "block")
        new = _write_files(spark, root, merge(rows, batch).select(*[f["name"] for f in meta["schema"]["fields"]]),
                           key, block_rows)
        listed = listed.join(touched, "block", "left_anti").select("path", "block", "bytes").unionByName(
            spark.createDataFrame(new, _FILES))
        meta["writers"][writer] = number
        if _publish(spark, root, base + 1, listed, meta):
            return base + 1
    raise Conflict(f"{root}: {tries} tries were overtaken")


def expire(spark: SparkSession, root: str, keep: int, older_than_ms: int = 24 * 3600 * 1000) -> list[str]:
    """Delete all but the last ``keep`` versions, and commit folders that no kept version lists and
    that are older than ``older_than_ms`` (a commit under way has a young one).  Returns the commits deleted."""
    known = versions(spark, root)
    for version in known[:-keep]:
        shared.delete(spark, f"{root}/versions/{version:012d}")
    used = set()
    for version in known[-keep:]:
        used |= {r["c"] for r in files(spark, root, version).select(F.substring_index("path", "/", 1).alias("c")).distinct().collect()}
    gone = []
    for name in shared.names(spark, f"{root}/data"):
        if name not in used and shared.age_ms(spark, f"{root}/data/{name}") > older_than_ms:
            shared.delete(spark, f"{root}/data/{name}")
            gone.append(name)
    return gone
