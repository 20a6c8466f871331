"""Derived datasets in the cluster's shared folder, written exactly once.

``publish_once(spark, path, write)`` writes into a unique temporary sibling
and renames it into place with a no-overwrite rename (atomic on HDFS and local
file systems).  Concurrent writers therefore never interleave their files: the
first rename wins and every other writer reads the published copy (its own
temporary folder is left unused).  A failed writer leaves only its temporary
folder behind, so a half-written dataset is never visible under ``path``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def _jvm(spark: SparkSession):
    return spark.sparkContext._jvm


def _path(spark: SparkSession, path: str):
    return _jvm(spark).org.apache.hadoop.fs.Path(path)


def _conf(spark: SparkSession):
    return spark.sparkContext._jsc.hadoopConfiguration()


def file_states(spark: SparkSession, path: str) -> list[str]:
    """Name, size and time of every file of a table, from its own file system."""
    p = _path(spark, path)
    fs = p.getFileSystem(_conf(spark))
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return sorted(found)


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, size) of every file below a folder."""
    p = _path(spark, path)
    found, it = [], p.getFileSystem(_conf(spark)).listFiles(p, True)
    while it.hasNext():
        f = it.next()
        found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    p = _path(spark, path)
    fs = p.getFileSystem(_conf(spark))
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def age_ms(spark: SparkSession, path: str) -> int:
    p = _path(spark, path)
    return int(time.time() * 1000) - p.getFileSystem(_conf(spark)).getFileStatus(p).getModificationTime()


def delete(spark: SparkSession, path: str) -> None:
    p = _path(spark, path)
    p.getFileSystem(_conf(spark)).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(_conf(spark)).exists(p)


def rename_once(spark: SparkSession, src: str, dst: str) -> bool:
    jvm = _jvm(spark)
    fs = jvm.org.apache.hadoop.fs
    ctx = fs.FileContext.getFileContext(_path(spark, dst).toUri(), _conf(spark))
    rename_opt = getattr(fs, "Options$Rename")
    opts = spark.sparkContext._gateway.new_array(rename_opt, 1)
    opts[0] = rename_opt.NONE
    try:
        ctx.rename(_path(spark, src), _path(spark, dst), opts)
        return True
    except Exception:  # destination published meanwhile (or rename refused)
        if exists(spark, dst):
            return False
        raise


def publish_once(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Make ``path`` hold the dataset written by ``write(target)``; write only if
    nobody has published it yet.  Returns ``path``."""
    if exists(spark, path):
        return path
    tmp = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    write(tmp)
    rename_once(spark, tmp, path)
    return path


def packed(writer: DataFrameWriter, lines: int) -> DataFrameWriter:
    """``writer`` of text files that are compressed, each of at most so many lines: a compressed file cannot be cut, so
    these are what readers share out.  Joined in order of their names and unpacked they are what one file would be."""
    return (writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
            .option("maxRecordsPerFile", lines))


def is_packed(spark: SparkSession, path: str) -> bool:
    """Whether a file is read through a codec (by its name, as Spark's readers tell)."""
    factory = _jvm(spark).org.apache.hadoop.io.compress.CompressionCodecFactory(_conf(spark))
    return factory.getCodec(_path(spark, path)) is not None


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table of this run in the shared folder, so that its true size is known to the
    plans that read it."""
    from innkeep.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/innkeep-{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
