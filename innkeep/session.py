"""Session helpers.

The library never sets cluster-level options on a session it did not create.
Derived tables are written below the shared folder named by
``spark.checkpoint.dir``; tests and the bench set that folder only when the
session leaves it unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints of frames that are no longer referenced are removed by Spark
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "innkeep", extra: dict | None = None) -> SparkSession:
    """A session.  With ``master`` (tests, scripts, bench) a local one with its own
    settings and, where none is set, a folder of this machine for checkpoints;
    without, the one that spark-submit or the caller's settings describe."""
    builder = SparkSession.builder.appName(app)
    conf = {}
    if master:
        cpus = os.environ.get("BENCH_CPUS", "8")
        builder = builder.master(master)
        conf = dict(_LOCAL_DEFAULTS)
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
        conf["spark.driver.memory"] = os.environ.get("INNKEEP_DRIVER_MEMORY", "8g")
        if not _configured_checkpoint_dir():
            conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="innkeep-ckpt-")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _configured_checkpoint_dir() -> str | None:
    """``spark.checkpoint.dir`` of a running session or of the settings Spark starts with."""
    from pyspark import SparkContext
    running = SparkContext._active_spark_context
    if running is not None:
        return running.getConf().get("spark.checkpoint.dir", None)
    folder = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME", ""), "conf")
    try:
        with open(os.path.join(folder, "spark-defaults.conf"), encoding="utf-8") as f:
            pairs = [line.replace("=", " ", 1).split(None, 1) for line in f if not line.lstrip().startswith("#")]
        return next((p[1].strip() for p in pairs if len(p) == 2 and p[0] == "spark.checkpoint.dir"), None)
    except OSError:
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session that names none gets a folder of
    this machine, any other must name one."""
    current = scratch_root(spark)
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="innkeep-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str | None:
    """The cluster's shared folder (``spark.checkpoint.dir``), or None."""
    try:
        value = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # pragma: no cover - conf access differs on Connect
        value = None
    if not value:
        value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return value or None


def has_jvm(spark: SparkSession) -> bool:
    """True for a classic session with a reachable JVM (False on Spark Connect)."""
    try:
        return spark.sparkContext._jvm is not None
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        return False


def default_parallelism(spark: SparkSession) -> int | None:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return None
