"""Session defaults, shared storage and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Settings a stand-alone run starts with; a cluster's own session keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "cairn") -> SparkSession:
    """The session there is, or one as the cluster's own settings say; only what is unset gets a default."""
    if (now := SparkSession.getActiveSession()) is not None:
        return now
    SparkContext._ensure_initialized()  # before that no setting is seen
    given = SparkConf()  # what spark-submit and the environment set
    build = SparkSession.builder.appName(given.get("spark.app.name", name))
    for k, v in (DEFAULTS | {"spark.master": "local[*]"}).items():
        if not given.contains(k):
            build = build.config(k, v)
    return build.getOrCreate()


def local_session(name: str = "cairn", cores: int = 8, memory: str = "12g") -> SparkSession:
    """A session on this machine, for tests and the bench."""
    build = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in DEFAULTS.items():
        build = build.config(k, v)
    spark = (
        build.config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster is refused, since a
    machine-local folder would not be seen by the other machines.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if sc.getCheckpointDir():
            return sc.getCheckpointDir()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
