"""Session settings and the shared folder for written intermediate tables."""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL = re.compile(r"local(\[[^\]]*\])?")
#: Folder that the tables settled now go to, while inside :func:`scratch`.
_RUN: ContextVar[str | None] = ContextVar("run_folder", default=None)


def local_session(
    cores: int | str = 8, shuffle_partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("peagelens")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    if checkpoint_dir:
        builder = builder.config(CHECKPOINT_CONF, checkpoint_dir)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a fresh
    temporary folder, kept for the life of the session.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not _LOCAL.fullmatch(spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="peagelens-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_RUN.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Spark's own file systems."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(there, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for everything that is settled inside; it is removed at the end.

    Results that read settled tables have to be collected or written before it ends.
    """
    path = fresh_path(spark, "run")
    token = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(token)
        remove(spark, path)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write a small derived table to the shared folder and read it back.

    Cuts lineage so that lost executors never trigger a new scan of the fact
    table, and gives the planner the true size: a join against the result is
    broadcast only when its files are below ``autoBroadcastJoinThreshold``.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
