"""Intermediate tables: written once, read by everything that follows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
PREFIX = "cashlens_staged_"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local folder only where driver and executors are one process."""
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cashlens-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    return f"{staging_dir(spark)}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    if not _used:
        atexit.register(_forget_at_exit)
    _used[spark.sparkContext.applicationId] = spark
    return f"{_run_dir(spark)}/{name}_{uuid.uuid4().hex}"


_used: dict[str, SparkSession] = {}


def _forget_at_exit() -> None:
    for spark in _used.values():
        with contextlib.suppress(Exception):  # the session has ended: the folder's own retention applies
            forget_staged(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` and read it back: cuts its lineage, survives lost executors, prunes columns."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Like `stage`, keeping the partitioning by `keys` for later joins and groupings on them.

    `df` should come in `buckets` partitions (without a number the session's shuffle partitions) by `keys` already: every
    bucket is then written by one task, without another shuffle. Such a task has one file open; with writers for several
    allowed, Spark does not sort its rows by bucket first.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = PREFIX + path.rsplit("/", 1)[1]
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, 2)
    try:
        df.write.bucketBy(buckets, *keys).option("path", path).format("parquet").saveAsTable(table)
    finally:
        spark.conf.set(WRITERS, before)
    return spark.table(table)


def forget_staged(spark: SparkSession) -> None:
    """Drop all that this application has staged: catalog entries and files. Runs at exit, too."""
    for table in spark.catalog.listTables():
        if table.name.startswith(PREFIX):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
