"""Intermediate tables in the folder that all executors share.

A written table cuts lineage, survives lost executors and is computed once, however often it is read.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_runs: dict[str, tuple[SparkSession, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only if it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "local" not in _local:
        _local["local"] = tempfile.mkdtemp(prefix="shelf-")
    return _local["local"]


_local: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_all() -> None:
    for spark, path in list(_runs.values()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before: its folder is the cluster's to clear
            continue
    _runs.clear()


atexit.register(_delete_all)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; it is deleted when the driver exits."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _runs[path] = (spark, path)
    return path


#: Whether a query's shuffle files go with its end.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes in an Arrow batch that goes to Python, so that long texts don't add up to 10,000 rows of them.
BATCH_BYTES = "16m"


class Shelf:
    """Tables written by one operator call. `keep` deletes those that the result doesn't read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.tables: list[tuple[DataFrame, str]] = []
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def put(self, df: DataFrame, release: bool = False) -> DataFrame:
        """Writes `df` and reads it back. `release` deletes the shuffle files of the write at once instead of some time
        after; only for a plan that shares no exchange with a later one."""
        path = new_path(self.spark, self.name)
        before = self.spark.conf.get(RELEASE)
        try:
            if release:
                self.spark.conf.set(RELEASE, "true")
            df.write.parquet(path)
        finally:
            self.spark.conf.set(RELEASE, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def keep(self, *frames: DataFrame) -> None:
        """Call it when all other tables have served: every plan that reads them has run."""
        for table, path in self.tables:
            if not any(table is frame for frame in frames):
                _delete(self.spark, path)
                _runs.pop(path, None)
        self.tables = [(table, path) for table, path in self.tables if path in _runs]
