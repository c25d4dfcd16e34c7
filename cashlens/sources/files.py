"""Statement files and their text."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cashlens.functions.text import strip
from cashlens.operators.settle import settle
from cashlens.operators.skew import spread_partitions


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files laid out as <path>/application_id=<id>/<upload_seq>_<name>.pdf."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(
        F.regexp_extract("path", r"application_id=(\d+)/", 1).cast("long").alias("application_id"),
        F.url_decode(F.regexp_replace(name, r"^\d+_", "")).alias("file_name"),
        F.regexp_extract(name, r"^(\d+)_", 1).try_cast("int").alias("upload_seq"),
        "content",
    )


#: Files that one job writes or lists. Its driver keeps some kilobytes for each: its status, its folder's values, its place
#: in a task.
BATCH_FILES = 20_000
#: Folders are listed by at most so many tasks at a time: by default it is one for each folder, and the driver keeps account
#: of tasks, too.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 64
#: What the driver keeps of listings for later ones, which are of other folders here.
KEPT_LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize"


def _folder_name() -> Column:
    return F.concat_ws("_", F.col("upload_seq").cast("string"), "file_name")


def write_files(texts: DataFrame, path: str) -> None:
    """Texts (application_id, file_name, upload_seq, text) as files <path>/application_id=<id>/file=<seq>_<name>/<part>.

    Every text is a file of its own, ended by a line break; names may hold any character. Rows need an application, a name
    and a number, and no two rows share all three. Making a file takes longer than its text: rows are dealt out by file in a
    given number of partitions, as by the size of a small table one or two tasks would make all files.
    """
    rows = texts.select("application_id", _folder_name().alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(spread_partitions(texts), "application_id", "file")
    dealt.write.partitionBy("application_id", "file").text(path)


def write_batches(texts: DataFrame, path: str) -> Iterator[str]:
    """`write_files` in folders of some `BATCH_FILES` files each, one job after another: the folders, as they are written.

    For `texts` that are read from tables, as each batch reads them again.
    """
    batches = max(1, math.ceil(texts.count() / BATCH_FILES))
    batch = F.pmod(F.xxhash64("application_id", _folder_name()), F.lit(batches))
    for k in range(batches):
        folder = f"{path}/batch_{k}"
        write_files(texts.where(batch == k), folder)
        yield folder


@contextlib.contextmanager
def _lean_listing(spark: SparkSession) -> Iterator[None]:
    """Settings with which listing many folders takes little of the driver's memory."""
    wanted = {LISTING: str(LISTING_TASKS), KEPT_LISTINGS: "0"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as `write_files` lays them out: application_id, file_name, upload_seq, bytes, modified, content.

    Applications and names come from the folders, size and time from the file system's listing (the reader's hidden
    metadata), so a query on them alone opens no file, and one on some applications lists their folders only. The driver
    holds the whole listing: many files are read in the folders of `write_batches`.
    """
    with _lean_listing(spark):
        found = spark.read.format("binaryFile").load(path)
    return found.select(
        F.col("application_id").cast("long").alias("application_id"),
        F.regexp_replace("file", r"^\d+_", "").alias("file_name"),
        F.regexp_extract("file", r"^(\d+)_", 1).try_cast("int").alias("upload_seq"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
        "content",
    )


def file_hashes(files: DataFrame) -> DataFrame:
    """One small row per file; the content goes no further than this."""
    return files.select(
        "application_id", "file_name", "upload_seq", F.sha2("content", 256).alias("sha256")
    )


def file_dedup(hashes: DataFrame) -> DataFrame:
    """Every file with the name of the earlier upload it repeats, null for files to process.

    Uploads are in order of number (none last), then name. Rows equal in both are one upload.
    Only hashes seen more than once are joined back, one row each.
    """
    place = F.struct(
        F.col("upload_seq").isNull().alias("unnumbered"),
        F.coalesce("upload_seq", F.lit(0)).alias("seq"),
        F.col("file_name").alias("name"),
    )
    hashes = hashes.dropDuplicates(["application_id", "file_name", "upload_seq", "sha256"])
    repeated = (
        hashes.groupBy("application_id", "sha256")
        .agg(F.min(place).alias("_kept"), F.count("*").alias("_copies"))
        .where("_copies > 1")
    )
    return hashes.join(repeated, ["application_id", "sha256"], "left").select(
        *hashes.columns,
        F.when(place != F.col("_kept"), F.col("_kept.name")).alias("duplicate_of"),
    )


#: Stands for a missing upload number: after all numbers.
UNNUMBERED = 2147483647


def numbered(df: DataFrame) -> DataFrame:
    """`df` with an upload number in every row, so that files can be joined by it."""
    if "upload_seq" not in df.columns:
        # A column, not a constant: constants are folded out of keys, and partitionings by them aren't found again.
        return settle(df, {"upload_seq": F.lit(1)})
    return df.withColumn("upload_seq", F.coalesce(F.col("upload_seq").cast("int"), F.lit(UNNUMBERED)))


def file_text(pages: DataFrame) -> DataFrame:
    """Text of each file: its pages in order, one per line break, trimmed; empty files drop out.

    A file's text is one value by definition (its source is one binary cell of at most 2 GiB).
    """
    pages = numbered(pages)
    ordered = F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t"))))
    return (
        pages.groupBy("application_id", "file_name", "upload_seq")
        .agg(strip(F.array_join(F.transform(ordered, lambda p: p["t"]), "\n")).alias("text"))
        .where("text <> ''")
    )
