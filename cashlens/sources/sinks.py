"""Output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cashlens.plans.staging import stage

BUCKET = "application_bucket"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("application_id"), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, mode: str, **options: str) -> None:
    df.hint("rebalance", BUCKET).write.mode(mode).options(**options).partitionBy(BUCKET).parquet(path)


def write_output(df: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Parquet partitioned by application bucket.

    The rebalance hint lets adaptive execution split the bucket of a huge application into
    several files and merge small ones. A whole table replaces a whole table, whatever the session's overwrite mode.
    """
    _write(df.withColumn(BUCKET, _bucket(buckets)), path, mode, partitionOverwriteMode="static")


def rerun_output(df: DataFrame, path: str, applications: DataFrame, buckets: int = 64) -> None:
    """Puts the new rows of some applications in the place of their old ones.

    `df` holds the new rows, `applications` (application_id) names the applications that were run again: one without a
    new row is gone from the table. `buckets` is the number that the table was written with. Buckets without such an
    application are neither read nor written. The others are put together beside the table (their other applications'
    rows and the new ones) and then replaced, each as a whole, by a dynamic partition overwrite; a bucket that has no row
    left is deleted. Running it again, after a failure or not, gives the same table.
    """
    spark = df.sparkSession
    rerun = applications.select("application_id").distinct()
    # At most as many numbers as there are buckets.
    touched = sorted(row[0] for row in rerun.select(_bucket(buckets).alias(BUCKET)).distinct().collect())
    if not touched:
        return
    stored = spark.read.parquet(path)
    others = stored.where(F.col(BUCKET).isin(touched)).join(rerun, "application_id", "left_anti")
    new = df.join(rerun, "application_id", "left_semi").withColumn(BUCKET, _bucket(buckets))
    kept = stage(others.select(*new.columns).unionByName(new), "rerun")
    _write(kept, path, "overwrite", partitionOverwriteMode="dynamic")
    left = {row[0] for row in kept.select(BUCKET).distinct().collect()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for number in set(touched) - left:
        folder = hadoop(f"{path}/{BUCKET}={number}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
