"""Descriptions and the category that the rules give them, stored between runs."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cashlens.functions import fixed, rules
from cashlens.operators.skew import first_per_key
from cashlens.sources.dimensions import lender_list

SCHEMA = "description string, category string, batch string, rules string"


def rules_version() -> str:
    """Names the rules in force: entries made by other rules are not used again."""
    patterns = [fixed.INTERNAL_TRANSFER_PATTERNS, fixed.GOVERNMENT_PATTERNS, fixed.NSF_PATTERNS, lender_list()]
    return hashlib.md5(repr(patterns).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def known_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """description, category, batch of the stored entries under the present rules; none where nothing is stored.

    An entry that two runs made at the same time, or that a repeated run made again, counts once.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA).drop("rules")
    stored = spark.read.schema(SCHEMA).parquet(path).where(F.col("rules") == rules_version())
    return first_per_key(stored, ["description"], [F.col("batch")]).drop("rules")


def unseen_descriptions(ledger: DataFrame, known: DataFrame) -> DataFrame:
    """The ledger's different descriptions that the dictionary lacks. Map tasks reduce rows to descriptions first."""
    listed = ledger.where(F.col("description").isNotNull()).select("description").distinct()
    return listed.join(known.select("description"), "description", "left_anti")


def learn_descriptions(ledger: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends the unseen descriptions of a ledger, with their category by rule (null where no rule applies).

    The rules run on unseen descriptions only. `batch` names the run, by default at random. A run that is repeated, or
    that fails before its end, leaves a sound dictionary: entries are only ever added.
    """
    spark = ledger.sparkSession
    new = unseen_descriptions(ledger, known_descriptions(spark, path)).withColumn("_upper", F.upper("description"))
    new.select(
        "description",
        rules.rule_category(F.col("_upper")).alias("category"),
        F.lit(batch or uuid.uuid4().hex).alias("batch"),
        F.lit(rules_version()).alias("rules"),
    ).write.mode("append").parquet(path)


def categories_from_dictionary(ledger: DataFrame, known: DataFrame) -> DataFrame:
    """Adds `category` from the dictionary, as `classify.rule_categories` does from the rules.

    Each description of the ledger must have been learnt; null descriptions have no category. No hint on the join: under
    its size limit Spark broadcasts the dictionary, above it adaptive execution splits the rows of a hot description.
    """
    entries = known.select(F.col("description").alias("_of"), "category")
    joined = ledger.join(entries, F.col("description") == F.col("_of"), "left")
    return joined.select(*[ledger[c] for c in ledger.columns], "category")
