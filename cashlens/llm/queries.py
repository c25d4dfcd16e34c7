"""The registered queries over the training-data tables, one per operator, and SQL where it can express them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashlens.llm import exact, htmltext, mixing, near, pieces, pii, quality, repair, sitelines, suffixes, variants, vectors, warc

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Gives the executors this package, once per application; the zip is served by the driver."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="code-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as package:
        for path in sorted(root.rglob("*.py")):
            package.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(spark.sparkContext.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(read(spark, sf_dir, "documents"), width=4)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(read(spark, sf_dir, "pages"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(read(spark, sf_dir, "pages"))
    again = F.col("type") == "revisit"
    return records.select(
        "page_id",
        F.when(again, F.col("stated_length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(again, F.col("stated_digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(again, F.col("refers_to_page")).alias("refers_to"),
        "fault",
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.drop_spread_lines(read(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"))


#: Letters of the words in `op11_spelling`: ASCII and Latin-1.
LETTERS = "A-Za-z\u00c0-\u00ff"


def damaged_words(docs: DataFrame, every: int = 199) -> DataFrame:
    """Words of six letters or more; by a hash of document and word, one in `every` has lost a letter."""
    runs = variants.letter_runs(docs, LETTERS, 6)
    mark = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    place = (F.col("mark") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return runs.withColumn("mark", mark).select(F.when(F.col("mark") % every == 0, shorter).otherwise(F.col("run")).alias("word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = damaged_words(read(spark, sf_dir, "documents"))
    return variants.spelling_groups(variants.vocabulary(words, min_length=6, min_count=5))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """By a hash of conversation and turn a row is dropped, emptied, cut, repeated or given to the user, or stays."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace(blank("text"), "[.!?]", ""))
    return turns.withColumn("way", way).select(
        "conv_id",
        "turn",
        F.when(F.col("way") == 4, "user").otherwise(blank("role")).alias("role"),
        text.otherwise(blank("text")).alias("text"),
        F.when(F.col("way") == 0, 0).when(F.col("way") == 3, 2).otherwise(1).alias("stands"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(damaged_turns(read(spark, sf_dir, "conversations")), copies="stands").conversations


def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_strings(read(spark, sf_dir, "documents")).drop("spans")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_near_dedup": op4_near_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_main_text": op6_main_text,
    "op7_near_vectors": op7_near_vectors,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_pieces": op10_pieces,
    "op11_spelling": op11_spelling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_repeated_strings": op13_repeated_strings,
}
