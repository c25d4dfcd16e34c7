"""Positioned words of statement pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WORDS_SCHEMA = (
    "application_id bigint, file_name string, upload_seq int, page_no int, word_seq int, "
    "x0 double, top double, text string"
)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS_SCHEMA).parquet(path)


def pages_without_words(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Pages known from the text table for which no positioned word exists."""
    keys = ["application_id", "file_name", "upload_seq", "page_no"]
    return pages.select(*keys).distinct().join(words.select(*keys).distinct(), keys, "left_anti")
