"""Ledger rows and their identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cashlens.operators.skew import first_per_key

LEDGER_KEY = ["application_id", "tx_date", "amount", "description", "tx_type"]
FILE_ORDER = ["upload_seq", "source_file", "page_no", "line_no"]


def _identity(ledger: DataFrame) -> list[str]:
    # Extracted rows keep the date as printed: two different bad dates stay two rows.
    printed = ["date_text"] if "date_text" in ledger.columns else []
    return LEDGER_KEY + printed


def ledger_dedup(ledger: DataFrame) -> DataFrame:
    """Keep the first row, in file order, of each (date, amount, description, type)."""
    return first_per_key(ledger, _identity(ledger), [F.col(c) for c in FILE_ORDER])


def removed_duplicates(ledger: DataFrame) -> DataFrame:
    """Rows removed by `ledger_dedup`, per application."""
    counts = ledger.groupBy(*_identity(ledger)).agg(F.count("*").alias("n"))
    return counts.groupBy("application_id").agg(
        F.sum("n").alias("rows_before"), F.count("*").alias("rows_kept")
    ).withColumn("rows_removed", F.col("rows_before") - F.col("rows_kept"))
