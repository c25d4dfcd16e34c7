"""Round trips: the same transfer reference on both sides of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cashlens.functions import fixed, rules


def wash_refs(ledger: DataFrame) -> DataFrame:
    """Distinct first reference of the rows of each side."""
    ref = rules.first_transfer_ref(rules.transfer_text(F.col("description")))
    return (
        ledger.select("application_id", "tx_type", ref.alias("ref"))
        .where("ref is not null")
        .distinct()
    )


def wash_pairs(ledger: DataFrame) -> DataFrame:
    """References found on both sides, with the rows containing each and their round trips.

    Containment is turned into equality: each row is listed under every reference its text
    contains, so one grouped count replaces matching rows against references.
    """
    rows = ledger.where(F.col("tx_type").isin("credit", "debit")).withColumn(
        "_text", rules.transfer_text(F.col("description"))
    )
    first = rules.first_transfer_ref(F.col("_text"))
    listed = rows.where(F.col("_text").rlike(fixed.TRANSFER_REF_PATTERN)).select(
        "application_id",
        (F.col("tx_type") == "credit").alias("_credit"),
        first.alias("_first"),
        F.explode(rules.contained_transfer_refs(F.col("_text"))).alias("ref"),
    )
    own = F.col("_first") == F.col("ref")
    return (
        listed.groupBy("application_id", "ref")
        .agg(
            F.count_if(F.col("_credit")).alias("credit_rows"),
            F.count_if(~F.col("_credit")).alias("debit_rows"),
            F.count_if(own & F.col("_credit")).alias("_own_credits"),
            F.count_if(own & ~F.col("_credit")).alias("_own_debits"),
        )
        .where("_own_credits > 0 and _own_debits > 0")
        .select(
            "application_id",
            "ref",
            "credit_rows",
            "debit_rows",
            F.least("credit_rows", "debit_rows").alias("round_trips"),
        )
    )


def wash_flags(pairs: DataFrame) -> DataFrame:
    """Round trips per application and whether they are enough to be a pattern."""
    return (
        pairs.groupBy("application_id")
        .agg(F.sum("round_trips").alias("round_trips"))
        .withColumn("wash_detected", F.col("round_trips") >= fixed.WASH_MIN_ROUND_TRIPS)
    )


def wash_category_counts(ledger: DataFrame) -> DataFrame:
    """Rows put in a wash category by label or review, per application."""
    wash = F.lower("category").contains("wash")
    return (
        ledger.groupBy("application_id")
        .agg(F.count_if(wash).alias("wash_rows"))
        .withColumn("wash_by_category", F.col("wash_rows") >= fixed.WASH_MIN_CATEGORY_ROWS)
    )
