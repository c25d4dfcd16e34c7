"""Totals that the bank printed on the statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cashlens.functions import dates, fixed
from cashlens.functions.money import MONEY_TYPE, money_text, to_amount
from cashlens.operators.lines import FILE

ANY_CASE = "(?iU)"
TOTAL_TYPE = "decimal(28,2)"


def file_facts(texts: DataFrame) -> DataFrame:
    """What the layout steps need to know of a file: its year and its date layout."""
    return texts.select(
        *FILE,
        dates.statement_year(F.col("text")).alias("year"),
        F.upper("text").contains(fixed.NUMERIC_LAYOUT_BANK).alias("numeric_layout"),
    )


def anchor_of(text: Column) -> Column:
    """struct(method, total) of the first family with a match; null without any.

    All matches of the family are added up; one that cannot be read counts as 0.
    """

    def family(name: str, pattern: str) -> Column:
        matches = F.regexp_extract_all(text, F.lit(ANY_CASE + pattern), F.lit(1))
        total = F.aggregate(
            matches,
            F.lit(0).cast(TOTAL_TYPE),
            lambda acc, m: (
                acc + F.coalesce(to_amount(money_text(m)), F.lit(0).cast(MONEY_TYPE))
            ).cast(TOTAL_TYPE),
        )
        return F.when(F.size(matches) > 0, F.struct(F.lit(name).alias("method"), total.alias("total")))

    return F.coalesce(*[family(name, pattern) for name, pattern in fixed.ANCHOR_FAMILIES])


def anchor_total(texts: DataFrame) -> DataFrame:
    return texts.withColumn("_anchor", anchor_of(F.col("text"))).select(
        *FILE,
        F.col("_anchor.method").alias("anchor_method"),
        F.col("_anchor.total").alias("anchor_total"),
    )


def _first_amount(text: Column, pattern: str) -> Column:
    return to_amount(money_text(F.regexp_extract(text, ANY_CASE + pattern, 1)))


def opening_balance(text: Column) -> Column:
    return _first_amount(text, fixed.OPENING_BALANCE)


def closing_balance(text: Column) -> Column:
    return F.coalesce(
        _first_amount(text, fixed.CLOSING_BALANCE), _first_amount(text, fixed.CURRENT_BALANCE)
    )


def opening_closing(texts: DataFrame) -> DataFrame:
    return texts.select(
        *FILE,
        opening_balance(F.col("text")).alias("opening"),
        closing_balance(F.col("text")).alias("closing"),
    )


def file_anchors(texts: DataFrame) -> DataFrame:
    """Printed total and balances of each file, in one pass over the text."""
    text = F.col("text")
    return texts.withColumn("_anchor", anchor_of(text)).select(
        *FILE,
        F.col("_anchor.method").alias("anchor_method"),
        F.col("_anchor.total").alias("anchor_total"),
        opening_balance(text).alias("opening"),
        closing_balance(text).alias("closing"),
    )


def implied_anchor(anchors: DataFrame, debit_totals: DataFrame) -> DataFrame:
    """Fills in closing - opening + debits for files without a printed total, if not negative."""
    implied = F.col("closing") - F.col("opening") + F.coalesce("debit_total", F.lit(0))
    usable = F.col("anchor_method").isNull() & (implied >= 0)
    return (
        anchors.join(debit_totals, FILE, "left")
        .withColumn("implied_total", F.when(F.col("anchor_method").isNull(), implied))
        .select(
            *anchors.columns,
            "debit_total",
            "implied_total",
            F.when(usable, "balance_change").otherwise(F.col("anchor_method")).alias("used_method"),
            F.when(usable, implied).otherwise(F.col("anchor_total")).cast(TOTAL_TYPE).alias("used_total"),
        )
    )


def expected_credits(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Sum of the used anchors per application, and whether every processed file has one.

    `files` lists the files that are no duplicates.
    """
    used = anchors.groupBy("application_id").agg(
        F.sum("used_total").alias("expected_credits"), F.count("used_method").alias("anchors")
    )
    return (
        files.groupBy("application_id")
        .agg(F.count("*").alias("files"))
        .join(used, "application_id", "left")
        .select(
            "application_id",
            F.coalesce("expected_credits", F.lit(0)).cast("double").alias("expected_credits"),
            F.coalesce("anchors", F.lit(0)).alias("anchors"),
            "files",
            (F.coalesce("anchors", F.lit(0)) < F.col("files")).alias("anchor_warning"),
        )
    )
