"""Placed lines to transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cashlens.functions import dates, fixed, rules
from cashlens.functions.money import bind, money_from_words, to_amount
from cashlens.functions.rules import contains_any
from cashlens.operators.lines import (
    AMOUNT_LIKE,
    FILE,
    HAS_DIGIT,
    MONTH_NAME,
    PAGE,
    SHORT_NUMBER,
    is_kind,
)
from cashlens.operators.positions import lender_debits as pays_lender
from cashlens.operators.settle import settle

LEDGER_COLUMNS = [
    "application_id",
    "tx_date",
    "date_text",
    "month",
    "description",
    "amount",
    "payer_or_source",
    "tx_type",
    "source_file",
    "upload_seq",
    "page_no",
    "line_no",
]


def row_gate(lines: DataFrame) -> DataFrame:
    """Lines that can carry a transaction: date rows, and amounts below a date."""
    has_amount = F.col("line").rlike(fixed.CURRENCY)
    return lines.where(F.col("is_date_row") | (F.col("date_text").isNotNull() & has_amount))


def _within(x: Column, low: Column | float, high: Column | float) -> Column:
    return (x >= low) & (x < high)


def _from_first(words: Column, accept) -> Column:
    """The array without the elements before the first accepted one."""

    def rest(all_words: Column) -> Column:
        # Not `array_position`: to end its search Spark throws an exception within, for every row.
        start = F.array_min(F.transform(all_words, lambda w, n: F.when(accept(w), n + 1)))
        return F.slice(all_words, F.coalesce(start, F.size(all_words) + 1), F.size(all_words))

    return bind(words, rest)


def band_split(lines: DataFrame) -> DataFrame:
    """Adds the description, debit and credit words of each line by horizontal position."""
    words = F.col("words")
    numeric = fixed.NUMERIC_LAYOUT_BANDS

    def described(word: Column) -> Column:
        return (word["x0"] < F.col("desc_limit")) & ~is_kind(word, MONTH_NAME)

    def in_debit(word: Column) -> Column:
        return _within(word["x0"], F.col("debit_min"), F.col("debit_max"))

    def in_credit(word: Column) -> Column:
        return _within(word["x0"], F.col("credit_min"), F.col("credit_max"))

    def is_amount(word: Column) -> Column:
        return is_kind(word, AMOUNT_LIKE) & ~described(word)

    def is_left(word: Column) -> Column:
        return word["x0"] < F.col("balance_x")

    # One pass over the words for each list: lists of lists would be made anew for each that is made of them.
    desc = _from_first(F.filter(words, lambda w: is_left(w) & described(w)), lambda w: ~is_kind(w, SHORT_NUMBER))
    debit = F.filter(words, lambda w: in_debit(w) & is_left(w) & is_amount(w))
    credit = F.filter(words, lambda w: in_credit(w) & is_left(w) & ~in_debit(w) & is_amount(w))

    def numeric_band(name: str, keep) -> Column:
        return F.filter(words, lambda w: _within(w["x0"], *numeric[name]) & keep(w))

    def has_digit(word: Column) -> Column:
        return is_kind(word, HAS_DIGIT)

    def by_layout(numeric_words: Column, banded_words: Column) -> Column:
        return F.when(fixed_bands, numeric_words).otherwise(banded_words)["text"]

    fixed_bands = F.col("numeric_layout") & F.col("is_date_row")
    return settle(
        lines,
        {
            "desc_words": by_layout(numeric_band("desc", lambda w: w["text"] != "|"), desc),
            "debit_words": by_layout(numeric_band("debit", has_digit), debit),
            "credit_words": by_layout(numeric_band("credit", has_digit), credit),
        },
    )


def is_summary(description: Column, word_count: Column) -> Column:
    """Lines that repeat balances and totals instead of a transaction."""
    upper = F.upper(description)
    return contains_any(upper, fixed.SUMMARY_PHRASES) | (upper.contains("TOTAL") & (word_count < 3))


def statement_rows(lines: DataFrame) -> DataFrame:
    """Dated rows with description, debit and credit amount (null when absent)."""
    split = settle(
        band_split(row_gate(lines)),
        {
            "description": F.array_join("desc_words", " "),
            "debit_text": money_from_words(F.col("debit_words")),
            "credit_text": money_from_words(F.col("credit_words")),
        },
    )
    return (
        split.where("debit_text <> '' or credit_text <> ''")
        .where(~is_summary(F.col("description"), F.size("desc_words")))
        .select(
            *PAGE,
            "line_no",
            "date_text",
            dates.calendar_date(F.col("date_text")).alias("tx_date"),
            dates.month_text(F.col("date_text")).alias("month"),
            "description",
            "debit_text",
            "credit_text",
            to_amount(F.col("debit_text")).alias("debit"),
            to_amount(F.col("credit_text")).alias("credit"),
        )
    )


def _credit() -> Column:
    description = F.when(F.col("description") == "", fixed.EMPTY_DESCRIPTION).otherwise(
        F.col("description")
    )
    entry = F.struct(
        description.alias("description"),
        F.col("credit").alias("amount"),
        description.alias("payer_or_source"),
        F.lit("credit").alias("tx_type"),
    )
    return F.when(F.col("credit") > 0, entry)


def _nsf_debit() -> Column:
    upper = F.upper("description")
    entry = F.struct(
        F.col("description").alias("description"),
        F.col("debit").alias("amount"),
        F.lit(fixed.BANK_FEE_PAYER).alias("payer_or_source"),
        F.lit("debit").alias("tx_type"),
    )
    kept = (
        (F.col("debit") > fixed.NSF_MIN_AMOUNT)
        & rules.is_nsf(upper)
        & ~upper.rlike(fixed.NSF_FEE_EXEMPT_PATTERN)
    )
    return F.when(kept, entry)


def _entries(rows: DataFrame, *entries: Column) -> DataFrame:
    return (
        rows.withColumn("source_file", F.col("file_name"))
        .select("*", F.explode(F.array_compact(F.array(*entries))).alias("entry"))
        .select(
            *[
                F.col(f"entry.{c}").alias(c)
                if c in ("description", "amount", "payer_or_source", "tx_type")
                else F.col(c)
                for c in LEDGER_COLUMNS
            ]
        )
    )


def credit_rows(rows: DataFrame) -> DataFrame:
    return _entries(rows, _credit())


def nsf_debit_rows(rows: DataFrame) -> DataFrame:
    """Debits for returned items above the fee limit."""
    return _entries(rows, _nsf_debit())


def ledger_rows(rows: DataFrame) -> DataFrame:
    """Credits and returned-item debits in one pass over the statement rows."""
    return _entries(rows, _credit(), _nsf_debit())


def all_rows(rows: DataFrame) -> DataFrame:
    """Credits and every debit, the wider ledger for round-trip detection."""
    debit = F.struct(
        F.col("description").alias("description"),
        F.col("debit").alias("amount"),
        F.col("description").alias("payer_or_source"),
        F.lit("debit").alias("tx_type"),
    )
    return _entries(rows, _credit(), F.when(F.col("debit") > 0, debit))


def lender_debits(rows: DataFrame) -> DataFrame:
    return pays_lender(rows.where("debit > 0").withColumn("amount", F.col("debit")))


def file_debit_total(rows: DataFrame) -> DataFrame:
    """Sum of all debits of a file."""
    return rows.where("debit > 0").groupBy(*FILE).agg(F.sum("debit").alias("debit_total"))
