"""Where the columns of a statement are, and which date a line belongs to.

Both are states carried down a file. They are settled per page first, passed from page to
page on a table of one row per page, and joined back to the lines by page, so the lines of a
file are never sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cashlens.functions import dates, fixed
from cashlens.functions.rules import contains_any
from cashlens.operators.lines import (
    BALANCE_HEADING,
    CREDIT_HEADING,
    DEBIT_HEADING,
    FILE,
    PAGE,
    has_kind,
    is_kind,
)
from cashlens.operators.skew import carry_forward

PAGES_PER_BLOCK = 1024


def balance_x(words: Column, line_no: Column) -> Column:
    """Left bound of the balance column if the line has its heading near the top of the page."""

    hit = F.filter(words, lambda w: is_kind(w, BALANCE_HEADING))
    return F.when(line_no <= fixed.HEADER_SEARCH_LINES, F.get(hit, F.lit(0))["x0"] - 10)


def calibration(words: Column, line: Column, next_line: Column) -> Column:
    """struct(desc_limit, debit_min, debit_max, credit_min) read from a heading line, else null."""

    def last_x(kind: int) -> Column:
        return F.try_element_at(F.filter(words, lambda w: is_kind(w, kind)), F.lit(-1))["x0"]

    debit, credit = last_x(DEBIT_HEADING), last_x(CREDIT_HEADING)
    near, far = F.least(debit, credit), F.greatest(debit, credit)
    bands = F.struct(
        (debit - 10).alias("desc_limit"),
        (near - 20).alias("debit_min"),
        (far - 5).alias("debit_max"),
        (far - 20).alias("credit_min"),
    )
    gate = contains_any(F.lower(F.concat_ws(" ", line, next_line)), fixed.HEADING_GATE)
    return F.when(gate & debit.isNotNull() & credit.isNotNull(), bands)


def is_noise(line: Column) -> Column:
    return contains_any(F.upper(line), fixed.NOISE_PHRASES)


def line_states(lines: DataFrame) -> DataFrame:
    """Adds what each line says about columns and dates, and the latest of it on its page.

    Noise lines say nothing about dates but may hold column headings. Lines lie in the order of their places already, and
    are numbered in it: a window by number would sort them, with all their words, once more.
    """
    read = ~F.col("noise")
    so_far = Window.partitionBy(*PAGE).orderBy("y_key").rowsBetween(Window.unboundedPreceding, 0)
    stated = lines.withColumn("noise", is_noise(F.col("line"))).select(
        *PAGE,
        "y_key",
        "line_no",
        "words",
        "line",
        "noise",
        # Few lines hold a heading; only their words are looked through.
        F.when(has_kind(F.col("kinds"), BALANCE_HEADING), balance_x(F.col("words"), F.col("line_no"))).alias("balance_x"),
        F.when(
            has_kind(F.col("kinds"), DEBIT_HEADING) & has_kind(F.col("kinds"), CREDIT_HEADING),
            calibration(F.col("words"), F.col("line"), F.col("next_line")),
        ).alias("bands"),
        F.when(read, dates.line_date(F.col("line"))).alias("worded_date"),
        F.when(read, dates.numeric_line_date(F.col("line"))).alias("numeric_date"),
    )
    either = F.coalesce("numeric_date", "worded_date")
    return stated.select(
        *[c for c in stated.columns if c != "y_key"],
        F.last("bands", True).over(so_far).alias("bands_so_far"),
        F.last("worded_date", True).over(so_far).alias("worded_so_far"),
        F.last(either, True).over(so_far).alias("either_so_far"),
    )


def page_states(lines: DataFrame, files: DataFrame) -> DataFrame:
    """State with which each page of the given files starts.

    `files` has FILE, year, numeric_layout; pages of other
    files (duplicates, files without text) drop out.
    """
    heading = F.col("balance_x")

    def at_end(name: str) -> Column:
        return F.max_by(name, "line_no")

    pages = lines.groupBy(*PAGE).agg(
        F.min_by(heading, F.when(heading.isNotNull(), F.col("line_no"))).alias("balance"),
        at_end("bands_so_far").alias("bands"),
        at_end("worded_so_far").alias("worded"),
        at_end("either_so_far").alias("either"),
    )
    carried = carry_forward(
        pages, FILE, "page_no", ["balance", "bands", "worded", "either"], PAGES_PER_BLOCK
    )
    date = F.when(F.col("numeric_layout"), F.col("either_before")).otherwise(F.col("worded_before"))
    return carried.join(files, FILE).select(
        *PAGE,
        "year",
        "numeric_layout",
        F.coalesce("balance", "balance_before").alias("page_balance"),
        F.col("bands_before").alias("page_bands"),
        date.alias("page_date"),
    )


def placed_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines with their column bounds and dates; noise lines are dropped only now."""

    def by_layout(numeric: Column, worded: Column) -> Column:
        return F.when(F.col("numeric_layout"), numeric).otherwise(worded)

    either = F.coalesce("numeric_date", "worded_date")
    so_far = by_layout(F.col("either_so_far"), F.col("worded_so_far"))
    stated = (
        lines.where(~F.col("noise"))
        # Of both sides the pages are by far the smaller, and lines lie by page already: they are not sorted again.
        .join(pages.hint("shuffle_hash"), PAGE)
        .withColumn("own_date", by_layout(either, F.col("worded_date")))
        .withColumn("_bands", F.coalesce("bands_so_far", "page_bands"))
        .withColumn("_date", F.coalesce(so_far, F.col("page_date")))
    )
    bands, balance = F.col("_bands"), F.coalesce("page_balance", F.lit(fixed.DEFAULT_BALANCE_X))
    settled = F.col("page_balance").isNotNull() | bands.isNotNull()
    return stated.select(
        *PAGE,
        "line_no",
        "words",
        "line",
        "numeric_layout",
        F.col("own_date").isNotNull().alias("is_date_row"),
        F.when(F.col("_date").isNotNull(), dates.date_text(F.col("_date"), F.col("year"))).alias(
            "date_text"
        ),
        balance.alias("balance_x"),
        F.coalesce(bands["desc_limit"], F.lit(fixed.DEFAULT_DESC_LIMIT)).alias("desc_limit"),
        F.coalesce(bands["debit_min"], F.lit(fixed.DEFAULT_DEBIT_BAND[0])).alias("debit_min"),
        F.coalesce(bands["debit_max"], F.lit(fixed.DEFAULT_DEBIT_BAND[1])).alias("debit_max"),
        F.coalesce(bands["credit_min"], F.lit(fixed.DEFAULT_CREDIT_BAND[0])).alias("credit_min"),
        F.when(settled, balance - 5)
        .otherwise(F.lit(fixed.DEFAULT_CREDIT_BAND[1]))
        .alias("credit_max"),
    )
