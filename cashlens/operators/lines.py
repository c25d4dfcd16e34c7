"""Positioned words to text lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cashlens.functions import fixed
from cashlens.functions.rules import contains_any
from cashlens.functions.text import strip
from cashlens.operators.skew import spread_partitions

# What a word can be, as bits of one number, so that the line steps only compare numbers.
MONTH_NAME, AMOUNT_LIKE, HAS_DIGIT, SHORT_NUMBER = 1, 2, 4, 8
BALANCE_HEADING, DEBIT_HEADING, CREDIT_HEADING = 16, 32, 64

# Numbers of lines from the top of a page; the last one is for words whose place is no number.
FARTHEST_LINE, LAST_LINE = 1 << 62, (1 << 63) - 1

# A name may be uploaded again with other content: the number of the upload is part of a file's identity.
FILE = ["application_id", "file_name", "upload_seq"]
PAGE = [*FILE, "page_no"]


def word_dedup(words: DataFrame, spread: bool = True) -> DataFrame:
    """First word of each (rounded position, text) on a page; blank words drop out.

    Words are brought together by page first: `line_grouping` then finds them in place, and no other shuffle of the words
    follows. Copies stand side by side in one sort of the page, which comes nearly sorted; grouping words by hash would
    hold every word twice and lose that order. Without `spread` the session decides on how many partitions there are.
    """
    parts = [spread_partitions(words)] if spread else []
    place = ["_top", "_x", "text"]
    by_place = Window.partitionBy(*PAGE).orderBy(*place, F.asc_nulls_last("word_seq"))
    # A text is never null here, but the one before the first is.
    copy = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_before{c}")) for c in place])
    numbered = F.col("word_seq").isNotNull()
    return (
        words.withColumn("text", strip(F.col("text")))
        .where("text <> ''")
        .repartition(*parts, *PAGE)
        .withColumns({"_top": F.bround("top", 1), "_x": F.bround("x0", 1)})
        .withColumns({f"_before{c}": F.lag(c).over(by_place) for c in place})
        .where(~copy)
        .select(*PAGE, "word_seq", F.when(numbered, F.col("x0")).alias("x0"), F.when(numbered, F.col("top")).alias("top"), "text")
    )


def word_kind(text: Column) -> Column:
    lower = F.lower(text)
    debit_heading = contains_any(lower, fixed.DEBIT_HEADINGS)
    has_digit = text.rlike(r"[\d,]")
    tests = {
        MONTH_NAME: lower.isin([m.lower() for m in fixed.MONTHS]),
        AMOUNT_LIKE: has_digit | text.rlike(r"[.\-()]"),
        HAS_DIGIT: has_digit,
        # Two digits, and the line break of up to two characters that `$` passes over.
        SHORT_NUMBER: (F.length(text) <= 4) & text.rlike(r"^\d{1,2}$"),
        BALANCE_HEADING: F.when(lower.contains(" "), F.translate(lower, " ", "")).otherwise(lower).isin(fixed.BALANCE_HEADINGS),
        DEBIT_HEADING: debit_heading,
        CREDIT_HEADING: ~debit_heading & contains_any(lower, fixed.CREDIT_HEADINGS),
    }
    return reduce(lambda a, b: a + b, [F.when(t, bit).otherwise(0) for bit, t in tests.items()])


def is_kind(word: Column, bits: int) -> Column:
    return word["kind"].bitwiseAND(bits) != 0


def has_kind(kinds: Column, bits: int) -> Column:
    """Whether any word of a line is of one of these kinds, from the line's `kinds`."""
    return kinds.bitwiseAND(bits) != 0


def line_grouping(words: DataFrame) -> DataFrame:
    """One row per text line: its place, its words from left to right, what kinds are among them, its text and the next line's.

    Takes words as `word_dedup` leaves them, partitioned by page. One sort by page, line and place serves the words of a
    line, line numbers and the look-ahead: all are windows over prefixes of that order. (A grouped list would fall back to
    sorting as well, and then sort each list.) A page is bounded by its paper: 4,115 line positions at most.
    """
    # A whole number: a double that windows divide by is normalised first, and sorted rows are not in the order of its own
    # values then. No paper reaches the outermost; what is no number comes after all that are.
    pitch = F.rint(F.col("top") / fixed.LINE_PITCH)
    y_key = F.when(F.isnan(pitch), LAST_LINE).when(pitch.between(-FARTHEST_LINE, FARTHEST_LINE), pitch.cast("long"))
    y_key = y_key.otherwise(F.signum(pitch).cast("long") * FARTHEST_LINE)
    in_line = Window.partitionBy(*PAGE, "y_key").orderBy("x0", "word_seq", "text")
    whole = in_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.partitionBy(*PAGE).orderBy("y_key")
    return (
        words.withColumn("kind", word_kind(F.col("text")))
        .withColumn("y_key", y_key)
        .select(
            *PAGE,
            "y_key",
            F.collect_list(F.struct("x0", "text", "kind")).over(whole).alias("words"),
            F.bit_or("kind").over(whole).alias("kinds"),
            F.row_number().over(in_line).alias("_place"),
        )
        .where("_place = 1")
        .withColumn("line", F.array_join("words.text", " "))
        .select(
            *PAGE,
            "y_key",
            F.row_number().over(order).alias("line_no"),
            "words",
            "kinds",
            "line",
            F.coalesce(F.lead("line").over(order), F.lit("")).alias("next_line"),
        )
    )
