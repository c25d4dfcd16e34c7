"""Description rules as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from cashlens.functions import fixed
from cashlens.sources.dimensions import lender_list

# Word boundaries follow Unicode letters, whatever the JDK's default is.
UNICODE = "(?U)"


def any_of(patterns: list[str], flags: str = UNICODE) -> str:
    return flags + "|".join(patterns)


def _whole_words(names: list[str]) -> str:
    return r"\b(?:" + "|".join(re.escape(name) for name in names) + r")\b"


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Plain substring tests, several times cheaper than a regular expression."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def _guarded(needles: list[str], pattern: str) -> Callable[[Column], Column]:
    """Pattern test behind substring tests that every match must pass."""
    return lambda text: contains_any(text, needles) & text.rlike(pattern)


def _shortest(names: list[str]) -> list[str]:
    """The names that contain no other name: enough to find any of them."""
    return [n for n in names if not any(o != n and o in n for o in names)]


LENDER_NAMES = [v for _, _, names in lender_list() for v in names]
ANY_LENDER = UNICODE + _whole_words(LENDER_NAMES)
GENERIC_LOAN = UNICODE + fixed.GENERIC_LOAN_PATTERN

# All of these take upper-cased text.
is_internal_transfer = _guarded(
    ["TF", "TRANSFER", "BR", "ADJUSTMENT", "1005"], any_of(fixed.INTERNAL_TRANSFER_PATTERNS)
)
is_government = _guarded(
    ["PROV", "CRA", "CANADA", "GST", "HST", "BENEFIT"], any_of(fixed.GOVERNMENT_PATTERNS)
)
is_nsf = _guarded(
    ["NSF", "RETURNED", "UNPAID", "DISHONOURED", "FRAIS", "REVERSE", "RECLAIM"],
    any_of(fixed.NSF_PATTERNS),
)
names_lender = _guarded(_shortest(LENDER_NAMES), ANY_LENDER)
pays_generic_loan = _guarded(["LOAN"], GENERIC_LOAN)

_POS_PARTS = fixed.POS_PATTERN.split("|")
_CARD_START = next(i for i, part in enumerate(_POS_PARTS) if part.startswith(r"\b"))
POS_NAMES = [part.replace("\\", "") for part in _POS_PARTS[:_CARD_START]]
POS_CARDS = "|".join(_POS_PARTS[_CARD_START:])


def is_processor(description: Column, upper: Column) -> Column:
    """Any-case processor test of a description, given also in upper case.

    In plain ASCII, letter case folds one to one and names are substrings of the upper-cased
    text; other texts take the regular expression, whose folding rules are its own.
    """
    ascii_only = F.length(description) == F.octet_length(description)
    plain = contains_any(upper, POS_NAMES) | upper.rlike(POS_CARDS)
    return F.when(ascii_only, plain).otherwise(description.rlike("(?iU)" + fixed.POS_PATTERN))


def rule_category(upper: Column) -> Column:
    """Category decided by the upper-cased description alone, null when no rule applies."""
    return (
        F.when(is_internal_transfer(upper), fixed.INTERNAL_TRANSFER)
        .when(is_government(upper), fixed.GOVERNMENT)
        .when(is_nsf(upper), fixed.REVERSAL)
        .when(names_lender(upper), fixed.LOAN_PROCEEDS)
    )


def lender_of(upper: str) -> Column:
    """struct(lender, tier) of the first listed lender named, or of a generic loan payment.

    `upper` is the SQL of the upper-cased description.
    """

    def when(names: str, lender: str, tier: str) -> str:
        found = f"named_struct('lender', '{lender}', 'tier', '{tier}')"
        return f"WHEN rlike({upper}, r'{UNICODE}{names}') THEN {found}"

    listed = " ".join(when(_whole_words(names), name, tier) for name, tier, names in lender_list())
    generic = when(fixed.GENERIC_LOAN_PATTERN, fixed.GENERIC_LENDER, "Standard")
    return F.expr(f"CASE {listed} {generic} END")


def may_pay_lender(upper: Column) -> Column:
    """One test that settles the many descriptions for which `lender_of` is null."""
    return names_lender(upper) | pays_generic_loan(upper)


def transfer_text(description: Column) -> Column:
    """Upper-cased text reduced to the characters a transfer reference is made of."""
    return F.regexp_replace(F.upper(description), r"[^A-Z0-9#\-]", "")


def first_transfer_ref(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, fixed.TRANSFER_REF_PATTERN, 0), F.lit(""))


def contained_transfer_refs(text: Column) -> Column:
    """Every reference that occurs in the text, including as part of a longer one.

    A reference starts at a TF and its head has one reading, so only the last group can be
    read at two lengths: four closing digits also contain the reference ending after three.
    """
    longest = F.regexp_extract_all(text, F.lit(fixed.TRANSFER_REF_PATTERN), F.lit(0))
    shorter = F.transform(
        F.filter(longest, lambda ref: ref.rlike(r"[\-#]\d{4}$")),
        lambda ref: F.regexp_extract(ref, r"^(.*)\d$", 1),
    )
    return F.array_distinct(F.concat(longest, shorter))


def monthly_equivalent(amount: str, frequency: str) -> Column:
    """Payment amount times payments per month; text that is no number counts as 0."""
    factors = " ".join(f"WHEN '{n}' THEN {f}D" for n, f in fixed.PAYMENTS_PER_MONTH.items())
    value = f"coalesce(nanvl(try_cast({amount} AS DOUBLE), 0D), 0D)"
    return F.expr(f"{value} * CASE {frequency} {factors} ELSE 1D END")


def payment_frequency(payments: str, median_gap: str) -> Column:
    steps = " ".join(f"WHEN {median_gap} <= {days} THEN '{n}'" for days, n in fixed.FREQUENCY_BY_GAP)
    return F.expr(
        f"CASE WHEN {payments} < 2 THEN '{fixed.MONTHLY}' {steps} ELSE '{fixed.MONTHLY}' END"
    )


def ladder(value: str, compare: str, steps: list[tuple[float, int]]) -> str:
    """SQL for the points of the first bound met; null scores 0."""
    whens = " ".join(f"WHEN {value} {compare} {bound} THEN {points}" for bound, points in steps)
    return f"CASE {whens} ELSE 0 END"


def choice_points(value: str, points: dict[str, int], other: int) -> str:
    whens = " ".join(f"WHEN '{choice}' THEN {score}" for choice, score in points.items())
    return f"CASE {value} {whens} ELSE {other} END"
