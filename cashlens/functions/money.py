"""Money text to numbers, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from cashlens.functions import fixed
from cashlens.functions.text import strip

MONEY_TYPE = "decimal(18,2)"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _separators(body: Column) -> Column:
    """Printed separators to a plain decimal point.

    The separator that comes last is the decimal one; a lone kind of comma is decimal only
    before exactly two closing digits.
    """
    comma_decimal = F.translate(body, ",.", ".")
    comma_last = F.instr(F.reverse(body), ",") < F.instr(F.reverse(body), ".")
    return (
        F.when(~body.contains(","), body)
        .when(body.contains(".") & comma_last, comma_decimal)
        .when(~body.contains(".") & body.rlike(r",[^,]{2}$"), comma_decimal)
        .otherwise(F.translate(body, ",", ""))
    )


def money_text(value: Column) -> Column:
    """Canonical signed number text of a printed amount; null when it is not a number."""

    def number(compact: Column) -> Column:
        body = F.regexp_replace(compact, r"^[()]+|[()]+$", "")
        plain = bind(body, lambda b: bind(_separators(b), lambda n: F.when(n.rlike(PLAIN_NUMBER), n)))
        opposite = bind(
            plain,
            lambda n: F.when(n.startswith("-"), F.ltrim(n, F.lit("-"))).otherwise(
                F.concat(F.lit("-"), F.ltrim(n, F.lit("+")))
            ),
        )
        return F.when(compact.startswith("(") & compact.endswith(")"), opposite).otherwise(plain)

    return bind(F.translate(strip(value), "$ ", ""), number)


def parse_money(value: Column) -> Column:
    return money_text(value).try_cast("double")


def money_from_words(words: Column) -> Column:
    """Absolute amount of the last money-like token in the joined words, as number text.

    Null without words and empty when they hold no number.
    """
    joined = F.translate(F.array_join(words, ""), "$ ", "")

    def last_match(pattern: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(joined, F.lit(pattern), F.lit(0)), F.lit(-1))

    token = F.coalesce(last_match(fixed.MONEY_WITH_CENTS), last_match(fixed.MONEY_WHOLE))
    # A sign before a parenthesis is no number and leaves nothing here.
    digits = F.regexp_extract(token, r"^(?:-|\(?)([\d,.]+)\)?$", 1)
    # Before two closing digits one comma is the decimal point and several make no number.
    point = F.regexp_replace(digits, r"^(\d*),(\d\d)$", "$1.$2")
    sound = F.regexp_replace(point, r"^.*,.*,\d\d$", "")
    return F.when(F.size(words) > 0, F.translate(sound, ",", ""))


def to_amount(text: Column) -> Column:
    return text.try_cast(MONEY_TYPE)
