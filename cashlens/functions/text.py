"""Small text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def label_key(description: Column) -> Column:
    return F.upper(strip(description))
