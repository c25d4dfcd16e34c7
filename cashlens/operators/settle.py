"""Keeping costly expressions from being computed more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once per row.

    Later filters on them would otherwise be pushed down with a copy of the whole expression
    for each use; an inlined one-row array stops that.
    """
    row = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(row))
