"""How often a business took new funding, from the loan proceeds in its ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cashlens.functions import fixed

APP = "application_id"
#: The span, in days, of the question on borrowing velocity.
SPAN = 90


def funding_velocity(ledger: DataFrame, span: int = SPAN) -> DataFrame:
    """application_id, last_day, fundings, most_fundings, borrowing_velocity of each application with a dated entry.

    A funding is a day on which loan proceeds came in: one advance may be paid out in parts. `fundings` counts those in
    the `span` days that end with the ledger's last day, `most_fundings` those in the busiest such span.

    Rows are counted per day first, so that the window, a range of days back from each, holds a row per calendar day.
    """
    proceeds = (F.col("tx_type") == "credit") & (F.col("category") == fixed.LOAN_PROCEEDS)
    days = (
        ledger.where(F.col("tx_date").isNotNull())
        .groupBy(APP, F.unix_date("tx_date").alias("day_no"))
        .agg(F.max(F.when(proceeds, 1).otherwise(0)).alias("funded"))
    )
    back = Window.partitionBy(APP).orderBy("day_no").rangeBetween(1 - span, 0)
    counted = days.withColumn("in_span", F.sum("funded").over(back))
    some = F.least("fundings", F.lit(2)).cast("string")
    return (
        counted.groupBy(APP)
        .agg(
            F.date_from_unix_date(F.max("day_no")).alias("last_day"),
            F.max_by("in_span", "day_no").alias("fundings"),
            F.max("in_span").alias("most_fundings"),
        )
        .withColumn(
            "borrowing_velocity",
            F.concat(some, F.when(F.col("fundings") > 1, "+").otherwise(""), F.lit(f" in {span} Days")),
        )
    )
