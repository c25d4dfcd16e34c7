"""Monthly roll-up of the ledger, the base of the bank summary and of the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cashlens.functions import fixed
from cashlens.operators.positions import position_totals


def ledger_months(ledger: DataFrame) -> DataFrame:
    """One row per application and month (null month included): everything sums are made of.

    Partial aggregation collapses rows before the shuffle, so a huge application travels as
    one row per month and task.
    """
    credit = F.col("tx_type") == "credit"
    revenue = F.coalesce("is_revenue", F.lit(False))
    amount = F.col("amount")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0))

    return ledger.groupBy("application_id", "month").agg(
        F.count_if(credit).alias("deposits"),
        total(credit).alias("deposit_total"),
        F.max(F.when(credit, amount)).alias("largest_deposit"),
        F.count_if(revenue).alias("revenue_rows"),
        total(revenue).alias("revenue_total"),
        F.count_if(credit & ~revenue).alias("non_revenue_rows"),
        total(credit & ~revenue).alias("non_revenue_total"),
        F.count_if(F.lower("category").contains("nsf")).alias("nsf_rows"),
        F.count_if(F.lower("category").contains("wash")).alias("wash_rows"),
    )


def monthly_summary(months: DataFrame, positions: DataFrame) -> DataFrame:
    """Deposits, revenue and loan payments per month.

    The loan columns describe the application and are the same in each of its months.
    """
    loans = position_totals(positions)
    return (
        months.where("month is not null")
        .join(loans, "application_id", "left")
        .select(
            "application_id",
            "month",
            "deposits",
            F.col("deposit_total").alias("total_deposits"),
            F.col("revenue_rows").alias("revenue_count"),
            F.col("revenue_total").alias("total_revenue"),
            F.col("non_revenue_rows").alias("non_revenue_count"),
            F.col("non_revenue_total").alias("total_non_revenue"),
            (F.coalesce("position_count", F.lit(0)) * fixed.LOAN_DEBITS_PER_POSITION).alias("loan_debits"),
            F.coalesce("total_monthly_payment", F.lit(0.0)).alias("total_loan_debits"),
        )
    )
