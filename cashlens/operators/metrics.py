"""Cash-flow metrics, one row per application."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cashlens.functions import fixed
from cashlens.operators import skew
from cashlens.operators.positions import position_totals
from cashlens.operators.summary import ledger_months
from cashlens.operators.wash import wash_flags, wash_pairs

APP = "application_id"


def deposit_median(ledger: DataFrame) -> DataFrame:
    credits = ledger.where("tx_type = 'credit'").select(APP, "amount")
    return skew.exact_median(credits, [APP], "amount", "median_deposit")


def application_totals(months: DataFrame) -> DataFrame:
    """Everything about an application that its months determine, in one grouping.

    Averages, volatility and trend are taken over the months that have revenue.
    """
    in_series = F.col("month").isNotNull() & (F.col("revenue_rows") > 0)
    series_month = F.when(in_series, F.col("month"))
    revenue = F.when(in_series, F.col("revenue_total"))
    totals = months.groupBy(APP).agg(
        F.sum("deposit_total").cast("double").alias("gross_deposits"),
        F.coalesce(F.max("largest_deposit").cast("double"), F.lit(0.0)).alias("largest_deposit"),
        F.sum("nsf_rows").alias("payment_performance"),
        F.sum("wash_rows").alias("wash_rows"),
        F.count("*").alias("_months"),
        F.count(series_month).alias("revenue_months"),
        F.sum(revenue).cast("double").alias("_revenue"),
        F.sum(F.when(in_series, F.col("revenue_rows"))).alias("_rows"),
        F.stddev_samp(revenue.cast("double")).alias("_deviation"),
        F.min_by("revenue_total", series_month).cast("double").alias("_first"),
        F.max_by("revenue_total", series_month).cast("double").alias("_last"),
    )
    some = F.col("revenue_months") > 0
    average = F.when(some, F.col("_revenue") / F.col("revenue_months")).otherwise(0.0)
    count = F.when(some, F.bround(F.col("_rows") / F.col("revenue_months"))).otherwise(0.0)
    varies = (F.col("_months") > 1) & (F.col("avg_true_revenue") > 0)
    moves = (F.col("revenue_months") >= 2) & (F.col("_first") > 0)
    return totals.withColumn("avg_true_revenue", average).select(
        APP,
        "gross_deposits",
        "largest_deposit",
        "payment_performance",
        "wash_rows",
        "revenue_months",
        "avg_true_revenue",
        count.cast("long").alias("deposit_count"),
        # Null (not a number) when a single month has revenue; such a null scores 0.
        F.when(varies, F.col("_deviation") / F.col("avg_true_revenue") * 100)
        .otherwise(0.0)
        .alias("revenue_volatility"),
        F.when(moves, (F.col("_last") - F.col("_first")) / F.col("_first") * 100)
        .otherwise(0.0)
        .alias("revenue_trend"),
    )


def deposit_stats(totals: DataFrame, medians: DataFrame) -> DataFrame:
    """Sum, median and maximum of the credits; 0 without credits."""
    return totals.join(medians, APP, "left").select(
        APP,
        "gross_deposits",
        F.coalesce("median_deposit", F.lit(0.0)).alias("median_deposit"),
        "largest_deposit",
    )


def revenue_concentration(ledger: DataFrame) -> DataFrame:
    """Share of the largest payer in all revenue, in percent."""
    payers = (
        ledger.where("is_revenue")
        .groupBy(APP, "payer_or_source")
        .agg(F.sum("amount").alias("_sum"))
    )
    named = F.when(F.col("payer_or_source").isNotNull(), F.col("_sum"))
    share = F.col("_top").cast("double") / F.col("_all").cast("double") * 100
    return (
        payers.groupBy(APP)
        .agg(F.sum("_sum").alias("_all"), F.max(named).alias("_top"))
        .select(APP, F.when(F.col("_all") > 0, share).otherwise(0.0).alias("revenue_concentration"))
    )


def advance_burden(revenue: DataFrame, positions: DataFrame) -> DataFrame:
    """Existing positions against average revenue; the other columns of `revenue` stay."""
    monthly, average = F.col("total_monthly_payment"), F.col("avg_true_revenue")
    return revenue.join(position_totals(positions), APP, "left").select(
        *revenue.columns,
        F.coalesce("position_count", F.lit(0)).alias("position_count"),
        F.coalesce(monthly, F.lit(0.0)).alias("total_monthly_payment"),
        F.when((average > 0) & monthly.isNotNull(), monthly / average * 100)
        .otherwise(0.0)
        .alias("burden_pct"),
        F.when(monthly > 0, average / monthly)
        .otherwise(fixed.NO_DEBT_COVERAGE)
        .alias("coverage_ratio"),
    )


def metrics(ledger: DataFrame, positions: DataFrame, washes: DataFrame | None = None) -> DataFrame:
    """All metrics of the applications that have a ledger.

    `washes` are round trips found elsewhere (`wash_flags`); without them the ledger's own count.
    The ledger is read four times (months, payers, deposits, references), so a caller stages
    it. Every input of the joins is one row per application, already grouped by it.
    """
    totals = application_totals(ledger_months(ledger))
    return (
        advance_burden(totals, positions)
        .join(deposit_median(ledger), APP, "left")
        .join(revenue_concentration(ledger), APP, "left")
        .join(wash_flags(wash_pairs(ledger)) if washes is None else washes, APP, "left")
        .select(
            APP,
            "gross_deposits",
            F.coalesce("median_deposit", F.lit(0.0)).alias("median_deposit"),
            "largest_deposit",
            "revenue_months",
            "avg_true_revenue",
            "deposit_count",
            "revenue_volatility",
            "revenue_trend",
            F.coalesce("revenue_concentration", F.lit(0.0)).alias("revenue_concentration"),
            "position_count",
            "total_monthly_payment",
            "burden_pct",
            "coverage_ratio",
            "payment_performance",
            F.coalesce("round_trips", F.lit(0)).alias("wash_round_trips"),
            (
                F.coalesce("wash_detected", F.lit(False))
                | (F.col("wash_rows") >= fixed.WASH_MIN_CATEGORY_ROWS)
            ).alias("wash_flag"),
        )
    )
