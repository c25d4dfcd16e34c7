"""Reconciliation and the reviewer's view of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cashlens.functions import fixed
from cashlens.operators.ledger import LEDGER_KEY
from cashlens.operators.skew import latest_per_key

GROUP = ["application_id", "category", "payer_or_source"]


def reconcile(ledger: DataFrame, anchors: DataFrame) -> DataFrame:
    """Ledger credits against the total the bank printed (application_id, expected_credits)."""
    gross = ledger.groupBy("application_id").agg(
        F.coalesce(F.sum(F.when(F.col("tx_type") == "credit", F.col("amount"))), F.lit(0))
        .cast("double")
        .alias("ledger_total")
    )
    expected = F.coalesce("expected_credits", F.lit(0.0)).cast("double")
    gap = F.abs(F.round(F.col("ledger_total") - F.col("expected_credits"), 2))
    return (
        gross.join(anchors.select("application_id", "expected_credits"), "application_id", "left")
        .withColumn("expected_credits", expected)
        .withColumn("variance", F.when(F.col("expected_credits") != 0, gap))
        .withColumn(
            "status",
            F.when(F.col("expected_credits") == 0, "Anchor Missing")
            .when(F.col("variance") > fixed.RECONCILE_TOLERANCE, "Mismatch Detected")
            .otherwise("Matched"),
        )
    )


def filter_options(ledger: DataFrame) -> DataFrame:
    """Months and categories a reviewer can pick, per application."""
    option = F.explode(
        F.array(
            F.struct(F.lit("month").alias("kind"), F.col("month").alias("value")),
            F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
        )
    )
    return (
        ledger.select("application_id", option.alias("o"))
        .select("application_id", "o.kind", "o.value")
        .where("value is not null")
        .distinct()
    )


def ledger_filter(ledger: DataFrame, month: str = "All", category: str = "All") -> DataFrame:
    if month != "All":
        ledger = ledger.where(F.col("month") == month)
    if category != "All":
        ledger = ledger.where(F.col("category") == category)
    return ledger


def row_override(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Set is_revenue on single rows (ledger key + is_revenue); review flags stay.

    Of several edits of a row the one with the highest seq counts, if there is such a column.
    """
    edits = latest_per_key(overrides, LEDGER_KEY).select(
        *[F.col(k).alias(f"_{k}") for k in LEDGER_KEY], F.col("is_revenue").alias("_set")
    )
    same = [ledger[k].eqNullSafe(edits[f"_{k}"]) for k in LEDGER_KEY]
    joined = ledger.join(edits, same, "left")
    return joined.select(
        *[
            F.coalesce("_set", "is_revenue").alias(c) if c == "is_revenue" else F.col(c)
            for c in ledger.columns
        ]
    )


def _set_groups(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Give all rows of the listed groups (GROUP, _set) the value `_set`."""
    joined = ledger.join(changes, GROUP, "left")
    cleared = F.coalesce("_set", F.lit(False))
    new = {
        "is_revenue": F.coalesce("_set", "is_revenue").alias("is_revenue"),
        "needs_review": (~cleared & F.col("needs_review")).alias("needs_review"),
    }
    return joined.select(*[new.get(c, F.col(c)) for c in ledger.columns])


def _group_states(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*GROUP).agg(
        F.count_if(F.col("is_revenue")).alias("_yes"), F.count_if(~F.col("is_revenue")).alias("_no")
    )


def group_override(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Set is_revenue on whole (category, payer) groups in which any row differs.

    Such a group also leaves review when it is set to true. Of several edits of a group the one
    with the highest seq counts, if there is such a column. Groups are compared after being
    counted, so only the groups that change are joined back to the rows.
    """
    wanted = latest_per_key(overrides, GROUP).select(*GROUP, F.col("is_revenue").alias("_set"))
    changes = (
        _group_states(ledger)
        .join(wanted, GROUP)
        .where(F.when(F.col("_set"), F.col("_no")).otherwise(F.col("_yes")) > 0)
        .select(*GROUP, "_set")
    )
    return _set_groups(ledger, changes)


def group_mode_normalise(ledger: DataFrame) -> DataFrame:
    """Give every mixed (category, payer) group its most frequent is_revenue, false on a tie."""
    mixed = (
        _group_states(ledger)
        .where("_yes > 0 and _no > 0")
        .select(*GROUP, (F.col("_yes") > F.col("_no")).alias("_set"))
    )
    return _set_groups(ledger, mixed)


def category_payer_summary(ledger: DataFrame) -> DataFrame:
    """Total, row count and prevailing is_revenue per (category, payer)."""
    return (
        ledger.where("category is not null and payer_or_source is not null")
        .groupBy(*GROUP)
        .agg(
            F.sum("amount").alias("total"),
            F.count("amount").alias("row_count"),
            (F.count_if(F.col("is_revenue")) > F.count_if(~F.col("is_revenue"))).alias("is_revenue"),
        )
    )


def review_kpis(ledger: DataFrame) -> DataFrame:
    """Headline figures of the review screen, per application."""
    amount = F.col("amount")
    months = ledger.groupBy("application_id", "month").agg(
        F.sum(F.when(F.col("is_revenue"), amount)).alias("revenue"),
        F.sum(F.when(F.col("needs_review"), amount)).alias("review"),
        F.sum(F.when(F.col("tx_type") == "credit", amount)).alias("gross"),
    )

    def total(name: str):
        return F.coalesce(F.sum(name), F.lit(0)).cast("double")

    revenue, gross = F.col("true_revenue"), F.col("gross_deposits")
    return (
        months.groupBy("application_id")
        .agg(
            total("revenue").alias("true_revenue"),
            total("review").alias("under_review"),
            total("gross").alias("gross_deposits"),
            F.count("month").alias("active_months"),
        )
        .select(
            "*",
            F.when(F.col("active_months") > 0, revenue / F.col("active_months"))
            .otherwise(0.0)
            .alias("kpi_avg_monthly_revenue"),
            F.when(gross > 0, (gross - revenue) / gross * 100)
            .otherwise(0.0)
            .alias("non_revenue_pct"),
        )
    )


ROLLUP = ["month", "category", "payer_or_source"]


def review_rollup(ledger: DataFrame) -> DataFrame:
    """Totals of an application, its months, its categories and its (category, payer) groups in one grouping.

    `level` says which; columns that a level adds up over are null, as are the ones of rows without a month or payer, so
    only the level tells them apart. Rows are summed per level in map tasks: one shuffle carries all four.
    """
    credit, revenue = F.col("tx_type") == "credit", F.coalesce("is_revenue", F.lit(False))
    amount = F.col("amount")
    levels = [["application_id"], ["application_id", "month"], ["application_id", "category"], GROUP]
    summed = ledger.groupingSets(levels, "application_id", *ROLLUP).agg(
        F.grouping("month").alias("_month"),
        F.grouping("category").alias("_category"),
        F.grouping("payer_or_source").alias("_payer"),
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(amount), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(credit, amount)), F.lit(0)).alias("gross_deposits"),
        F.coalesce(F.sum(F.when(revenue, amount)), F.lit(0)).alias("true_revenue"),
        F.coalesce(F.sum(F.when(F.col("needs_review"), amount)), F.lit(0)).alias("under_review"),
    )
    level = (
        F.when(F.col("_payer") == 0, "payer")
        .when(F.col("_category") == 0, "category")
        .when(F.col("_month") == 0, "month")
        .otherwise("application")
    )
    return summed.select("application_id", level.alias("level"), *ROLLUP, *summed.columns[-5:])
