"""Recurring lender payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cashlens.functions import rules
from cashlens.operators.settle import settle
from cashlens.operators.skew import as_of, latest_per_key

LENDER = ["application_id", "lender"]


def lender_debits(debits: DataFrame) -> DataFrame:
    """Debit rows that pay a lender, with lender and tier."""
    return (
        settle(debits, {"_upper": F.upper("description")})
        .where(rules.may_pay_lender(F.col("_upper")))
        .withColumn("_lender", rules.lender_of("_upper"))
        .select(
            "application_id",
            "tx_date",
            F.col("_lender.lender").alias("lender"),
            F.col("_lender.tier").alias("tier"),
            F.col("amount").alias("payment_amount"),
            "month",
        )
    )


def lender_debit_dedup(debits: DataFrame) -> DataFrame:
    """One row per (date, lender, amount) with a calendar date; a lender has one tier."""
    return (
        debits.where(F.col("tx_date").isNotNull())
        .select(*LENDER, "tier", "tx_date", "payment_amount")
        .distinct()
    )


def payment_gaps(payments: DataFrame) -> DataFrame:
    """Number of payments and median days between consecutive ones, per lender.

    Payments are first counted per day, so the ordered window of a lender holds at most one
    row per calendar day. Payments on the same day are 0 days apart.
    """
    days = payments.groupBy(*LENDER, "tx_date").agg(
        F.count("*").alias("n"), F.min("tier").alias("tier")
    )
    since_last = F.datediff(
        "tx_date", F.lag("tx_date").over(Window.partitionBy(*LENDER).orderBy("tx_date"))
    )
    gaps = F.array(
        F.struct(since_last.alias("gap"), F.lit(1).cast("long").alias("times")),
        F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("times")),
    )
    return (
        days.select(*LENDER, "tx_date", "n", "tier", gaps.alias("gaps"))
        .select(*LENDER, "tx_date", "tier", F.posexplode("gaps").alias("i", "g"), "n")
        .groupBy(*LENDER)
        .agg(
            F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("payments"),
            F.percentile("g.gap", 0.5, F.col("g.times")).alias("median_gap"),
            F.min_by("tier", "tx_date").alias("tier"),
        )
    )


def usual_payment(payments: DataFrame) -> DataFrame:
    """Most frequent payment amount per lender, the smallest on a tie."""
    return (
        payments.groupBy(*LENDER, "payment_amount")
        .agg(F.count("*").alias("n"))
        .groupBy(*LENDER)
        .agg(F.max_by("payment_amount", F.struct("n", -F.col("payment_amount"))).alias("payment_amount"))
    )


def positions(debits: DataFrame) -> DataFrame:
    """One row per lender: tier, usual payment, frequency, monthly equivalent."""
    payments = lender_debit_dedup(debits)
    frequency = rules.payment_frequency("payments", "median_gap")
    return (
        payment_gaps(payments)
        .join(usual_payment(payments), LENDER)
        .withColumn("frequency", frequency)
        .select(
            *LENDER,
            "tier",
            "payment_amount",
            "frequency",
            rules.monthly_equivalent("payment_amount", "frequency").alias("monthly_payment"),
        )
    )


def position_overrides(found: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply an analyst's edits: change, add or (removed = true) drop positions.

    Edits have application_id, lender, tier, payment_amount (text allowed), frequency,
    removed; null fields keep the found value. Of several edits of a lender the one with the
    highest seq counts, if there is such a column.
    """
    edited = latest_per_key(edits, LENDER).select(
        *LENDER,
        F.col("tier").alias("_tier"),
        F.col("payment_amount").cast("string").alias("_amount"),
        F.col("frequency").alias("_frequency"),
        F.coalesce("removed", F.lit(False)).alias("_removed"),
    )
    merged = (
        found.join(edited, LENDER, "full_outer")
        .where("_removed is null or not _removed")
        .select(
            *LENDER,
            F.coalesce("_tier", "tier").alias("tier"),
            F.coalesce("_amount", F.col("payment_amount").cast("string")).alias("_value"),
            F.coalesce("_frequency", "frequency", F.lit("Monthly")).alias("frequency"),
        )
    )
    return merged.select(
        *LENDER,
        "tier",
        F.col("_value").try_cast("decimal(18,2)").alias("payment_amount"),
        "frequency",
        rules.monthly_equivalent("_value", "frequency").alias("monthly_payment"),
    )


#: Days without a payment after which a new run begins.
RUN_GAP = 45


def payment_runs(payments: DataFrame, gap: int = RUN_GAP) -> DataFrame:
    """Runs of payments to a lender: an advance that ended and one that began later are two.

    `payments` as `lender_debit_dedup` leaves them. A run ends when no payment follows within `gap` days. Payments
    are added up per day before the session window orders a lender's days.
    """
    days = payments.groupBy(*LENDER, "tx_date").agg(
        F.count("*").alias("n"), F.sum("payment_amount").alias("paid"), F.min("tier").alias("tier")
    )
    session = F.session_window(F.col("tx_date").cast("timestamp_ntz"), f"{gap} days")
    return (
        days.groupBy(*LENDER, session.alias("run"))
        .agg(
            F.min("tx_date").alias("run_from"),
            F.max("tx_date").alias("run_to"),
            F.sum("n").alias("payments"),
            F.sum("paid").alias("paid"),
            F.min_by("tier", "tx_date").alias("tier"),
        )
        .drop("run")
    )


def position_history(found: DataFrame, months: DataFrame, edits: DataFrame) -> DataFrame:
    """Positions in force at the end of each statement month, after the edits dated up to then.

    `edits` as for `position_overrides`, with edit_date (and seq, if a day has several). Of a lender's edits the latest up
    to a month's end holds for it; one that removes the position leaves no row. Lenders that edits add are not found
    positions and have no row.
    """
    dated = edits.where(F.col("edit_date").isNotNull()).withColumnRenamed("edit_date", "day")
    changed = ["payment_amount", "frequency", "removed"]
    events = latest_per_key(dated, [*LENDER, "day"]).select(
        *LENDER, "day", *[F.col(c).cast("string" if c != "removed" else "boolean").alias(f"_{c}") for c in changed]
    )
    end = F.last_day(F.concat("month", F.lit("-01")).try_cast("date"))
    points = found.join(months.select("application_id", "month").distinct().hint("merge"), "application_id").withColumn("day", end)
    held = as_of(points, events, LENDER, "day", [f"_{c}" for c in changed]).where("_removed is null or not _removed")
    return held.select(
        *LENDER,
        "month",
        "tier",
        F.coalesce("_payment_amount", F.col("payment_amount").cast("string")).alias("_value"),
        F.coalesce("_frequency", "frequency").alias("frequency"),
    ).select(
        *LENDER,
        "month",
        "tier",
        F.col("_value").try_cast("decimal(18,2)").alias("payment_amount"),
        "frequency",
        rules.monthly_equivalent("_value", "frequency").alias("monthly_payment"),
    )


def position_totals(found: DataFrame) -> DataFrame:
    """Positions and monthly payments per application; summed as decimals, so whatever the order of the rows."""
    total = F.sum(F.col("monthly_payment").try_cast("decimal(28,6)")).cast("double")
    return found.groupBy("application_id").agg(
        F.count("*").alias("position_count"), total.alias("total_monthly_payment")
    )
