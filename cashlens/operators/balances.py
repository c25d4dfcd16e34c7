"""Daily balances, from the printed opening balance and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cashlens.operators.skew import latest_per_key, spread_partitions

APP = "application_id"
#: Days that are added up in one window.
DAYS_IN_BLOCK = 64
TOTAL_TYPE = "decimal(28,2)"


def opening_balances(balances: DataFrame) -> DataFrame:
    """application_id, opening: of the first file that prints an opening balance (see `anchors.opening_closing`)."""
    order = F.struct("upload_seq", "file_name")
    return (
        balances.where(F.col("opening").isNotNull())
        .groupBy(APP)
        .agg(F.min_by("opening", order).cast(TOTAL_TYPE).alias("opening"))
    )


def daily_net(ledger: DataFrame) -> DataFrame:
    """application_id, day_no, net: credits less debits of each day with an entry.

    Rows without a calendar date have no day and are left out; `diagnostics.bad_dates` reports them.
    """
    signed = F.when(F.col("tx_type") == "credit", F.col("amount")).when(F.col("tx_type") == "debit", -F.col("amount"))
    return (
        ledger.where(F.col("tx_date").isNotNull())
        .groupBy(APP, F.unix_date("tx_date").alias("day_no"))
        .agg(F.coalesce(F.sum(signed), F.lit(0)).cast(TOTAL_TYPE).alias("net"))
    )


def daily_balances(ledger: DataFrame, openings: DataFrame) -> DataFrame:
    """application_id, day, net, balance: one row for every calendar day from the first entry to the last.

    `openings` holds at most one opening balance per application; without one the balance starts at 0.

    Entries are first added up per day. Days are cut into blocks: blocks are summed and accumulated on a table of one
    row per block, then days with an entry are accumulated inside their block. So no window holds an application's days,
    however long its statements run. The days between two entries are made last, from the earlier of the two: they are
    never shuffled, grouped or sorted.
    """
    block = F.floor(F.col("day_no") / DAYS_IN_BLOCK).cast("int")
    net = daily_net(ledger).withColumn("block", block)
    in_block = net.groupBy(APP, "block").agg(
        F.sum("net").alias("in_block"), F.min("day_no").alias("first"), F.max("day_no").alias("last")
    )
    spans = in_block.groupBy(APP).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    low, high = (F.floor(F.col(c) / DAYS_IN_BLOCK).cast("int") for c in ("first", "last"))
    every_block = spans.select(APP, "first", "last", F.explode(F.sequence(low, high)).alias("block"))
    earlier = Window.partitionBy(APP).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        every_block.join(in_block.select(APP, "block", "in_block"), [APP, "block"], "left")
        .withColumn("before", F.coalesce(F.sum("in_block").over(earlier), F.lit(0)))
        .join(openings, APP, "left")
    )
    no_total = F.lit(None).cast(TOTAL_TYPE)
    first_days = starts.select(
        APP,
        "block",
        F.greatest("first", F.col("block") * DAYS_IN_BLOCK).alias("day_no"),
        F.lit(0).cast(TOTAL_TYPE).alias("net"),
        (F.coalesce("opening", F.lit(0)) + F.col("before")).cast(TOTAL_TYPE).alias("start"),
        F.least("last", (F.col("block") + 1) * DAYS_IN_BLOCK - 1).alias("to_day"),
    )
    entries = net.select(APP, "block", "day_no", "net", no_total.alias("start"), F.lit(None).cast("int").alias("to_day"))
    # One exchange by block serves both the grouping by day and the window. Its partitions shrink too much in a shuffle to
    # be merged by their size there.
    days = (
        first_days.unionByName(entries)
        .repartition(spread_partitions(ledger), APP, "block")
        .groupBy(APP, "block", "day_no")
        .agg(F.sum("net").cast(TOTAL_TYPE).alias("net"), F.max("start").alias("start"), F.max("to_day").alias("to_day"))
    )
    in_order = Window.partitionBy(APP, "block").orderBy("day_no")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    # A block's first day holds its start and its end.
    held = days.select(
        APP,
        "day_no",
        "net",
        (F.max("start").over(so_far) + F.sum("net").over(so_far)).cast(TOTAL_TYPE).alias("balance"),
        F.coalesce(F.lead("day_no").over(in_order) - 1, F.max("to_day").over(so_far)).alias("until"),
    )
    return held.select(APP, "day_no", "net", "balance", F.explode(F.sequence("day_no", "until")).alias("on")).select(
        APP,
        F.date_from_unix_date("on").alias("day"),
        F.when(F.col("on") == F.col("day_no"), F.col("net")).otherwise(0).cast(TOTAL_TYPE).alias("net"),
        "balance",
    )


def balance_facts(daily: DataFrame) -> DataFrame:
    """Per application: days, average daily balance, negative days, lowest and last balance."""
    return daily.groupBy(APP).agg(
        F.count("*").alias("days"),
        (F.sum("balance").cast("double") / F.count("*")).alias("avg_daily_balance"),
        F.count_if(F.col("balance") < 0).alias("negative_days"),
        F.min("balance").alias("lowest_balance"),
        F.max_by("balance", "day").alias("last_balance"),
    )


def answers_from_ledger(inputs: DataFrame, facts: DataFrame, velocity: DataFrame | None = None) -> DataFrame:
    """Manual answers with those left open taken from the ledger: daily balance, negative days, borrowing velocity.

    A manual answer always wins. Of several rows of an application the latest counts; applications with a ledger only
    get a row.
    """
    found = facts.select(APP, F.col("avg_daily_balance").alias("_balance"), F.col("negative_days").cast("int").alias("_days"))
    filled = {"avg_daily_balance": "_balance", "negative_days": "_days"}
    if velocity is not None:
        found = found.join(velocity.select(APP, F.col("borrowing_velocity").alias("_velocity")), APP, "full_outer")
        filled["borrowing_velocity"] = "_velocity"
    given = latest_per_key(inputs, [APP]).drop("seq")
    joined = given.join(found, APP, "full_outer")
    return joined.select(*[F.coalesce(c, filled[c]).alias(c) if c in filled else F.col(c) for c in given.columns])
