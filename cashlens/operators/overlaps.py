"""Statement files of an application that cover the same days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cashlens.operators.skew import spread_partitions

FILE = ["application_id", "source_file", "upload_seq"]


def file_spans(ledger: DataFrame) -> DataFrame:
    """First and last dated entry of each file, and how many there are."""
    return (
        ledger.where(F.col("tx_date").isNotNull())
        .groupBy(*FILE)
        .agg(F.min("tx_date").alias("first_day"), F.max("tx_date").alias("last_day"), F.count("*").alias("entries"))
    )


def statement_overlap(spans: DataFrame) -> DataFrame:
    """Pairs of an application's files whose spans share a day: first and second file (by upload), the days shared.

    An interval join made of equalities: a span is listed under each month that it touches, files meet by application
    and month, and a pair counts in the first month that both touch, so it is found once. A task holds the files of one
    month; files that share no month never meet. Tasks grow in number with what the spans are made of, and both sides of
    the join are one shuffle.
    """
    months = F.sequence(F.trunc("first_day", "month"), F.trunc("last_day", "month"), F.expr("interval 1 month"))
    listed = spans.select(*FILE, "first_day", "last_day", F.explode(months).alias("month"))
    listed = listed.repartition(spread_partitions(spans), "application_id", "month")

    def side(name: str) -> DataFrame:
        place = F.struct("upload_seq", "source_file").alias(f"{name}_file")
        return listed.select("application_id", "month", place, F.col("first_day").alias(f"{name}_from"), F.col("last_day").alias(f"{name}_to"))

    start, end = F.greatest("a_from", "b_from"), F.least("a_to", "b_to")
    pairs = side("a").join(side("b"), ["application_id", "month"])
    return pairs.where((F.col("a_file") < F.col("b_file")) & (start <= end) & (F.trunc(start, "month") == F.col("month"))).select(
        "application_id",
        F.col("a_file.source_file").alias("first_file"),
        F.col("a_file.upload_seq").alias("first_seq"),
        F.col("b_file.source_file").alias("second_file"),
        F.col("b_file.upload_seq").alias("second_seq"),
        start.alias("overlap_from"),
        end.alias("overlap_to"),
        (F.datediff(end, start) + 1).alias("overlap_days"),
    )


def repeated_entries(ledger: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Of each pair of overlapping files: entries of either in the days shared, and how many of the second repeat one of
    the first (same day, amount, description and type). Such a pair is the same account printed twice.

    Entries are counted per day before any pair is met, alone and with each file that has equal ones: entries themselves are
    shuffled once, by day, and what meets the pairs has no amounts or texts. An entry's own count stands under its file
    twice, so that a pair lists its first file, its second, and both. Partitions grow with the ledger.
    """
    key = ["tx_date", "amount", "description", "tx_type"]
    parts = spread_partitions(ledger)
    known = ledger.where(F.col("tx_date").isNotNull()).dropna(subset=FILE)
    lines = known.repartition(parts, "application_id", "tx_date").groupBy(*FILE, *key).agg(F.count("*").alias("n"))
    equal = lines.groupBy("application_id", *key).agg(
        F.sort_array(F.collect_list(F.struct(F.struct("upload_seq", "source_file").alias("file"), "n"))).alias("files")
    )
    # Each file of an entry, then that file itself and those after it.
    left = equal.select("application_id", "tx_date", "files", F.posexplode("files").alias("at", "a"))
    after = F.explode(F.slice("files", F.col("at") + 1, F.size("files"))).alias("b")
    met = left.select("application_id", "tx_date", "a", after)
    shared = ["application_id", "a_seq", "a_file", "b_seq", "b_file"]
    days = met.groupBy(
        "application_id",
        *[F.col(f"{side}.file.{c}").alias(f"{side}_{name}") for side in "ab" for c, name in (("upload_seq", "seq"), ("source_file", "file"))],
        "tx_date",
    ).agg(F.sum(F.least("a.n", "b.n")).alias("n"))

    names = ["application_id", "first_file", "first_seq", "second_file", "second_seq"]
    first, second = (F.struct(F.col(f"{side}_seq").alias("seq"), F.col(f"{side}_file").alias("file")) for side in ("first", "second"))

    def counted(place: int, a: Column, b: Column) -> Column:
        sides = {"a_seq": a["seq"], "a_file": a["file"], "b_seq": b["seq"], "b_file": b["file"]}
        return F.struct(*[c.alias(name) for name, c in sides.items()], F.lit(place).cast("byte").alias("place"))

    totals = ["first_entries", "second_entries", "repeated"]
    asked = F.array(counted(0, first, first), counted(1, second, second), counted(2, F.least(first, second), F.greatest(first, second)))
    sides = overlaps.select(*names, "overlap_from", "overlap_to", F.inline(asked)).repartition(parts, *shared)
    both = sides.join(days.repartition(parts, *shared).hint("merge"), shared)
    both = both.where(F.col("tx_date").between(F.col("overlap_from"), F.col("overlap_to")))
    # One row for each of the three, summed where they met, is shuffled by pair.
    sums = both.groupBy(*shared, *names).agg(*[F.sum(F.when(F.col("place") == n, F.col("n")).otherwise(0)).alias(c) for n, c in enumerate(totals)])
    return sums.select(*names, *totals).repartition(parts, *names).groupBy(*names).agg(*[F.sum(c).alias(c) for c in totals])
