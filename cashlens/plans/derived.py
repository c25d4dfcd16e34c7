"""Queries on what statements tell beyond their own rows: kept dictionaries, balances, reruns, payers, overlaps, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cashlens.functions import fixed
from cashlens.operators import (
    anchors,
    balances,
    diagnostics,
    dictionary,
    funding,
    layout,
    lines,
    metrics,
    overlaps,
    payers,
    positions,
    review,
    scorecard,
    skew,
    wash,
)
from cashlens.plans import extract, staging
from cashlens.plans.inputs import SHIFT, Inputs, words_in_one_pass
from cashlens.plans.queries import (
    answered_again,
    classified_ledger,
    found_positions,
    lender_payments,
    months_of,
    query,
    responses,
    statement_texts,
    unique_ledger,
)
from cashlens.sources import credit, dimensions, files, labels, sinks

#: The ledger grows after this day.
GROWN_AFTER = "2024-01-12"
LINE = ["application_id", "source_file", "line_no", "tx_type", "description", "amount"]


@query
def description_dictionary(i: Inputs) -> DataFrame:
    """Categories of the whole ledger from a stored dictionary that two runs filled: one when the ledger ended in
    January, one over all of it. `batch` tells which run's rules saw a description."""
    path = staging.new_path(i.spark, "dictionary")
    dictionary.learn_descriptions(i.ledger.where(F.col("tx_date") <= GROWN_AFTER), path, "january")
    dictionary.learn_descriptions(i.ledger, path, "whole")
    known = dictionary.known_descriptions(i.spark, path)
    named = dictionary.categories_from_dictionary(i.ledger, known).select(*LINE, "category")
    return named.join(known.select("description", "batch"), "description")


def ledger_balances(i: Inputs) -> DataFrame:
    openings = balances.opening_balances(anchors.opening_closing(statement_texts(i)))
    return balances.daily_balances(i.ledger, openings)


@query
def daily_balances(i: Inputs) -> DataFrame:
    return ledger_balances(i)


@query
def balance_facts(i: Inputs) -> DataFrame:
    return balances.balance_facts(ledger_balances(i))


def open_answers(i: Inputs) -> DataFrame:
    """Manual answers as given for some applications and left open for others, some given twice."""
    left_open = F.col("application_id") % 3 != 0
    given = i.application_inputs.withColumns(
        {c: F.when(~left_open, F.col(c)) for c in ("avg_daily_balance", "negative_days", "borrowing_velocity")}
    )
    return answered_again(given, negative_days=F.lit(99), fraud_suspected=F.lit(True))


@query
def score_from_ledger(i: Inputs) -> DataFrame:
    """Components of the score whose answers the ledger gives where they were left open."""
    entries = classified_ledger(i)
    answers = balances.answers_from_ledger(
        open_answers(i), balances.balance_facts(ledger_balances(i)), funding.funding_velocity(entries)
    )
    ready = scorecard.underwriting_inputs(
        metrics.metrics(entries, found_positions(i)), answers, i.credit_profile, dimensions.industries(i.spark)
    )
    components = scorecard.score_components(scorecard.hard_stops(ready)).drop("value")
    return components.where(F.col("component").isin("daily_balance", "negative_days", "funding_velocity"))


@query
def rerun_output(i: Inputs) -> DataFrame:
    """Monthly sums written by a run that had a third of the applications wrong, after those were run again.

    The first run gave them other sums, and a month that none of them has.
    """
    path = staging.new_path(i.spark, "output")
    right = months_of(i).select("application_id", "month", "deposits", "deposit_total")
    right = staging.stage(right, "months")
    again = F.col("application_id") % 3 == 1
    wrong = right.withColumn("deposits", F.when(again, F.col("deposits") + 1).otherwise(F.col("deposits")))
    invented = right.where(again).withColumn("month", F.lit("1999-12")).distinct()
    sinks.write_output(wrong.unionByName(invented), path, buckets=8)
    applications = i.application_inputs.where(again).select("application_id")
    sinks.rerun_output(right.where(again), path, applications, buckets=8)
    return i.spark.read.parquet(path).drop(sinks.BUCKET)


#: Payers as different banks print them.
SPELLINGS = """CASE line_no % 7 WHEN 0 THEN lower(payer_or_source) WHEN 1 THEN payer_or_source || ' ' || CAST(line_no AS STRING)
  WHEN 2 THEN replace(payer_or_source, 'E', '') WHEN 3 THEN replace(payer_or_source, 'PAY', 'PYA')
  WHEN 4 THEN replace(payer_or_source, ' ', '-') ELSE payer_or_source END"""


def spelt_ledger(i: Inputs) -> DataFrame:
    return classified_ledger(i).withColumn("payer_or_source", F.expr(SPELLINGS))


@query
def payer_variants(i: Inputs) -> DataFrame:
    return payers.payer_variants(spelt_ledger(i), staging.stage)


@query
def concentration_by_payer(i: Inputs) -> DataFrame:
    """Revenue concentration with the spellings of a payer taken together."""
    entries = spelt_ledger(i)
    return metrics.revenue_concentration(payers.with_one_name(entries, payers.payer_variants(entries, staging.stage)))


#: The files of an application, uploaded in turn; every second entry of the first is printed again in another.
UPLOADS = """SELECT application_id, source_file || '-' || CAST(line_no % 3 AS STRING) AS source_file, CAST(line_no % 3 AS INT) AS upload_seq, tx_date, amount, description, tx_type FROM ledger
UNION ALL SELECT application_id, 'reprint', 9, tx_date, amount, description, tx_type FROM ledger WHERE line_no % 6 = 0"""


def uploads(i: Inputs) -> DataFrame:
    i.ledger.createOrReplaceTempView("ledger")
    return i.spark.sql(UPLOADS)


@query
def statement_overlap(i: Inputs) -> DataFrame:
    return overlaps.statement_overlap(overlaps.file_spans(uploads(i)))


@query
def repeated_entries(i: Inputs) -> DataFrame:
    entries = staging.stage(uploads(i), "uploads")
    return overlaps.repeated_entries(entries, overlaps.statement_overlap(overlaps.file_spans(entries)))


@query
def funding_velocity(i: Inputs) -> DataFrame:
    return funding.funding_velocity(classified_ledger(i))


@query
def review_rollup(i: Inputs) -> DataFrame:
    return review.review_rollup(classified_ledger(i))


@query
def payment_runs(i: Inputs) -> DataFrame:
    """Payments in runs; applications differ in how far their payments are apart."""
    return positions.payment_runs(positions.lender_debit_dedup(lender_payments(i)), gap=RUN_GAP)


#: Shorter than the library's, as the test ledger spans half a year.
RUN_GAP = 21


@query
def wash_over_all_debits(i: Inputs) -> DataFrame:
    """The decision where round trips are looked for among all debits."""
    washes = wash.wash_flags(wash.wash_pairs(i.ledger))
    found = metrics.metrics(classified_ledger(i), found_positions(i), washes)
    ready = scorecard.underwriting_inputs(found, i.application_inputs, i.credit_profile, dimensions.industries(i.spark))
    return scorecard.hard_stops(ready).select("application_id", "wash_flag", "decision", "hard_stops")


# --- reports and edits over time, faults by field --------------------------------------

#: Three reports of an application over half a year, two of them on one day for some; one in five lacks a field.
DATED_REPORTS = """SELECT p.*, t.k AS seq, DATE '2024-01-01' + CAST((application_id * (t.k + 3)) % 90 + 30 * t.k AS INT) AS report_date, fico_score + 10 * t.k AS newer_score
FROM credit_profile p CROSS JOIN (VALUES (0), (1), (2)) AS t(k)"""


def dated_reports(i: Inputs) -> DataFrame:
    i.credit_profile.createOrReplaceTempView("credit_profile")
    reports = i.spark.sql(DATED_REPORTS).drop("fico_score").withColumnRenamed("newer_score", "fico_score")
    whole, partial = F.to_json(F.struct(*credit.FIELDS)), F.to_json(F.struct(*credit.FIELDS[1:]))
    response = F.when(F.col("application_id") % 5 == F.col("seq"), partial).otherwise(whole)
    return reports.select("application_id", "seq", "report_date", response.alias("response"))


@query
def profile_as_of(i: Inputs) -> DataFrame:
    return credit.profile_as_of(i.ledger_raw, dated_reports(i)).select(
        "application_id", "month", "report_date", "owner_name", "fico_score", "bankruptcies_found", "is_loaded"
    )


#: Edits of the positions of every second application: a new amount in February, removal or a new frequency later.
DATED_EDITS = """SELECT application_id, lender, DATE '2024-02-10' AS edit_date, '75.50' AS payment_amount, CAST(NULL AS STRING) AS frequency, CAST(NULL AS BOOLEAN) AS removed FROM found WHERE application_id % 2 = 0
UNION ALL SELECT application_id, lender, DATE '2024-02-29' + CAST(application_id % 40 AS INT), CAST(NULL AS STRING), 'Weekly', application_id % 3 = 0 FROM found WHERE application_id % 4 < 2"""


@query
def position_history(i: Inputs) -> DataFrame:
    # Read by the history and by both kinds of edits.
    found = staging.stage(found_positions(i), "positions")
    found.createOrReplaceTempView("found")
    return positions.position_history(found, i.ledger_raw, i.spark.sql(DATED_EDITS))


def faulty_reports(i: Inputs) -> DataFrame:
    """Credit profiles as JSON answers, each of eight kinds of fault in some applications."""
    fields = {name: F.col(name) for name in credit.FIELDS}

    def response(**other) -> Column:
        parts = {**fields, **other}
        return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items() if c is not None]), {"ignoreNullFields": "false"})

    whole, way = response(), F.col("application_id") % 9
    text = (
        F.when(way == 1, F.substring(whole, 1, 60))
        .when(way == 2, response(mortgage_ltv_details=None, owner_name=None))
        .when(way == 3, response(fico_score=F.lit("high")))
        .when(way == 4, response(total_high_credit=F.lit(None).cast("double")))
        .when(way == 5, response(bankruptcies_found=F.lit("yes"), number_of_mortgages=F.lit(1.5)))
        .when(way == 6, F.lit("[1, 2]"))
        .when(way == 7, F.lit(None).cast("string"))
        .otherwise(whole)
    )
    return i.credit_profile.select("application_id", text.alias("response"))


@query
def report_faults(i: Inputs) -> DataFrame:
    return credit.report_faults(faulty_reports(i))


def broken_responses(i: Inputs) -> DataFrame:
    """Label responses, for some applications cut short."""
    cut = F.when(F.col("application_id") % 4 == 0, F.lit('{"mappings": 3}')).otherwise(F.col("response"))
    return responses(i).withColumn("response", cut)


@query
def response_faults(i: Inputs) -> DataFrame:
    return labels.response_faults(broken_responses(i)).groupBy("application_id", "fault").agg(F.count("*").alias("answers"))


# --- layouts that carry, rows that can't be read ------------------------------------------

# Every third page prints no heading, every seventh file none at all; on every fourth page the heading comes after the
# sixth transaction line.
SPARSE_WORDS = """SELECT file_id, page_no, CASE WHEN top = 60 AND (file_id + page_no) % 4 = 1 THEN CAST(177 AS DOUBLE) ELSE top END AS top, x0, text FROM words
WHERE top <> 60 OR ((file_id + page_no) % 3 <> 1 AND file_id % 7 <> 0)"""


def placed_words(i: Inputs, sql: str, dealt: bool = False) -> DataFrame:
    """Words as the SQL changes them. A file's name and number stay the columns they are: as constants they would be folded
    out of the keys, and every branch would shuffle the words anew. `dealt` brings a page's words together before they get
    their numbers, while they are narrower."""
    found = i.spark.sql(sql.replace("file_id, ", "file_id, file_name, upload_seq, ", 1))
    if dealt:
        found = found.repartition(skew.spread_partitions(found), "file_id", "file_name", "upload_seq", "page_no")
    word_seq = (F.col("top") * 1000 + F.col("x0")).cast("int").alias("word_seq")
    return found.select(F.col("file_id").alias("application_id"), "file_name", "upload_seq", "page_no", word_seq, "x0", "top", "text")


def sparse_words(i: Inputs) -> DataFrame:
    i.words.createOrReplaceTempView("words")
    return placed_words(i, SPARSE_WORDS)


@query
def carried_bounds(i: Inputs) -> DataFrame:
    """Column bounds in force where pages lack a heading, print it late, or a file prints none."""
    bounds = ["desc_limit", "debit_min", "debit_max", "credit_min", "credit_max", "balance_x"]
    placed = extract.extract(sparse_words(i), i.statement_text).placed
    return placed.groupBy("application_id", "page_no", *bounds).agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )


@query
def late_balance_column(i: Inputs) -> DataFrame:
    """The balance column where its heading is not on the first line."""
    grouped = lines.line_grouping(lines.word_dedup(sparse_words(i)))
    found = layout.balance_x(F.col("words"), F.col("line_no"))
    bands = layout.calibration(F.col("words"), F.col("line"), F.col("next_line"))
    heads = grouped.select("application_id", "page_no", "line_no", found.alias("balance_x"), bands.alias("b"))
    return heads.where("balance_x is not null").select("application_id", "page_no", "line_no", "balance_x", "b.desc_limit", "b.credit_min")


#: Amounts that end in 7 are printed too large to read in some files; in others short months have a day 31.
TOO_LARGE = "9999999999999999999.99"
UNREADABLE_WORDS = f"""SELECT file_id, page_no, top, x0, CASE WHEN file_id % 5 = 0 AND x0 - {SHIFT.format("file_id")} IN (305, 395) AND text LIKE '%7' THEN '{TOO_LARGE}'
  WHEN file_id % 5 = 1 AND x0 - {SHIFT.format("file_id")} = 60 AND top > 60 AND EXISTS_SHORT THEN '31' ELSE text END AS text FROM words"""


def names_short_month(texts: list[Column]) -> Column:
    """Whether one of the texts is the name of a month without a day 31."""
    return reduce(lambda a, b: a | b, [F.coalesce(text.isin("Feb", "Apr", "Jun"), F.lit(False)) for text in texts])


@query
def unreadable_rows(i: Inputs) -> DataFrame:
    """Events on rows whose amount is too large for the ledger or whose date is none, one for each kind and message."""
    words_in_one_pass(i.ledger, short=names_short_month).createOrReplaceTempView("words")
    changed = placed_words(i, UNREADABLE_WORDS.replace("EXISTS_SHORT", "short"), dealt=True)
    # Both kinds of events read the rows: few are of either kind, and all the others are made once.
    faulty = extract.extract(changed, i.statement_text).rows.where(f"({diagnostics.UNREADABLE_AMOUNT}) or ({diagnostics.BAD_DATE})")
    found = staging.stage(faulty, "faulty_rows")
    events = diagnostics.union_events(diagnostics.unreadable_amounts(found), diagnostics.bad_dates(found))
    return events.groupBy("application_id", "code", "message").agg(F.count("*").alias("events"))


@query
def diagnostics_of_faults(i: Inputs) -> DataFrame:
    """Events that `diagnostics` has no rows for: no deposits, unreadable answers, fields of reports, overlapping files."""
    spans = overlaps.file_spans(uploads(i))
    return diagnostics.union_events(
        diagnostics.no_deposits(i.text_pages, i.ledger),
        diagnostics.unreadable("label", labels.unreadable_responses(broken_responses(i))),
        diagnostics.field_faults(credit.report_faults(faulty_reports(i))),
        diagnostics.overlapping_files(overlaps.statement_overlap(spans)),
    )


# --- files -----------------------------------------------------------------------------

#: Suppliers' statements as uploads of their nation; every third comes again under another name.
NOTES = """SELECT CAST(s_nationkey AS BIGINT) AS application_id, s_name AS file_name, CAST(s_suppkey AS INT) AS upload_seq, 'Statement of ' || s_name AS text FROM supplier
UNION ALL SELECT CAST(s_nationkey AS BIGINT), 'copy of ' || s_name || ' 100% = #1', CAST(s_suppkey + 1000000 AS INT), 'Statement of ' || s_name FROM supplier WHERE s_suppkey % 3 = 0"""


@query
def file_scan(i: Inputs) -> DataFrame:
    """Files written one by one, read back as bytes with their listed sizes, and deduplicated.

    They are written and read in batches, as a driver keeps account of every file of a job. What is known of each batch's
    files is appended to two tables, one row a file.
    """
    path, hashed, listed = (staging.new_path(i.spark, name) for name in ("uploads", "hashes", "sizes"))
    i.supplier.createOrReplaceTempView("supplier")
    for folder in files.write_batches(staging.stage(i.spark.sql(NOTES), "notes"), path):
        found = files.scan_files(i.spark, folder)
        files.file_hashes(found).write.mode("append").parquet(hashed)
        found.select("application_id", "file_name", "upload_seq", "bytes").write.mode("append").parquet(listed)
    unique = files.file_dedup(i.spark.read.parquet(hashed))
    # Written tables look small; no driver gathers the sizes of all files to hand them round.
    sizes = i.spark.read.parquet(listed).hint("merge")
    return unique.join(sizes, ["application_id", "file_name", "upload_seq"])
