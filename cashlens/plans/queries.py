"""One query per operator, over the whole input tables of a scale directory."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cashlens.functions import dates, fixed, money, rules
from cashlens.functions.text import label_key
from cashlens.operators import (
    anchors,
    classify,
    diagnostics,
    layout,
    ledger,
    lines,
    metrics,
    positions,
    review,
    rows,
    scorecard,
    summary,
    wash,
)
from cashlens.operators.settle import settle
from cashlens.plans import extract, staging
from cashlens.plans.inputs import Inputs
from cashlens.sources import credit, dimensions, files, labels, sinks, words

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types that any engine can compare: long, double to 6 places, string, boolean.

    Doubles are rounded to 9 places first, as decimals: a value that ends in 5 at the seventh place then rounds alike
    whatever its last bit.
    """

    def simple(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DecimalType, T.DoubleType)):
            column = F.round(column.cast("double").try_cast("decimal(38,9)"), 6).cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("long")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        return column.alias(field.name)

    return df.select(*[simple(field) for field in df.schema.fields])


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    # `x_table` is the query `x` where a module already has that name.
    name = build.__name__.removesuffix("_table")
    REGISTRY[name] = lambda spark, sf_dir: plain(build(Inputs(spark, sf_dir)))
    return build


# --- shared steps ---------------------------------------------------------------


def unique_ledger(i: Inputs) -> DataFrame:
    return ledger.ledger_dedup(i.ledger_raw)


def answered_again(df: DataFrame, **earlier: Column) -> DataFrame:
    """`df` as the later of two answers per key; the earlier one has other values."""
    first = df.withColumns(earlier).withColumn("seq", F.lit(0))
    return first.unionByName(df.withColumn("seq", F.lit(1)))


def labels_of(i: Inputs) -> DataFrame:
    given = i.label_mappings.select(label_key(F.col("description")).alias("label_key"), "category")
    again = answered_again(given, category=F.lit(fixed.POS_REVENUE))
    unlisted = given.select("label_key", F.lit("Invented Category").alias("category"), F.lit(2).alias("seq"))
    return again.unionByName(unlisted)


def classified_ledger(i: Inputs) -> DataFrame:
    return classify.classify(unique_ledger(i), labels_of(i))


def lender_payments(i: Inputs) -> DataFrame:
    debits = i.ledger.where("tx_type = 'debit'")
    return positions.lender_debits(debits.withColumn("month", F.date_format("tx_date", "yyyy-MM")))


def found_positions(i: Inputs) -> DataFrame:
    return positions.positions(lender_payments(i))


def all_metrics(i: Inputs) -> DataFrame:
    # Metrics read the ledger four times.
    return metrics.metrics(staging.stage(classified_ledger(i), "ledger"), found_positions(i))


def all_inputs(i: Inputs) -> DataFrame:
    return scorecard.hard_stops(
        scorecard.underwriting_inputs(
            all_metrics(i), i.application_inputs, i.credit_profile, dimensions.industries(i.spark)
        )
    )


def months_of(i: Inputs) -> DataFrame:
    return summary.ledger_months(classified_ledger(i))


def totals_of(i: Inputs) -> DataFrame:
    return metrics.application_totals(months_of(i))


def statement_texts(i: Inputs) -> DataFrame:
    return files.file_text(i.statement_text)


def grouped_lines(i: Inputs) -> DataFrame:
    return lines.line_grouping(lines.word_dedup(i.statement_words))


def extracted(i: Inputs) -> extract.Extraction:
    return extract.extract(i.statement_words, i.statement_text)


def reports(i: Inputs) -> DataFrame:
    """Credit profiles as JSON responses, some cut short, some without a required field."""
    profile = i.credit_profile
    whole = F.to_json(F.struct(*credit.FIELDS))
    partial = F.to_json(F.struct(*credit.FIELDS[:-1]))
    seventh = F.col("application_id") % 7
    response = (
        F.when(seventh == 3, F.substring(whole, 1, 60)).when(seventh == 5, partial).otherwise(whole)
    )
    current = profile.select("application_id", response.alias("response"), F.lit(1).alias("seq"))
    older = F.to_json(F.struct(*[F.lit("Old Owner").alias(c) if c == "owner_name" else c for c in credit.FIELDS]))
    # Some applications have an older report, too.
    earlier = profile.where("application_id % 7 in (0, 1, 2)").select(
        "application_id", older.alias("response"), F.lit(0).alias("seq")
    )
    return current.unionByName(earlier)


def responses(i: Inputs) -> DataFrame:
    """Label responses per application: one pair of answers per requested description.

    The second answer replaces the first; a category outside the list counts as no answer.
    """
    requests = labels.label_requests(unique_ledger(i))
    size = F.length("description")

    def answer(category: Column, text: Column) -> Column:
        return F.struct(text.alias("description"), category.alias("category"))

    first = answer(F.lit("True Revenue - B2B E-Transfer"), F.col("description"))
    second = answer(
        F.when(size % 3 == 0, "Invented Category").otherwise("True Revenue - Verified Cash"),
        F.concat(F.lit(" "), F.lower("description")),
    )
    pairs = F.flatten(F.collect_list(F.array(first, second)))
    return requests.groupBy("application_id").agg(
        F.lit(1).alias("response_seq"), F.to_json(F.struct(pairs.alias("mappings"))).alias("response")
    )


# --- sources --------------------------------------------------------------------


@query
def file_dedup(i: Inputs) -> DataFrame:
    content = i.statement_files.withColumn("content", F.col("text").cast("binary"))
    return files.file_dedup(files.file_hashes(content))


@query
def file_text(i: Inputs) -> DataFrame:
    return files.file_text(i.text_pages)


@query
def words_scan(i: Inputs) -> DataFrame:
    pages = i.statement_text.select("application_id", "file_name", "upload_seq", "page_no")
    return words.pages_without_words(pages, i.statement_words)


@query
def credit_profile(i: Inputs) -> DataFrame:
    everyone = i.application_inputs.select("application_id")
    return credit.with_credit_defaults(everyone, credit.credit_profile(reports(i)))


@query
def label_requests(i: Inputs) -> DataFrame:
    return labels.label_requests(unique_ledger(i))


@query
def label_request_batches(i: Inputs) -> DataFrame:
    requests = labels.label_requests(unique_ledger(i))
    return labels.label_request_batches(requests, batch_size=3).drop("payload")


@query
def label_responses(i: Inputs) -> DataFrame:
    return labels.label_responses(responses(i))


@query
def industry_lookup(i: Inputs) -> DataFrame:
    industries = F.broadcast(dimensions.industries(i.spark))
    return i.application_inputs.join(industries, F.col("industry_rank") == F.col("rank")).select(
        "application_id", "industry", "points", "seasonality"
    )


@query
def lender_variant_match(i: Inputs) -> DataFrame:
    """Ledger rows per lender name variant: each variant is one literal pattern, compiled once."""
    by_text = i.ledger.groupBy("description").agg(F.count("*").alias("n"))
    by_text = settle(by_text, {"upper": F.upper("description")})
    named = F.array_compact(
        F.array(
            *[
                F.when(F.col("upper").rlike(rf"\b{re.escape(variant)}\b"), F.lit(variant))
                for _, _, variants in dimensions.lender_list()
                for variant in variants
            ]
        )
    )
    counted = by_text.select(F.explode(named).alias("variant"), "n").groupBy("variant")
    lenders = F.broadcast(dimensions.lenders(i.spark))
    return counted.agg(F.sum("n").alias("ledger_rows")).join(lenders, "variant")


# --- statement extraction ---------------------------------------------------------


@query
def word_dedup(i: Inputs) -> DataFrame:
    return lines.word_dedup(i.printed_twice)


@query
def line_grouping(i: Inputs) -> DataFrame:
    return grouped_lines(i).select(
        "application_id", "file_name", "page_no", "line_no", "line", F.size("words").alias("words")
    )


@query
def line_lookahead(i: Inputs) -> DataFrame:
    return grouped_lines(i).select("application_id", "file_name", "page_no", "line_no", "next_line")


@query
def balance_column(i: Inputs) -> DataFrame:
    found = layout.balance_x(F.col("words"), F.col("line_no"))
    return (
        grouped_lines(i)
        .select("application_id", "file_name", "page_no", "line_no", found.alias("balance_x"))
        .where("balance_x is not null")
    )


@query
def column_calibration(i: Inputs) -> DataFrame:
    bands = layout.calibration(F.col("words"), F.col("line"), F.col("next_line"))
    return (
        grouped_lines(i)
        .select("application_id", "file_name", "page_no", "line_no", bands.alias("b"))
        .where("b is not null")
        .select("application_id", "file_name", "page_no", "line_no", "b.*")
    )


@query
def column_bounds(i: Inputs) -> DataFrame:
    """Column bounds in force on each page (carried state and credit upper bound)."""
    bounds = ["desc_limit", "debit_min", "debit_max", "credit_min", "credit_max", "balance_x"]
    # Before a page's own heading the bounds of the pages before it apply.
    return (
        extracted(i)
        .placed.groupBy("application_id", "file_name", "page_no", *bounds)
        .agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    )


@query
def noise_lines(i: Inputs) -> DataFrame:
    return i.printed_lines.select(
        "application_id", "source_file", "line_no", layout.is_noise(F.col("line")).alias("noise")
    )


def dated_lines(i: Inputs) -> DataFrame:
    """Lines that print the ledger date in one of the known ways."""
    day, month, year = (F.date_format("tx_date", f) for f in ("d", "MMM", "yyyy"))
    text = F.col("description")
    way = F.col("line_no") % 7
    line = (
        F.when(way == 0, F.concat_ws(" ", F.lpad(day, 2, "0"), month, year, text))
        .when(way == 1, F.concat_ws(" ", day, F.upper(month), text))
        .when(way == 2, F.concat_ws(" ", text, month, day))
        .when(way == 3, F.concat_ws(" ", day, F.lower(month), F.substring(year, 3, 2), text))
        .when(way == 4, F.concat_ws(" ", day, month, F.lit("150.00")))
        .when(way == 5, F.concat_ws(" ", F.date_format("tx_date", "MM | dd"), text))
        .otherwise(text)
    )
    return i.ledger.select("application_id", "line_no", line.alias("line"))


@query
def parse_date(i: Inputs) -> DataFrame:
    found = dates.line_date(F.col("line"))
    text = dates.date_text(F.col("d"), F.lit("2021"))
    return (
        settle(dated_lines(i), {"d": found})
        .where("d is not null")
        .select("application_id", "line_no", text.alias("date_text"), dates.month_text(text).alias("month"))
        .withColumn("tx_date", dates.calendar_date(F.col("date_text")))
    )


@query
def numeric_date(i: Inputs) -> DataFrame:
    return (
        dated_lines(i)
        .withColumn("d", dates.numeric_line_date(F.col("line")))
        .where("d is not null")
        .select("application_id", "line_no", dates.date_text(F.col("d"), F.lit("2021")).alias("date_text"))
    )


@query
def statement_year(i: Inputs) -> DataFrame:
    year = dates.statement_year(F.col("text"))
    return i.statement_files.select("file_name", year.alias("year")).unionByName(
        statement_texts(i).select(
            F.concat(F.lit("statement-"), F.col("application_id")).alias("file_name"),
            year.alias("year"),
        )
    )


@query
def active_date(i: Inputs) -> DataFrame:
    """Dates carried to the lines that print none, per file and date."""
    return (
        extracted(i)
        .placed.groupBy("application_id", "file_name", "date_text")
        .agg(F.count("*").alias("line_count"), F.count_if("is_date_row").alias("date_rows"))
    )


@query
def row_gate(i: Inputs) -> DataFrame:
    return (
        rows.row_gate(extracted(i).placed)
        .groupBy("application_id", "file_name", "page_no")
        .agg(F.count("*").alias("line_count"))
    )


@query
def band_split(i: Inputs) -> DataFrame:
    return rows.band_split(rows.row_gate(extracted(i).placed)).select(
        "application_id",
        "page_no",
        "line_no",
        F.array_join("desc_words", " ").alias("description"),
        F.array_join("debit_words", " ").alias("debit"),
        F.array_join("credit_words", " ").alias("credit"),
    )


def printed_money(i: Inputs) -> DataFrame:
    """Ledger amounts printed in many ways."""
    amount = F.col("amount")
    comma = F.format_number("amount", 2)
    swapped = F.translate(comma, ",.", ".,")
    way = (F.col("line_no") + F.col("application_id")) % 9
    text = (
        F.when(way == 0, F.concat(F.lit("$ "), comma))
        .when(way == 1, F.concat(F.lit("("), comma, F.lit(")")))
        .when(way == 2, swapped)
        .when(way == 3, F.translate(amount.cast("string"), ".", ","))
        .when(way == 4, F.concat(F.lit("-"), amount.cast("string")))
        .when(way == 5, F.format_number(F.floor("amount"), 0))
        .when(way == 6, F.concat(F.lit("1,"), F.floor("amount"), F.lit(",56")))
        .when(way == 7, F.concat(F.lit("CAD"), comma))
        .otherwise(F.concat(F.lit("  "), amount.cast("string"), F.lit(" ")))
    )
    return i.ledger.select("application_id", "line_no", "tx_type", text.alias("printed"))


@query
def parse_money(i: Inputs) -> DataFrame:
    return printed_money(i).withColumn("value", money.parse_money(F.col("printed"))).drop("printed")


@query
def money_from_words(i: Inputs) -> DataFrame:
    parts = F.split("printed", " ")
    value = money.to_amount(money.money_from_words(parts))
    return printed_money(i).withColumn("value", value).drop("printed")


@query
def summary_rows(i: Inputs) -> DataFrame:
    count = F.size(F.split("line", " "))
    found = rows.is_summary(F.col("line"), count).alias("is_summary")
    return i.printed_lines.select("application_id", "source_file", "line_no", found)


@query
def statement_rows(i: Inputs) -> DataFrame:
    return extracted(i).rows.select(
        "application_id", "date_text", "tx_date", "month", "description", "debit", "credit"
    )


@query
def credit_rows(i: Inputs) -> DataFrame:
    return rows.credit_rows(extracted(i).rows).select(
        "application_id", "date_text", "month", "description", "amount", "payer_or_source", "tx_type"
    )


@query
def nsf_debit_rows(i: Inputs) -> DataFrame:
    return rows.nsf_debit_rows(extracted(i).rows).select(
        "application_id", "date_text", "month", "description", "amount", "payer_or_source", "tx_type"
    )


@query
def lender_debits(i: Inputs) -> DataFrame:
    return lender_payments(i)


@query
def extracted_lender_debits(i: Inputs) -> DataFrame:
    return rows.lender_debits(extracted(i).rows).select(
        "application_id", "lender", "tier", "payment_amount", "month"
    )


@query
def file_debit_total(i: Inputs) -> DataFrame:
    return rows.file_debit_total(extracted(i).rows)


# --- anchors -----------------------------------------------------------------------


@query
def anchor_total(i: Inputs) -> DataFrame:
    return anchors.anchor_total(statement_texts(i))


@query
def opening_closing(i: Inputs) -> DataFrame:
    return anchors.opening_closing(statement_texts(i))


def used_anchors(i: Inputs) -> DataFrame:
    debits = i.ledger.where("tx_type = 'debit'").select(
        "application_id",
        F.lit("stmt").alias("file_name"),
        F.lit(1).alias("upload_seq"),
        F.col("amount").alias("debit"),
    )
    return anchors.implied_anchor(
        anchors.file_anchors(statement_texts(i)), rows.file_debit_total(debits)
    )


@query
def implied_anchor(i: Inputs) -> DataFrame:
    return used_anchors(i).select(
        "application_id", "file_name", "implied_total", "used_method", "used_total"
    )


@query
def expected_credits(i: Inputs) -> DataFrame:
    return anchors.expected_credits(used_anchors(i), statement_texts(i)).drop("anchor_warning")


@query
def anchor_coverage(i: Inputs) -> DataFrame:
    return anchors.expected_credits(used_anchors(i), statement_texts(i)).select(
        "application_id", "anchors", "files", "anchor_warning"
    )


# --- ledger, classification, wash -----------------------------------------------------


@query
def ledger_dedup(i: Inputs) -> DataFrame:
    return unique_ledger(i)


@query
def removed_duplicates(i: Inputs) -> DataFrame:
    return ledger.removed_duplicates(i.ledger_raw)


@query
def matches_any(i: Inputs) -> DataFrame:
    upper = F.upper("description")
    return i.ledger.groupBy("description").agg(
        F.count("*").alias("ledger_rows"),
        F.bool_or(rules.is_internal_transfer(upper)).alias("internal_transfer"),
        F.bool_or(rules.is_government(upper)).alias("government"),
        F.bool_or(rules.is_nsf(upper)).alias("nsf"),
        F.bool_or(rules.names_lender(upper)).alias("lender"),
    )


@query
def rule_category(i: Inputs) -> DataFrame:
    return classify.rule_categories(i.ledger).select(
        "application_id", "line_no", "tx_type", "description", "category"
    )


@query
def apply_labels(i: Inputs) -> DataFrame:
    return classify.apply_labels(classify.rule_categories(unique_ledger(i)), labels_of(i)).select(
        "application_id", "line_no", "tx_type", "description", "category"
    )


@query
def response_labels(i: Inputs) -> DataFrame:
    """Labels taken from the application's own JSON responses."""
    given = labels.label_responses(responses(i))
    labelled = classify.apply_labels(classify.rule_categories(unique_ledger(i)), given)
    return labelled.groupBy("application_id", "category").agg(F.count("*").alias("ledger_rows"))


@query
def revenue_flags(i: Inputs) -> DataFrame:
    labelled = classify.apply_labels(classify.rule_categories(unique_ledger(i)), labels_of(i))
    return classify.revenue_flags(labelled).select(
        "application_id", "line_no", "tx_type", "category", "is_revenue", "needs_review"
    )


@query
def pos_override(i: Inputs) -> DataFrame:
    return classified_ledger(i)


@query
def wash_refs(i: Inputs) -> DataFrame:
    return wash.wash_refs(i.ledger)


@query
def wash_pairs(i: Inputs) -> DataFrame:
    return wash.wash_pairs(classified_ledger(i))


@query
def wash_pairs_all_debits(i: Inputs) -> DataFrame:
    return wash.wash_flags(wash.wash_pairs(i.ledger))


@query
def wash_category(i: Inputs) -> DataFrame:
    relabelled = F.when(
        F.col("description") == "MISC CREDIT", "Non-Revenue - Wash / Round-Trip Transfer"
    ).otherwise(F.col("category"))
    return wash.wash_category_counts(classified_ledger(i).withColumn("category", relabelled))


# --- positions ----------------------------------------------------------------------


@query
def lender_debit_dedup(i: Inputs) -> DataFrame:
    return positions.lender_debit_dedup(lender_payments(i))


@query
def payment_gap(i: Inputs) -> DataFrame:
    return positions.payment_gaps(positions.lender_debit_dedup(lender_payments(i)))


@query
def payment_amount(i: Inputs) -> DataFrame:
    return positions.usual_payment(positions.lender_debit_dedup(lender_payments(i)))


@query
def frequency(i: Inputs) -> DataFrame:
    return found_positions(i).select("application_id", "lender", "frequency")


@query
def monthly_equiv(i: Inputs) -> DataFrame:
    """Monthly equivalent of edited amounts, some of which are no numbers."""
    text = "CASE application_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' ELSE CAST(payment_amount AS STRING) END"
    return found_positions(i).select(
        "application_id", "lender", rules.monthly_equivalent(text, "frequency").alias("monthly_payment")
    )


@query
def positions_table(i: Inputs) -> DataFrame:
    return found_positions(i)


@query
def position_overrides(i: Inputs) -> DataFrame:
    return positions.position_overrides(found_positions(i), position_edits(i))


def position_edits(i: Inputs) -> DataFrame:
    """Per application: change one lender, drop another, add a third."""
    app = F.col("application_id")

    def edit(lender, tier, amount, frequency, removed):
        values = [lender, tier, amount, frequency, removed]
        names = ["lender", "tier", "payment_amount", "frequency", "removed"]
        kinds = ["string", "string", "string", "string", "boolean"]
        return F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(values, names, kinds)])

    edits = F.array_compact(
        F.array(
            F.when(app % 2 == 0, edit("GREENBOX", None, "75.50", "Weekly", False)),
            F.when(app % 3 == 0, edit("MERCHANT GROWTH", None, None, None, True)),
            F.when(app % 4 == 0, edit("NEW LENDER", "Standard", "10", "Daily", None)),
        )
    )
    edited = i.application_inputs.select("application_id", F.inline(edits))
    return answered_again(edited, removed=F.lit(True), payment_amount=F.lit("1"))


# --- reconciliation and review --------------------------------------------------------


@query
def reconcile(i: Inputs) -> DataFrame:
    return review.reconcile(i.ledger, i.anchors)


@query
def filter_options(i: Inputs) -> DataFrame:
    return review.filter_options(classified_ledger(i))


@query
def ledger_filter(i: Inputs) -> DataFrame:
    return review.ledger_filter(
        classified_ledger(i), "2024-03", "Non-Revenue - Refund / Reversal / NSF"
    )


def row_edits(i: Inputs) -> DataFrame:
    """Turn some deposits over: the first ones of a day by amount."""
    edits = unique_ledger(i).where("line_no % 11 = 0").select(
        *ledger.LEDGER_KEY,
        F.when(F.col("line_no") % 33 != 0, F.col("line_no") % 2 == 0).alias("is_revenue"),
    )
    return answered_again(edits, is_revenue=~F.coalesce("is_revenue", F.lit(False)))


@query
def row_override(i: Inputs) -> DataFrame:
    return review.row_override(classified_ledger(i), row_edits(i))


@query
def group_override(i: Inputs) -> DataFrame:
    groups = (
        classified_ledger(i)
        .select(*review.GROUP)
        .distinct()
        .select(*review.GROUP, (F.col("application_id") % 2 == 0).alias("is_revenue"))
        .where("application_id % 3 <> 0")
    )
    return review.group_override(
        classified_ledger(i), answered_again(groups, is_revenue=~F.col("is_revenue"))
    )


@query
def group_mode_normalise(i: Inputs) -> DataFrame:
    return review.group_mode_normalise(review.row_override(classified_ledger(i), row_edits(i)))


@query
def category_payer_summary(i: Inputs) -> DataFrame:
    return review.category_payer_summary(review.row_override(classified_ledger(i), row_edits(i)))


@query
def review_kpis(i: Inputs) -> DataFrame:
    return review.review_kpis(classified_ledger(i))


# --- bank summary ----------------------------------------------------------------------


@query
def monthly_summary(i: Inputs) -> DataFrame:
    return summary.monthly_summary(months_of(i), found_positions(i))


@query
def loan_columns(i: Inputs) -> DataFrame:
    return positions.position_totals(found_positions(i))


@query
def written_output(i: Inputs) -> DataFrame:
    """Monthly sums of the ledger, written as an output table and read back."""
    path = staging.new_path(i.spark, "output")
    sinks.write_output(months_of(i), path, buckets=4)
    return i.spark.read.parquet(path).select("application_id", "month", "deposits", "deposit_total")


# --- metrics, score, offer ------------------------------------------------------------------


@query
def deposit_stats(i: Inputs) -> DataFrame:
    return metrics.deposit_stats(totals_of(i), metrics.deposit_median(classified_ledger(i)))


@query
def revenue_series(i: Inputs) -> DataFrame:
    return totals_of(i).select(
        "application_id", "revenue_months", "avg_true_revenue", "deposit_count"
    )


@query
def revenue_volatility(i: Inputs) -> DataFrame:
    return totals_of(i).select("application_id", "revenue_volatility")


@query
def revenue_trend(i: Inputs) -> DataFrame:
    return totals_of(i).select("application_id", "revenue_trend")


@query
def revenue_concentration(i: Inputs) -> DataFrame:
    return metrics.revenue_concentration(classified_ledger(i))


@query
def advance_burden(i: Inputs) -> DataFrame:
    average = totals_of(i).select("application_id", "avg_true_revenue")
    return metrics.advance_burden(average, found_positions(i)).drop("avg_true_revenue")


@query
def payment_performance(i: Inputs) -> DataFrame:
    return totals_of(i).select("application_id", "payment_performance")


@query
def public_records_default(i: Inputs) -> DataFrame:
    everyone = i.application_inputs.select("application_id")
    return scorecard.public_records_default(credit.with_credit_defaults(everyone, i.credit_profile))


@query
def hard_stops(i: Inputs) -> DataFrame:
    return all_inputs(i).select("application_id", "decision", "hard_stops")


@query
def score_components(i: Inputs) -> DataFrame:
    return scorecard.score_components(all_inputs(i)).drop("value")


@query
def score(i: Inputs) -> DataFrame:
    return scorecard.score(all_inputs(i)).select("application_id", "score_reference", "score_full", "score")


@query
def grade(i: Inputs) -> DataFrame:
    return scorecard.grade(scorecard.score(all_inputs(i), "full")).select(
        "application_id", "score", "grade", "risk_tier", "advance_share", "max_burden_share"
    )


@query
def offer(i: Inputs) -> DataFrame:
    return scorecard.offer(scorecard.grade(scorecard.score(all_inputs(i), "full"))).select(
        "application_id", "max_advance", "remaining_capacity", "daily_payment"
    )


SCORECARD_COLUMNS = [
    "application_id",
    "gross_deposits",
    "median_deposit",
    "largest_deposit",
    "avg_true_revenue",
    "deposit_count",
    "revenue_volatility",
    "revenue_trend",
    "revenue_concentration",
    "position_count",
    "burden_pct",
    "coverage_ratio",
    "payment_performance",
    "wash_flag",
    "credit_score",
    "public_records",
    "industry",
    "decision",
    "hard_stops",
    "score_reference",
    "score_full",
    "grade",
    "risk_tier",
    "max_advance",
    "remaining_capacity",
    "daily_payment",
]


@query
def scorecard_table(i: Inputs) -> DataFrame:
    """The flagship: one row per application with metrics, stops, score, grade and offer."""
    return scorecard.offer(scorecard.grade(scorecard.score(all_inputs(i)))).select(*SCORECARD_COLUMNS)


@query
def diagnostics_table(i: Inputs) -> DataFrame:
    """Events of all steps but those on unreadable amounts and dates, which printed statements don't hold."""
    texts = statement_texts(i)
    content = i.statement_files.withColumn("content", F.col("text").cast("binary"))
    return diagnostics.union_events(
        diagnostics.duplicate_files(files.file_dedup(files.file_hashes(content))),
        diagnostics.anchor_events(used_anchors(i)),
        diagnostics.removed_rows(ledger.removed_duplicates(i.ledger_raw)),
        diagnostics.wash_events(wash.wash_flags(wash.wash_pairs(classified_ledger(i)))),
        diagnostics.files_without_text(i.text_pages, files.file_text(i.text_pages)),
        diagnostics.files_without_text(i.statement_text, texts),
        diagnostics.no_deposits(i.statement_text, i.ledger),
        diagnostics.unreadable("credit", credit.unreadable_reports(reports(i))),
        diagnostics.pages_without_words(words.pages_without_words(i.statement_text, i.statement_words)),
        diagnostics.calibrations(layout.line_states(grouped_lines(i))),
    )
