"""Repeated, tied and unlisted keys on lookup sides; identity of uploads; staging."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cashlens.functions import rules
from cashlens.operators import classify, diagnostics, ledger, positions, review, scorecard
from cashlens.plans import staging
from cashlens.plans.extract import extract
from cashlens.plans.queries import REGISTRY
from cashlens.sources import credit, files, labels

DAY = date(2024, 1, 1)
ROW = "application_id bigint, tx_date date, amount decimal(18,2), description string, tx_type string"
CASH, B2B = "True Revenue - Verified Cash", "True Revenue - B2B E-Transfer"


def test_later_label_wins_and_unlisted_ones_count_not(spark):
    rows = spark.createDataFrame([(1, DAY, Decimal(n), "RENT", "credit") for n in range(3)], ROW)
    given = [("RENT", CASH, 1), ("RENT", B2B, 2), ("RENT", "made up", 3)]
    answered = spark.createDataFrame(given, "label_key string, category string, seq int")
    found = classify.apply_labels(classify.rule_categories(rows), answered).collect()
    assert len(found) == 3 and {r.category for r in found} == {B2B}
    # Without numbers, too, a repeated key leaves every row single, always with the same answer.
    plain = classify.apply_labels(classify.rule_categories(rows), answered.drop("seq")).collect()
    assert len(plain) == 3 and len({r.category for r in plain}) == 1


def test_later_edit_wins(spark):
    rows = spark.createDataFrame(
        [(1, DAY, Decimal(n), "RENT", "credit", "c", "p", False, True) for n in range(3)],
        ROW + ", category string, payer_or_source string, is_revenue boolean, needs_review boolean",
    )
    edits = [(1, DAY, Decimal(1), "RENT", "credit", value, seq) for value, seq in ((False, 1), (True, 2))]
    edited = review.row_override(rows, spark.createDataFrame(edits, ROW + ", is_revenue boolean, seq int"))
    assert sorted((int(r.amount), r.is_revenue) for r in edited.collect()) == [(0, False), (1, True), (2, False)]
    groups = spark.createDataFrame(
        [(1, "c", "p", False, 1), (1, "c", "p", True, 2)],
        "application_id bigint, category string, payer_or_source string, is_revenue boolean, seq int",
    )
    assert [r.is_revenue for r in review.group_override(rows, groups).collect()] == [True] * 3


def test_later_position_edit_wins(spark):
    found = spark.createDataFrame(
        [(1, "VAULT", "Premium", Decimal(10), "Weekly", 43.3)],
        "application_id bigint, lender string, tier string, payment_amount decimal(18,2), frequency string, monthly_payment double",
    )
    edits = spark.createDataFrame(
        [(1, "VAULT", None, "5", None, False, 1), (1, "VAULT", None, "NaN", None, False, 2), (1, "NEW", "Standard", "1", "Daily", False, 1)],
        "application_id bigint, lender string, tier string, payment_amount string, frequency string, removed boolean, seq int",
    )
    got = {r.lender: r.monthly_payment for r in positions.position_overrides(found, edits).collect()}
    assert got == {"VAULT": 0.0, "NEW": 21.0}
    text = spark.createDataFrame([("NaN",), ("nan",), ("x",), (None,), ("2",)], "a string").withColumn("f", F.lit("Monthly"))
    assert [r.m for r in text.select(rules.monthly_equivalent("a", "f").alias("m")).collect()] == [0, 0, 0, 0, 2]


def test_one_credit_profile_and_one_set_of_inputs(spark):
    whole = '{"owner_name":"%s","fico_score":700,"total_high_credit":1,"revolving_credit_utilization_pct":1,"active_collections_count":0,"total_collections_amount":0,"bankruptcies_found":false,"number_of_mortgages":0,"mortgage_ltv_details":"x"}'
    answers = [(1, whole % "old", 1), (1, whole % "new", 2), (1, "{cut", 3), (2, "{cut", 1)]
    reports = spark.createDataFrame(answers, "application_id bigint, response string, seq int")
    profiles = credit.credit_profile(reports)
    assert [(r.application_id, r.owner_name) for r in profiles.collect()] == [(1, "new")]
    assert {r.application_id: r.responses for r in credit.unreadable_reports(reports).collect()} == {1: 1, 2: 1}
    apps = spark.createDataFrame([(1,), (2,)], "application_id bigint")
    twice = profiles.unionByName(profiles)
    assert credit.with_credit_defaults(apps, twice).count() == 2
    assert scorecard.public_records_default(credit.with_credit_defaults(apps, twice)).count() == 2


def test_unreadable_and_missing_are_told(spark):
    responses = spark.createDataFrame([(1, 1, "{cut"), (2, 1, '{"mappings":[]}')], "application_id bigint, response_seq int, response string")
    told = diagnostics.unreadable("label", labels.unreadable_responses(responses)).collect()
    assert [(r.application_id, r.code) for r in told] == [(1, "unreadable_label_response")]
    pages = spark.createDataFrame([(1,), (1,), (2,), (3,)], "application_id bigint")
    entries = spark.createDataFrame([(1, "credit"), (2, "debit")], "application_id bigint, tx_type string")
    told = diagnostics.no_deposits(pages, entries).collect()
    assert sorted((r.application_id, r.code) for r in told) == [(2, "no_deposits"), (3, "no_deposits")]


def test_uploads_of_one_name(spark):
    rows = [(1, "a", 1, "x"), (1, "a", 2, "x"), (1, "a", 3, "y"), (1, "b", None, "x"), (1, "c", None, "x"), (1, "d", 4, "z"), (1, "e", 4, "z"), (1, "f", None, "q"), (1, "f", None, "q")]
    df = spark.createDataFrame(rows, "application_id bigint, file_name string, upload_seq int, sha256 string")
    got = {(r.file_name, r.upload_seq): r.duplicate_of for r in files.file_dedup(df).collect()}
    assert got == {("a", 1): None, ("a", 2): "a", ("a", 3): None, ("b", None): "a", ("c", None): "a", ("d", 4): None, ("e", 4): "d", ("f", None): None}
    pages = spark.createDataFrame([(1, "a", s, 1, f"text {s}") for s in (1, 2)], "application_id bigint, file_name string, upload_seq int, page_no int, text string")
    assert sorted(r.text for r in files.file_text(pages).collect()) == ["text 1", "text 2"]


def test_second_upload_of_a_name_is_extracted_apart(spark):
    schema = "application_id bigint, file_name string, upload_seq int, page_no int, word_seq int, x0 double, top double, text string"

    def statement(seq, amount):
        line = [(40.0, "Jan"), (60.0, "05"), (90.0, "RENT"), (395.0, amount)]
        return [(1, "stmt", seq, 1, k, x, 100.0, text) for k, (x, text) in enumerate(line)]

    words = spark.createDataFrame(statement(1, "10.00") + statement(2, "10.00") + statement(3, "20.00"), schema)
    pages = words.select("application_id", "file_name", "upload_seq", "page_no").distinct().withColumn("text", F.lit("2024"))
    uploads = [(1, "stmt", 1, "h1", None), (1, "stmt", 2, "h1", "stmt"), (1, "stmt", 3, "h3", None)]
    registry = spark.createDataFrame(uploads, "application_id bigint, file_name string, upload_seq int, sha256 string, duplicate_of string")
    found = extract(words, pages, registry, staged=False).rows.collect()
    assert sorted((r.upload_seq, float(r.credit)) for r in found) == [(1, 10.0), (3, 20.0)]
    with pytest.raises(ValueError, match="upload_seq"):
        extract(words, pages.drop("upload_seq"), registry, staged=False)


def test_survivor_does_not_depend_on_reading_order(spark):
    rows = [(1, DAY, Decimal(1), "RENT", "credit", name, 1, 1, 1) for name in "dbca"]
    df = spark.createDataFrame(rows, ROW + ", source_file string, upload_seq int, page_no int, line_no int")
    assert {ledger.ledger_dedup(df.repartition(n)).first().source_file for n in (1, 3)} == {"a"}


def test_building_queries_stages_nothing(spark):
    before = dict(staging._used)
    for name in ("statement_rows", "scorecard", "column_bounds", "diagnostics"):
        REGISTRY[name](spark, "/root/testdata/sf0.001")
    assert staging._used == before
