"""Operators against brute force in plain Python, with one huge key among small ones."""

import random
import re
import statistics
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cashlens.functions import fixed
from cashlens.operators import classify, ledger, metrics, positions, review, scorecard, skew, summary, wash
from cashlens.sources import dimensions, files, labels

ROW = (
    "application_id bigint, tx_date date, month string, description string, amount decimal(18,2), "
    "payer_or_source string, tx_type string, source_file string, upload_seq int, page_no int, line_no bigint"
)


def ledger_of(spark, rows):
    """rows: (application, date or None, description, amount, type)."""
    full = []
    for n, (app, day, text, amount, kind) in enumerate(rows):
        month = day and day.strftime("%Y-%m")
        full.append((app, day, month, text, Decimal(amount), text, kind, "f", 1, n // 40, n))
    return spark.createDataFrame(full, ROW)


def skewed_apps(rng, n, apps=20):
    """A third of all rows belong to application 0."""
    return [0 if rng.random() < 1 / 3 else rng.randint(1, apps) for _ in range(n)]


def test_exact_median(spark):
    rng = random.Random(1)
    rows = [(app, Decimal(rng.choice([rng.randint(1, 500), rng.randint(1, 10**9)])) / 100)
            for app in skewed_apps(rng, 4000, 60)]
    rows += [(99, Decimal("5.00"))] * 3 + [(98, None)]
    df = spark.createDataFrame(rows, "k int, v decimal(18,2)")
    got = {r.k: r.m for r in skew.exact_median(df, ["k"], "v", "m").collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert got[k] == pytest.approx(float(statistics.median(values)), abs=1e-9)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_carry_forward(spark, block):
    rng = random.Random(block)
    rows = [(k, p, rng.choice([None, None, p * 10 + k])) for k in range(3) for p in range(60 if k == 0 else 9)]
    got = skew.carry_forward(spark.createDataFrame(rows, "k int, p int, v int"), ["k"], "p", ["v"], block)
    want, last = {}, {}
    for k, p, v in rows:
        want[k, p] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    assert {(r.k, r.p): r.v_before for r in got.collect()} == want


def test_ledger_dedup_keeps_first_of_hot_copies(spark):
    day = date(2024, 1, 5)
    rows = [(1, day, "SAME", "5.00", "credit")] * 500 + [(1, None, "SAME", "5.00", "credit")] * 3
    rows += [(1, day, "SAME", "5.00", "debit"), (2, day, "SAME", "5.00", "credit")]
    df = ledger_of(spark, rows).repartition(7)
    kept = {(r.application_id, r.tx_date, r.tx_type): r.line_no for r in ledger.ledger_dedup(df).collect()}
    assert kept == {
        (1, day, "credit"): 0, (1, None, "credit"): 500, (1, day, "debit"): 503, (2, day, "credit"): 504
    }
    removed = {r.application_id: r.rows_removed for r in ledger.removed_duplicates(df).collect()}
    assert removed == {1: 501, 2: 0}


def test_wash_against_pairing(spark):
    rng = random.Random(5)
    refs = ["TF 1234#567-890", "TF1234#567-8901", "tf 999 # 888 # 777", "TF1234567-012", "RENT", "TF12-3", "TF1234567-0123"]
    rows = [(app, None, " ".join(rng.choices(refs, k=rng.randint(1, 2))), "1.00", rng.choice(["credit", "debit"]))
            for app in skewed_apps(rng, 600)]
    want = {}
    clean = lambda t: re.sub(r"[^A-Z0-9#\-]", "", t.upper())
    for app in {r[0] for r in rows}:
        sides = {s: [clean(r[2]) for r in rows if r[0] == app and r[4] == s] for s in ("credit", "debit")}
        first = {s: {m.group() for t in texts if (m := re.search(fixed.TRANSFER_REF_PATTERN, t))}
                 for s, texts in sides.items()}
        for ref in first["credit"] & first["debit"]:
            want[app, ref] = min(sum(ref in t for t in sides[s]) for s in sides)
    got = wash.wash_pairs(ledger_of(spark, rows)).collect()
    assert {(r.application_id, r.ref): r.round_trips for r in got} == want


def test_positions_against_pandas_rules(spark):
    rng = random.Random(9)
    start, rows = date(2024, 1, 1), []
    for app in skewed_apps(rng, 900, 6):
        lender = rng.choice(["A", "B", "C"])
        step = {"A": 1, "B": 6, "C": 40}[lender]
        day = start + timedelta(days=step * rng.randint(0, 20))
        rows.append((app, day, lender, "Premium", Decimal(rng.randint(1, 4)), "2024-01"))
    rows.append((1, None, "D", "Premium", Decimal(1), None))
    schema = "application_id bigint, tx_date date, lender string, tier string, payment_amount decimal(18,2), month string"
    got = positions.positions(spark.createDataFrame(rows, schema)).collect()
    groups = defaultdict(set)
    for app, day, lender, _, amount, _ in rows:
        if day:
            groups[app, lender].add((day, amount))
    assert len(got) == len(groups)
    for r in got:
        payments = sorted(groups[r.application_id, r.lender])
        counts = Counter(a for _, a in payments)
        assert r.payment_amount == min(a for a, n in counts.items() if n == max(counts.values()))
        days = [d for d, _ in payments]
        gaps = [(b - a).days for a, b in zip(days, days[1:])]
        frequency = "Monthly"
        if gaps:
            median = statistics.median(gaps)
            frequency = next((n for limit, n in fixed.FREQUENCY_BY_GAP if median <= limit), "Monthly")
        assert r.frequency == frequency


def classified(spark, rows):
    return classify.classify(ledger_of(spark, rows))


def test_classification_order(spark):
    day = date(2024, 1, 1)
    texts = {
        "NSF FEE TF 3978#1967-174": fixed.INTERNAL_TRANSFER, "GST NSF": fixed.GOVERNMENT, "NSF": fixed.REVERSAL,
        "VAULT": fixed.LOAN_PROCEEDS, "VAULT STRIPE": fixed.POS_REVENUE, "RENT": fixed.UNIDENTIFIED,
    }
    rows = {r.description: r for r in classified(spark, [(1, day, t, "1", "credit") for t in texts]).collect()}
    assert {t: r.category for t, r in rows.items()} == texts
    assert [t for t, r in rows.items() if r.is_revenue] == ["VAULT STRIPE"]
    assert [t for t, r in rows.items() if r.needs_review] == ["RENT"]


def test_label_responses_last_answer_wins(spark):
    text = (
        '{"mappings":[{"description":" rent ","category":"True Revenue - Verified Cash"},'
        '{"description":"RENT","category":"Non-Revenue - Shareholder / Investment"},'
        '{"description":"RENT","category":"made up"}]}'
    )
    rows = [(1, 1, text), (2, 1, "{broken"), (1, 0, text.replace("Shareholder / Investment", "x"))]
    got = labels.label_responses(spark.createDataFrame(rows, "application_id bigint, response_seq int, response string"))
    assert [tuple(r) for r in got.collect()] == [(1, "RENT", "Non-Revenue - Shareholder / Investment")]


def test_request_batches_hold_every_description(spark):
    rows = [(0, None, f"ITEM {n}", "1", "credit") for n in range(300)] + [(1, None, "ITEM", "2", "credit")]
    requests = labels.label_requests(ledger_of(spark, rows))
    batches = labels.label_request_batches(requests, 50).collect()
    assert sum(b.descriptions for b in batches) == 301
    assert len([b for b in batches if b.application_id == 0]) == 6
    assert sum(b.payload.count('"max_amount"') for b in batches) == 301


def test_file_dedup_and_text(spark):
    rows = [(1, "a", 1, b"x"), (1, "b", 2, b"y"), (1, "c", 3, b"x"), (2, "d", 4, b"x"), (1, "e", 5, b"x")]
    df = spark.createDataFrame(rows, "application_id bigint, file_name string, upload_seq int, content binary")
    got = {r.file_name: r.duplicate_of for r in files.file_dedup(files.file_hashes(df)).collect()}
    assert got == {"a": None, "b": None, "c": "a", "d": None, "e": "a"}
    pages = [(1, "a", 2, "two "), (1, "a", 1, " one"), (1, "a", 3, None), (1, "b", 1, " \n\t")]
    text = files.file_text(spark.createDataFrame(pages, "application_id bigint, file_name string, page_no int, text string"))
    assert [tuple(r) for r in text.collect()] == [(1, "a", 1, "one\ntwo")]


def test_overrides(spark):
    day = date(2024, 1, 1)
    rows = [(1, day, "RENT", str(n), "credit") for n in range(1, 5)] + [(1, None, "STRIPE", "9", "credit")]
    df = classified(spark, rows)
    edits = spark.createDataFrame(
        [(1, day, Decimal(1), "RENT", "credit", True), (1, None, Decimal(9), "STRIPE", "credit", False)],
        "application_id bigint, tx_date date, amount decimal(18,2), description string, tx_type string, is_revenue boolean",
    )
    edited = review.row_override(df, edits)
    state = {int(r.amount): (r.is_revenue, r.needs_review) for r in edited.collect()}
    assert state == {1: (True, True), 2: (False, True), 3: (False, True), 4: (False, True), 9: (False, False)}
    normal = review.group_mode_normalise(edited)
    assert {r.is_revenue for r in normal.collect()} == {False}
    groups = spark.createDataFrame([(1, fixed.UNIDENTIFIED, "RENT", True)], "application_id bigint, category string, payer_or_source string, is_revenue boolean")
    opened = review.group_override(edited, groups).where("description = 'RENT'").collect()
    assert {(r.is_revenue, r.needs_review) for r in opened} == {(True, False)}
    same = review.group_override(edited, groups.withColumn("is_revenue", F.lit(False)).where("false"))
    assert same.exceptAll(edited).count() == 0


def underwrite(spark, rows, inputs=(), mode="reference"):
    none = spark.createDataFrame([], "application_id bigint, tx_date date, lender string, tier string, payment_amount decimal(18,2), month string")
    given = spark.createDataFrame(
        list(inputs),
        "application_id bigint, months_in_business int, avg_daily_balance double, credit_score int, negative_days int, "
        "public_records string, borrowing_velocity string, bank_verification string, industry_rank int, "
        "fraud_suspected boolean, active_default boolean, wash_override boolean",
    )
    profile = spark.createDataFrame(
        [],
        "application_id bigint, owner_name string, fico_score int, total_high_credit double, "
        "revolving_credit_utilization_pct double, active_collections_count int, total_collections_amount double, "
        "bankruptcies_found boolean, number_of_mortgages int, mortgage_ltv_details string",
    )
    found = metrics.metrics(classified(spark, rows), positions.positions(none))
    table = scorecard.scorecard(found, given, profile, dimensions.industries(spark), mode)
    return {r.application_id: r for r in table.collect()}


def test_scorecard_edges(spark):
    day = date(2024, 1, 1)
    rows = [
        (1, day, "STRIPE", "200000", "credit"),  # one revenue month: volatility unknown
        (2, day, "NSF", "50", "debit"),  # no credit at all
        (3, None, "STRIPE", "90000", "credit"),  # revenue without a month
        (4, date(2024, 1, 1), "STRIPE", "100000", "credit"),
        (4, date(2024, 2, 1), "STRIPE", "125000", "credit"),
        (4, None, "RENT", "1", "credit"),
    ]
    blank = (None,) * 11
    got = underwrite(spark, rows, [(5, *blank)])
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1].revenue_volatility == 0.0 and got[1].avg_true_revenue == 200000
    assert got[2].gross_deposits == 0 and got[2].median_deposit == 0 and got[2].payment_performance == 1
    assert got[2].score is None and got[2].hard_stops == fixed.STOP_REVENUE
    assert got[3].avg_true_revenue == 0 and got[3].decision == "Decline"
    assert got[3].revenue_concentration == 100
    assert got[4].revenue_trend == 25 and got[4].avg_true_revenue == 112500
    assert got[5].coverage_ratio == 0 and got[5].industry.startswith("0191") and got[5].credit_score == 650
    # All defaults, no positions, one payer, nothing returned.
    assert got[4].score_reference == 0 + 6 + 10 + 5 + 4 + 6 + 4 + 4 + 1 + 4 + 4 + 3 + 0
    assert got[4].score_full == got[4].score_reference + 5 + 6 + 0 + 4
    assert got[4].grade == "E" and got[4].max_advance == 0 and got[4].remaining_capacity == 0
    assert underwrite(spark, rows, mode="full")[4].grade == "C"  # 66 points
    with pytest.raises(ValueError):
        underwrite(spark, rows, mode="other")


def test_single_revenue_month_beside_another_month_scores_no_volatility(spark):
    rows = [(1, date(2024, 1, 1), "STRIPE", "200000", "credit"), (1, date(2024, 2, 1), "RENT", "5", "credit")]
    card = underwrite(spark, rows)[1]
    assert card.revenue_volatility is None
    assert card.score_full == card.score_reference + 6 + 4 + 0 + 0


def test_summary_invariants_and_repartitioning(spark):
    rng = random.Random(3)
    texts = ["STRIPE", "RENT", "VAULT", "NSF", "GST"]
    rows = [(app, date(2024, rng.randint(1, 6), 1), rng.choice(texts), str(rng.randint(1, 999)), rng.choice(["credit", "debit"]))
            for app in skewed_apps(rng, 500)]
    df = classified(spark, rows)
    months = summary.ledger_months(df).collect()
    assert sum(m.deposits for m in months) == sum(r[4] == "credit" for r in rows)
    groups = review.category_payer_summary(df).collect()
    assert sum(g.total for g in groups) == sum(Decimal(r[3]) for r in rows)
    again = summary.ledger_months(df.repartition(13, "amount")).collect()
    assert sorted(map(str, months)) == sorted(map(str, again))
    cards = underwrite(spark, rows)
    assert all(c.score is None or 0 <= c.score_reference <= 71 and 0 <= c.score_full <= 93 for c in cards.values())
    assert all((c.remaining_capacity or 0) >= 0 for c in cards.values())
