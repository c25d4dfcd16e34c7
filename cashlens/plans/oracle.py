"""The queries as plain SQL for another engine, to compare results with."""

from __future__ import annotations

import re

from cashlens.functions import fixed
from cashlens.plans.inputs import LINES, SHIFT, VIEWS
from cashlens.sources.dimensions import INDUSTRIES, lender_list


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(patterns: list[str]) -> str:
    return _text("|".join(patterns))


def _case(column: str, steps: list[tuple], compare: str, other: str = "0") -> str:
    whens = " ".join(f"WHEN {column} {compare} {bound} THEN {points}" for bound, points in steps)
    return f"CASE {whens} ELSE {other} END"


def _number(expression: str, name: str) -> str:
    return f"CAST(round(CAST(CAST({expression} AS DOUBLE) AS DECIMAL(38,9)), 6) AS DOUBLE) AS {name}"


def _long(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


_lenders = [(v, name, tier) for name, tier, variants in lender_list() for v in variants]
_lender_values = ", ".join(
    f"({_text(v)}, {_text(n)}, {_text(t)}, {rank})" for rank, (v, n, t) in enumerate(_lenders, 1)
)
_industry_values = ", ".join(
    f"({rank}, {_text(name)}, {points}, {season})"
    for rank, (name, points, season) in enumerate(INDUSTRIES, 1)
)
_variant_matches = r"regexp_matches(upper(description), '\b' || regexp_escape(variant) || '\b')"
_credit_defaults = {
    "owner_name": "'Unknown'",
    "fico_score": "650",
    "total_high_credit": "0",
    "revolving_credit_utilization_pct": "0",
    "active_collections_count": "0",
    "total_collections_amount": "0",
    "bankruptcies_found": "FALSE",
    "number_of_mortgages": "0",
    "mortgage_ltv_details": "'N/A'",
}
_shift = SHIFT.format("application_id")
_keys = "application_id, tx_date, amount, description, tx_type"
_same_key = " AND ".join(f"c.{k} IS NOT DISTINCT FROM o.{k}" for k in _keys.split(", "))


def _group_edit(ledger: str, edits: str) -> str:
    """Set whole (category, payer) groups that hold a differing row."""
    return f"""
SELECT c.* EXCLUDE (is_revenue, needs_review), coalesce(e.v, c.is_revenue) AS is_revenue,
  CASE WHEN e.v THEN FALSE ELSE c.needs_review END AS needs_review
FROM {ledger} c LEFT JOIN (
  SELECT g.application_id, g.category, g.payer_or_source, g.v FROM {edits} g
  WHERE EXISTS (SELECT 1 FROM {ledger} x WHERE x.application_id = g.application_id AND x.category = g.category
    AND x.payer_or_source = g.payer_or_source AND x.is_revenue <> g.v)) e
ON c.application_id = e.application_id AND c.category = e.category AND c.payer_or_source = e.payer_or_source"""


STEPS = {
    "lenders": f"SELECT * FROM (VALUES {_lender_values}) AS t(variant, lender, tier, rank)",
    "industries": f"SELECT * FROM (VALUES {_industry_values}) AS t(rank, industry, points, seasonality)",
    "ledger_unique": f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {_keys} ORDER BY upload_seq, source_file, page_no, line_no) AS rn FROM ledger_raw) WHERE rn = 1""",
    "description_rules": f"""
SELECT description, CASE WHEN regexp_matches(upper(description), {_any(fixed.INTERNAL_TRANSFER_PATTERNS)}) THEN 'Non-Revenue - Own-Account / Internal Transfer'
  WHEN regexp_matches(upper(description), {_any(fixed.GOVERNMENT_PATTERNS)}) THEN 'Non-Revenue - Gov / Tax / Insurance Proceeds'
  WHEN regexp_matches(upper(description), {_any(fixed.NSF_PATTERNS)}) THEN 'Non-Revenue - Refund / Reversal / NSF'
  WHEN EXISTS (SELECT 1 FROM lenders WHERE {_variant_matches}) THEN 'Non-Revenue - MCA / Loan Proceeds' END AS rule
FROM (SELECT DISTINCT description FROM ledger)""",
    "labelled": """
SELECT u.*, coalesce(r.rule, m.category, 'Review Required - Unidentified / Unusual Deposit') AS label
FROM ledger_unique u JOIN description_rules r USING (description) LEFT JOIN label_mappings m ON upper(trim(m.description)) = upper(trim(u.description))""",
    "classified": f"""
SELECT * EXCLUDE (label, pos), CASE WHEN pos THEN 'True Revenue - POS / Processor' ELSE label END AS category,
  pos OR starts_with(label, 'True Revenue') AS is_revenue, NOT pos AND starts_with(label, 'Review Required') AS needs_review
FROM (SELECT *, regexp_matches(description, {_text(fixed.POS_PATTERN)}, 'i') AS pos FROM labelled)""",
    "payments": f"""
SELECT application_id, tx_date, lender, tier, amount AS payment_amount, substr(CAST(tx_date AS STRING), 1, 7) AS month
FROM (SELECT * FROM ledger WHERE tx_type = 'debit') l JOIN (
  SELECT description, arg_min(lender, rank) AS lender, arg_min(tier, rank) AS tier FROM (
    SELECT d.description, v.lender, v.tier, v.rank FROM (SELECT DISTINCT description FROM ledger) d JOIN lenders v ON {_variant_matches}
    UNION ALL SELECT DISTINCT description, 'Generic Loan/MCA', 'Standard', 1000 FROM ledger WHERE regexp_matches(upper(description), '\\bLOAN PAYMENT\\b|\\bLOAN CREDIT\\b'))
  GROUP BY description) n USING (description)""",
    "unique_payments": "SELECT DISTINCT application_id, lender, tier, tx_date, payment_amount FROM payments",
    "gaps": """
SELECT application_id, lender, count(*) AS payments, median(gap) AS median_gap, min(tier) AS tier FROM (
  SELECT *, tx_date - lag(tx_date) OVER (PARTITION BY application_id, lender ORDER BY tx_date) AS gap FROM unique_payments)
GROUP BY application_id, lender""",
    "usual": """
SELECT application_id, lender, payment_amount FROM (SELECT application_id, lender, payment_amount,
  row_number() OVER (PARTITION BY application_id, lender ORDER BY count(*) DESC, payment_amount) AS rn
  FROM unique_payments GROUP BY application_id, lender, payment_amount) WHERE rn = 1""",
    "frequencies": """
SELECT *, CASE WHEN payments = 1 THEN 'Monthly' WHEN median_gap <= 2 THEN 'Daily' WHEN median_gap <= 5 THEN '2-3x Weekly'
  WHEN median_gap <= 8 THEN 'Weekly' WHEN median_gap <= 15 THEN 'Bi-Weekly' ELSE 'Monthly' END AS frequency FROM gaps""",
    "factors": "SELECT * FROM (VALUES ('Daily', 21.0), ('2-3x Weekly', 9.0), ('Weekly', 4.33), ('Bi-Weekly', 2.16), ('Monthly', 1.0)) AS t(frequency, factor)",
    "found_positions": """
SELECT application_id, lender, tier, payment_amount, frequency, CAST(payment_amount AS DOUBLE) * CAST(factor AS DOUBLE) AS monthly_payment
FROM frequencies JOIN usual USING (application_id, lender) JOIN factors USING (frequency)""",
    "position_sums": "SELECT application_id, count(*) AS position_count, CAST(sum(CAST(monthly_payment AS DECIMAL(28,6))) AS DOUBLE) AS total_monthly_payment FROM found_positions GROUP BY application_id",
    "revenue_months": "SELECT application_id, month, sum(amount) AS revenue, count(*) AS n FROM classified WHERE is_revenue AND month IS NOT NULL GROUP BY application_id, month",
    "series": """
SELECT a.application_id, coalesce(count(r.month), 0) AS revenue_months, coalesce(CAST(sum(r.revenue) AS DOUBLE) / count(r.revenue), 0) AS avg_true_revenue,
  coalesce(CAST(round_even(avg(r.n), 0) AS BIGINT), 0) AS deposit_count, stddev_samp(CAST(r.revenue AS DOUBLE)) AS deviation,
  arg_min(r.revenue, r.month) AS first_revenue, arg_max(r.revenue, r.month) AS last_revenue, max(a.months) AS months
FROM (SELECT application_id, count(DISTINCT coalesce(month, '')) AS months FROM classified GROUP BY application_id) a
LEFT JOIN revenue_months r ON a.application_id = r.application_id GROUP BY a.application_id""",
    "moves": """
SELECT application_id, CASE WHEN months > 1 AND avg_true_revenue > 0 THEN deviation / avg_true_revenue * 100 ELSE 0 END AS revenue_volatility,
  CASE WHEN revenue_months >= 2 AND first_revenue > 0 THEN CAST(last_revenue - first_revenue AS DOUBLE) / CAST(first_revenue AS DOUBLE) * 100 ELSE 0 END AS revenue_trend FROM series""",
    "deposits": """
SELECT application_id, coalesce(sum(amount) FILTER (tx_type = 'credit'), 0) AS gross_deposits,
  coalesce(median(CAST(amount AS DOUBLE)) FILTER (tx_type = 'credit'), 0) AS median_deposit,
  coalesce(max(amount) FILTER (tx_type = 'credit'), 0) AS largest_deposit,
  count(*) FILTER (category ILIKE '%nsf%') AS payment_performance FROM classified GROUP BY application_id""",
    "concentrations": """
SELECT application_id, CASE WHEN sum(s) > 0 THEN CAST(max(s) AS DOUBLE) / CAST(sum(s) AS DOUBLE) * 100 ELSE 0 END AS revenue_concentration
FROM (SELECT application_id, payer_or_source, sum(amount) AS s FROM classified WHERE is_revenue GROUP BY application_id, payer_or_source) GROUP BY application_id""",
    "burdens": """
SELECT application_id, coalesce(position_count, 0) AS position_count, coalesce(total_monthly_payment, 0) AS total_monthly_payment,
  CASE WHEN avg_true_revenue > 0 THEN coalesce(total_monthly_payment, 0) / avg_true_revenue * 100 ELSE 0 END AS burden_pct,
  CASE WHEN total_monthly_payment > 0 THEN avg_true_revenue / total_monthly_payment ELSE 99.9 END AS coverage_ratio
FROM series LEFT JOIN position_sums USING (application_id)""",
    # Templates, filled in below.
    "refs": """
SELECT DISTINCT application_id, tx_type, ref FROM (SELECT application_id, tx_type,
  regexp_extract(regexp_replace(upper(description), '[^A-Z0-9#\\-]', '', 'g'), 'TF\\d{3,4}#?\\d{3,4}[\\-#]\\d{3,4}') AS ref FROM {ledger}) WHERE ref <> ''""",
    "pairs": """
SELECT b.application_id, b.ref, count(*) FILTER (l.tx_type = 'credit') AS credit_rows, count(*) FILTER (l.tx_type = 'debit') AS debit_rows,
  least(count(*) FILTER (l.tx_type = 'credit'), count(*) FILTER (l.tx_type = 'debit')) AS round_trips
FROM (SELECT application_id, ref FROM ({refs}) WHERE tx_type = 'credit' INTERSECT SELECT application_id, ref FROM ({refs}) WHERE tx_type = 'debit') b
JOIN {ledger} l ON l.application_id = b.application_id AND contains(regexp_replace(upper(l.description), '[^A-Z0-9#\\-]', '', 'g'), b.ref)
GROUP BY b.application_id, b.ref""",
    "washes": """
SELECT application_id, sum(round_trips) AS round_trips, sum(round_trips) >= 6 AS wash_detected FROM classified_pairs GROUP BY application_id""",
    "profile_of": "SELECT application_id, "
    + ", ".join(f"coalesce({c}, {d}) AS {c}" for c, d in _credit_defaults.items())
    + " FROM (SELECT application_id FROM series UNION SELECT application_id FROM application_inputs) LEFT JOIN credit_profile USING (application_id)",
    "ready": """
SELECT a.application_id, coalesce(gross_deposits, 0) AS gross_deposits, coalesce(median_deposit, 0) AS median_deposit,
  coalesce(largest_deposit, 0) AS largest_deposit, coalesce(avg_true_revenue, 0) AS avg_true_revenue, coalesce(deposit_count, 0) AS deposit_count,
  CASE WHEN s.application_id IS NULL THEN 0 ELSE revenue_volatility END AS revenue_volatility, coalesce(revenue_trend, 0) AS revenue_trend,
  coalesce(revenue_concentration, 0) AS revenue_concentration, coalesce(position_count, 0) AS position_count, coalesce(burden_pct, 0) AS burden_pct,
  coalesce(coverage_ratio, 0) AS coverage_ratio, coalesce(payment_performance, 0) AS payment_performance,
  coalesce(wash_override, wash_detected, FALSE) AS wash_flag, coalesce(credit_score, fico_score) AS credit_score,
  coalesce(public_records, CASE WHEN bankruptcies_found THEN 'Severe' WHEN active_collections_count > 0 THEN 'Moderate' ELSE 'Clean' END) AS public_records,
  coalesce(months_in_business, 24) AS months_in_business, coalesce(avg_daily_balance, 0) AS avg_daily_balance, coalesce(negative_days, 0) AS negative_days,
  coalesce(borrowing_velocity, '0 in 90 Days') AS borrowing_velocity, coalesce(bank_verification, 'Bank Connect') AS bank_verification,
  coalesce(fraud_suspected, FALSE) AS fraud_suspected, coalesce(active_default, FALSE) AS active_default, industry, points AS industry_points, seasonality
FROM profile_of a LEFT JOIN series s ON a.application_id = s.application_id LEFT JOIN moves m ON a.application_id = m.application_id
LEFT JOIN deposits d ON a.application_id = d.application_id LEFT JOIN concentrations c ON a.application_id = c.application_id
LEFT JOIN burdens b ON a.application_id = b.application_id LEFT JOIN washes w ON a.application_id = w.application_id
LEFT JOIN application_inputs i ON a.application_id = i.application_id JOIN industries n ON coalesce(i.industry_rank, 1) = n.rank""",
    "stopped": """
SELECT *, concat_ws(', ', CASE WHEN fraud_suspected THEN 'Suspected altered statements / fraud' END,
  CASE WHEN active_default THEN 'Active lender default or collections' END,
  CASE WHEN wash_flag THEN 'Evidence of structural wash transactions to cover debt' END,
  CASE WHEN avg_true_revenue < 10000 THEN 'Avg True Revenue is under $10,000 policy minimum' END) AS hard_stops FROM ready""",
    "components": f"""
SELECT application_id, component, points, counted FROM (SELECT application_id, unnest([
  {{'component': 'revenue', 'points': {_case('avg_true_revenue', [(150000, 6), (75000, 5), (40000, 4), (20000, 3), (10000, 2)], '>=')}, 'counted': FALSE}},
  {{'component': 'trend', 'points': CASE WHEN revenue_trend > 15 THEN 6 ELSE {_case('revenue_trend', [(5, 5), (-5, 4), (-10, 2), (-20, 1)], '>=')} END, 'counted': FALSE}},
  {{'component': 'deposit_count', 'points': {_case('deposit_count', [(40, 5), (20, 4), (10, 3), (5, 2)], '>=')}, 'counted': FALSE}},
  {{'component': 'volatility', 'points': {_case('revenue_volatility', [(10, 5), (20, 4), (30, 3), (40, 2), (50, 1)], '<=')}, 'counted': FALSE}},
  {{'component': 'daily_balance', 'points': CASE WHEN avg_true_revenue > 0 THEN {_case('avg_daily_balance / avg_true_revenue * 100', [(10, 5), (7, 4), (4, 3), (2, 2), (1, 1)], '>=')} ELSE 0 END, 'counted': TRUE}},
  {{'component': 'positions', 'points': {_case('position_count', [(0, 6), (1, 5), (2, 3), (3, 1)], '<=')}, 'counted': TRUE}},
  {{'component': 'burden', 'points': {_case('burden_pct', [(8, 10), (12, 8), (16, 6), (20, 4), (25, 2)], '<=')}, 'counted': TRUE}},
  {{'component': 'funding_velocity', 'points': CASE borrowing_velocity WHEN '0 in 90 Days' THEN 5 WHEN '1 in 90 Days' THEN 3 ELSE 1 END, 'counted': TRUE}},
  {{'component': 'payment_performance', 'points': {_case('payment_performance', [(0, 4), (1, 3), (2, 2), (4, 1)], '<=')}, 'counted': TRUE}},
  {{'component': 'negative_days', 'points': {_case('negative_days', [(0, 6), (3, 5), (6, 3), (10, 2), (15, 1)], '<=')}, 'counted': TRUE}},
  {{'component': 'months_in_business', 'points': {_case('months_in_business', [(84, 6), (48, 5), (24, 4), (12, 3), (6, 1)], '>=')}, 'counted': TRUE}},
  {{'component': 'industry', 'points': industry_points, 'counted': TRUE}},
  {{'component': 'seasonality', 'points': seasonality, 'counted': TRUE}},
  {{'component': 'credit_score', 'points': {_case('credit_score', [(750, 6), (700, 5), (650, 4), (600, 3), (550, 2), (500, 1)], '>=')}, 'counted': TRUE}},
  {{'component': 'public_records', 'points': CASE public_records WHEN 'Clean' THEN 4 WHEN 'Minor' THEN 3 WHEN 'Moderate' THEN 1 ELSE 0 END, 'counted': TRUE}},
  {{'component': 'verification', 'points': CASE bank_verification WHEN 'Bank Connect' THEN 3 WHEN 'Original PDF' THEN 2 WHEN 'Minor inconsistency' THEN 1 ELSE 0 END, 'counted': TRUE}},
  {{'component': 'concentration', 'points': {_case('revenue_concentration', [(20, 2), (35, 1)], '<=')}, 'counted': TRUE}}
], recursive := true) FROM stopped WHERE hard_stops = '')""",
    "scores": """
SELECT r.application_id, sum(points) FILTER (counted) AS score_reference, sum(points) AS score_full FROM stopped r LEFT JOIN components c ON r.application_id = c.application_id GROUP BY r.application_id""",
    "policies": "SELECT * FROM (VALUES (90, 'A+', 'Prime MCA', 1.00, 0.18), (82, 'A', 'Strong', 0.85, 0.17), (74, 'B', 'Acceptable', 0.70, 0.15), (66, 'C', 'Elevated', 0.55, 0.13), (58, 'D', 'High', 0.35, 0.10), (-1, 'E', 'High / Unacceptable', 0.00, 0.00)) AS t(lowest, grade, risk_tier, advance_share, max_burden_share)",
    "offers": """
SELECT r.*, {score} AS score, g.grade, g.risk_tier, g.advance_share, g.max_burden_share,
  avg_true_revenue * CAST(g.advance_share AS DOUBLE) AS max_advance,
  greatest(0, avg_true_revenue * CAST(g.max_burden_share AS DOUBLE) - avg_true_revenue * burden_pct / 100) AS remaining_capacity
FROM stopped r JOIN scores s USING (application_id) LEFT JOIN policies g
  ON g.lowest = (SELECT max(lowest) FROM policies WHERE lowest <= {score})""",
    "row_edits": """
SELECT application_id, tx_date, amount, description, tx_type, CASE WHEN line_no % 33 <> 0 THEN line_no % 2 = 0 END AS v FROM ledger_unique WHERE line_no % 11 = 0""",
    "edited": f"SELECT c.* EXCLUDE (is_revenue), coalesce(o.v, c.is_revenue) AS is_revenue FROM classified c LEFT JOIN row_edits o ON {_same_key}",
    "text_of_file": "SELECT application_id, file_name, trim(string_agg(text, chr(10) ORDER BY page_no), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM statement_text GROUP BY application_id, file_name",
    # What the bank prints per application, from the ledger instead of from text.
    "printed": """
SELECT application_id, coalesce(sum(amount) FILTER (tx_type = 'credit'), 0) AS credits, coalesce(sum(amount) FILTER (tx_type = 'debit'), 0) AS debits, application_id % 7 AS way FROM ledger GROUP BY application_id""",
    "printed_anchors": """
SELECT application_id, 'stmt' AS file_name, CASE way WHEN 0 THEN 'amounts_credited' WHEN 1 THEN 'closing_totals' WHEN 2 THEN 'deposits_and_credits' WHEN 3 THEN 'explicit_total' END AS anchor_method,
  CASE WHEN way <= 3 THEN credits END AS anchor_total, CASE way WHEN 4 THEN 1000 WHEN 5 THEN 9000000 END AS opening, CASE way WHEN 4 THEN 500000 WHEN 5 THEN 10 END AS closing, debits FROM printed""",
    "implied": """
SELECT *, CASE WHEN anchor_method IS NULL THEN closing - opening + debits END AS implied_total,
  CASE WHEN anchor_method IS NOT NULL THEN anchor_method WHEN closing - opening + debits >= 0 THEN 'balance_change' END AS used_method,
  CASE WHEN anchor_method IS NOT NULL THEN anchor_total WHEN closing - opening + debits >= 0 THEN closing - opening + debits END AS used_total FROM printed_anchors""",
    "anchor_sums": "SELECT application_id, coalesce(sum(used_total), 0) AS expected_credits, count(used_method) AS anchors, count(*) AS files FROM implied GROUP BY application_id",
    # The ledger as printed on statements of the year the text names.
    "printed_ledger": """
SELECT *, CAST(2018 + application_id % 9 AS STRING) || substr(CAST(tx_date AS STRING), 5, 6) AS date_text, CAST(2018 + application_id % 9 AS STRING) || substr(CAST(tx_date AS STRING), 5, 3) AS printed_month FROM ledger""",
    "dated_lines": """
SELECT application_id, line_no, line_no % 7 AS way, tx_date, substr(CAST(tx_date AS STRING), 1, 4) AS y, substr(CAST(tx_date AS STRING), 6, 2) AS m, substr(CAST(tx_date AS STRING), 9, 2) AS d FROM ledger""",
    "printed_money": "SELECT application_id, line_no, tx_type, amount, (line_no + application_id) % 9 AS way FROM ledger",
    "pages_of": "SELECT application_id, page_no, max(top) AS last_top, count(DISTINCT top) AS line_count FROM statement_words GROUP BY application_id, page_no",
    "requested": "SELECT DISTINCT u.application_id, u.description FROM ledger_unique u JOIN description_rules r USING (description) WHERE r.rule IS NULL",
    "given": """
SELECT application_id, upper(description) AS label_key, CASE WHEN length(description) % 3 = 0 THEN 'True Revenue - B2B E-Transfer' ELSE 'True Revenue - Verified Cash' END AS category FROM requested""",
    "reported": "SELECT * FROM credit_profile WHERE application_id % 7 NOT IN (3, 5)",
}
for _ledger in ("classified", "ledger"):
    _refs = STEPS["refs"].replace("{ledger}", _ledger)
    STEPS[f"{_ledger}_refs"] = _refs
    STEPS[f"{_ledger}_pairs"] = STEPS["pairs"].replace("{refs}", _refs).replace("{ledger}", _ledger)
for _mode in ("full", "reference"):
    STEPS[f"{_mode}_offers"] = STEPS["offers"].replace("{score}", f"s.score_{_mode}")
for _template in ("refs", "pairs", "offers"):
    del STEPS[_template]

_ledger_row = (
    "application_id, CAST(tx_date AS STRING) AS tx_date, month, description, "
    f"{_number('amount', 'amount')}, payer_or_source, tx_type, source_file, "
    f"{_long('upload_seq', 'upload_seq')}, {_long('page_no', 'page_no')}, line_no"
)
_flags = "category, is_revenue, needs_review"
_line_key = "application_id, 'stmt' AS file_name, CAST(page_no AS BIGINT) AS page_no"
_printed_entry = (
    "application_id, date_text, printed_month AS month, description, "
    f"{_number('amount', 'amount')}"
)

QUERIES = {
    "file_dedup": f"""
SELECT application_id, file_name, {_long('upload_seq', 'upload_seq')}, sha256, CASE WHEN row_number() OVER w > 1 THEN first_value(file_name) OVER w END AS duplicate_of
FROM (SELECT DISTINCT application_id, file_name, upload_seq, sha256(text) AS sha256 FROM statement_files)
WINDOW w AS (PARTITION BY application_id, sha256 ORDER BY upload_seq IS NULL, upload_seq, file_name)""",
    "file_text": f"""
SELECT * FROM (SELECT application_id, file_name, {_long('upload_seq', 'upload_seq')}, trim(string_agg(coalesce(text, ''), chr(10) ORDER BY page_no, text), ' ' || chr(9) || chr(10) || chr(13)) AS text
FROM text_pages GROUP BY application_id, file_name, upload_seq) WHERE text <> ''""",
    "words_scan": f"""
SELECT DISTINCT p.application_id, p.file_name, CAST(p.upload_seq AS BIGINT) AS upload_seq, CAST(p.page_no AS BIGINT) AS page_no FROM statement_text p WHERE NOT EXISTS (SELECT 1 FROM statement_words w WHERE w.application_id = p.application_id AND w.page_no = p.page_no)""",
    "credit_profile": "SELECT application_id, coalesce(owner_name, 'Unknown') AS owner_name, "
    + ", ".join(
        [
            _long("coalesce(fico_score, 650)", "fico_score"),
            _number("coalesce(total_high_credit, 0)", "total_high_credit"),
            _number("coalesce(revolving_credit_utilization_pct, 0)", "revolving_credit_utilization_pct"),
            _long("coalesce(active_collections_count, 0)", "active_collections_count"),
            _number("coalesce(total_collections_amount, 0)", "total_collections_amount"),
            "coalesce(bankruptcies_found, FALSE) AS bankruptcies_found",
            _long("coalesce(number_of_mortgages, 0)", "number_of_mortgages"),
            "coalesce(mortgage_ltv_details, 'N/A') AS mortgage_ltv_details",
            "owner_name IS NOT NULL AS is_loaded",
        ]
    )
    + " FROM application_inputs LEFT JOIN reported USING (application_id)",
    "label_requests": f"""
SELECT u.application_id, u.description, {_number('max(amount)', 'max_amount')} FROM ledger_unique u JOIN requested USING (application_id, description) GROUP BY u.application_id, u.description""",
    "label_request_batches": """
SELECT application_id, CAST(('0x' || substr(md5(description), 1, 8)) AS BIGINT) % n AS batch_no, count(*) AS descriptions
FROM requested JOIN (SELECT application_id, CAST(ceil(count(*) / 3) AS BIGINT) AS n FROM requested GROUP BY application_id) USING (application_id) GROUP BY ALL""",
    "label_responses": "SELECT * FROM given",
    "industry_lookup": f"SELECT application_id, industry, {_long('points', 'points')}, {_long('seasonality', 'seasonality')} FROM application_inputs JOIN industries ON industry_rank = rank",
    "lender_variant_match": f"""
SELECT variant, lender, tier, {_long('rank', 'rank')}, {_long('sum(n)', 'ledger_rows')} FROM (SELECT description, count(*) AS n FROM ledger GROUP BY description) JOIN lenders ON {_variant_matches} GROUP BY ALL""",
    "word_dedup": f"SELECT {_line_key}, CAST(1 AS BIGINT) AS upload_seq, {_long('word_seq', 'word_seq')}, x0, top, text FROM statement_words",
    "line_grouping": f"""
SELECT {_line_key}, row_number() OVER (PARTITION BY application_id, page_no ORDER BY top) AS line_no,
  string_agg(text, ' ' ORDER BY x0) AS line, count(*) AS words FROM statement_words GROUP BY application_id, page_no, top""",
    "line_lookahead": f"""
SELECT {_line_key}, row_number() OVER w AS line_no, coalesce(lead(string_agg(text, ' ' ORDER BY x0)) OVER w, '') AS next_line
FROM statement_words GROUP BY application_id, page_no, top WINDOW w AS (PARTITION BY application_id, page_no ORDER BY top)""",
    "balance_column": f"SELECT {_line_key}, CAST(1 AS BIGINT) AS line_no, x0 - 10 AS balance_x FROM statement_words WHERE lower(text) = 'balance'",
    "column_calibration": f"""
SELECT {_line_key}, CAST(1 AS BIGINT) AS line_no, min(x0) - 10 AS desc_limit, min(x0) - 20 AS debit_min, max(x0) - 5 AS debit_max, max(x0) - 20 AS credit_min
FROM statement_words WHERE text IN ('Withdrawn', 'Deposited') GROUP BY application_id, page_no""",
    "column_bounds": f"""
SELECT {_line_key}, CAST(290 + {_shift} AS DOUBLE) AS desc_limit, CAST(280 + {_shift} AS DOUBLE) AS debit_min, CAST(385 + {_shift} AS DOUBLE) AS debit_max, CAST(370 + {_shift} AS DOUBLE) AS credit_min,
  CAST(465 + {_shift} AS DOUBLE) AS credit_max, CAST(470 + {_shift} AS DOUBLE) AS balance_x, CAST(1 AS BIGINT) AS first_line, line_count AS last_line FROM pages_of""",
    "noise_lines": f"""
SELECT application_id, source_file, line_no, regexp_matches(upper(line), {_any([re.escape(p) for p in fixed.NOISE_PHRASES])}) AS noise FROM printed_lines""",
    "parse_date": """
SELECT application_id, line_no, date_text, regexp_extract(date_text, '^(.*)-[0-9]+$', 1) AS month, CASE WHEN length(date_text) = 10 THEN CAST(try_cast(date_text AS DATE) AS STRING) END AS tx_date FROM (
  SELECT application_id, line_no, CASE WHEN way IN (0, 3) THEN y WHEN way = 4 THEN '20150' ELSE '2021' END || '-' || m || '-' || d AS date_text FROM dated_lines WHERE way <= 4)""",
    "numeric_date": "SELECT application_id, line_no, '2021-' || m || '-' || d AS date_text FROM dated_lines WHERE way = 5",
    "statement_year": r"""
SELECT file_name, coalesce(nullif(regexp_extract(text, '\b(201[5-9]|202[0-9])\b', 1), ''), '2026') AS year FROM statement_files
UNION ALL SELECT DISTINCT 'statement-' || CAST(application_id AS STRING), CAST(2018 + application_id % 9 AS STRING) FROM ledger""",
    "active_date": f"""
SELECT application_id, 'stmt' AS file_name, date_text, n + headings AS line_count, CAST(1 AS BIGINT) AS date_rows FROM (
  SELECT application_id, date_text, count(*) AS n, count(*) FILTER (k % {LINES} = 0 AND NOT is_last) AS headings FROM (
    SELECT application_id, date_text, row_number() OVER w AS k, lead(line_no) OVER w IS NULL AS is_last
    FROM printed_ledger WINDOW w AS (PARTITION BY application_id ORDER BY tx_date, source_file, line_no, amount, description)) GROUP BY application_id, date_text)
UNION ALL SELECT DISTINCT application_id, 'stmt', CAST(NULL AS STRING), CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM ledger""",
    "row_gate": "SELECT application_id, 'stmt' AS file_name, CAST(page_no AS BIGINT) AS page_no, line_count - 1 AS line_count FROM pages_of",
    "band_split": f"""
SELECT application_id, CAST(page_no AS BIGINT) AS page_no, dense_rank() OVER (PARTITION BY application_id, page_no ORDER BY top) + 1 AS line_no,
  coalesce(string_agg(text, ' ' ORDER BY x0) FILTER (x0 - {_shift} BETWEEN 90 AND 250), '') AS description, coalesce(string_agg(text, ' ') FILTER (x0 - {_shift} = 305), '') AS debit,
  coalesce(string_agg(text, ' ') FILTER (x0 - {_shift} = 395), '') AS credit FROM statement_words WHERE top > 60 GROUP BY application_id, page_no, top""",
    "parse_money": f"""
SELECT application_id, line_no, tx_type, {_number("CASE WHEN way IN (1, 4) THEN -amount WHEN way = 5 THEN floor(amount) WHEN way IN (6, 7) THEN NULL ELSE amount END", 'value')} FROM printed_money""",
    # '1.234,56' reads 1.23 here: with cents, the first two digits after a point count.
    "money_from_words": f"""
SELECT application_id, line_no, tx_type, {_number("CASE way WHEN 2 THEN CASE WHEN amount >= 1000 THEN floor(amount / 10) / 100 ELSE amount END WHEN 5 THEN CASE WHEN amount >= 100 THEN floor(amount) END WHEN 6 THEN NULL ELSE amount END", 'value')} FROM printed_money""",
    "summary_rows": f"""
SELECT application_id, source_file, line_no, regexp_matches(upper(line), {_any([re.escape(p) for p in fixed.SUMMARY_PHRASES])})
  OR (contains(upper(line), 'TOTAL') AND len(string_split(line, ' ')) < 3) AS is_summary FROM printed_lines""",
    "statement_rows": f"""
SELECT application_id, date_text, CAST(try_cast(date_text AS DATE) AS STRING) AS tx_date, printed_month AS month, description,
  {_number("CASE WHEN tx_type = 'debit' THEN amount END", 'debit')}, {_number("CASE WHEN tx_type = 'credit' THEN amount END", 'credit')} FROM printed_ledger""",
    "credit_rows": f"SELECT {_printed_entry}, description AS payer_or_source, tx_type FROM printed_ledger WHERE tx_type = 'credit'",
    "nsf_debit_rows": f"SELECT {_printed_entry}, 'Bank Fee' AS payer_or_source, tx_type FROM printed_ledger WHERE tx_type = 'debit' AND starts_with(description, 'NSF') AND amount > 30",
    "lender_debits": f"SELECT application_id, CAST(tx_date AS STRING) AS tx_date, lender, tier, {_number('payment_amount', 'payment_amount')}, month FROM payments",
    "extracted_lender_debits": f"SELECT application_id, lender, tier, {_number('payment_amount', 'payment_amount')}, CAST(2018 + application_id % 9 AS STRING) || substr(month, 5, 3) AS month FROM payments",
    "file_debit_total": f"SELECT application_id, 'stmt' AS file_name, CAST(1 AS BIGINT) AS upload_seq, {_number('sum(amount)', 'debit_total')} FROM ledger WHERE tx_type = 'debit' GROUP BY application_id",
    "anchor_total": f"SELECT application_id, file_name, CAST(1 AS BIGINT) AS upload_seq, anchor_method, {_number('anchor_total', 'anchor_total')} FROM printed_anchors",
    "opening_closing": f"SELECT application_id, file_name, CAST(1 AS BIGINT) AS upload_seq, {_number('opening', 'opening')}, {_number('closing', 'closing')} FROM printed_anchors",
    "implied_anchor": f"SELECT application_id, file_name, {_number('implied_total', 'implied_total')}, used_method, {_number('used_total', 'used_total')} FROM implied",
    "expected_credits": f"SELECT application_id, {_number('expected_credits', 'expected_credits')}, anchors, files FROM anchor_sums",
    "anchor_coverage": "SELECT application_id, anchors, files, anchors < files AS anchor_warning FROM anchor_sums",
    "ledger_dedup": f"SELECT {_ledger_row} FROM ledger_unique",
    "removed_duplicates": f"""
SELECT application_id, {_long('sum(n)', 'rows_before')}, count(*) AS rows_kept, {_long('sum(n) - count(*)', 'rows_removed')} FROM (SELECT {_keys}, count(*) AS n FROM ledger_raw GROUP BY ALL) GROUP BY application_id""",
    "matches_any": f"""
SELECT description, count(*) AS ledger_rows, regexp_matches(upper(description), {_any(fixed.INTERNAL_TRANSFER_PATTERNS)}) AS internal_transfer,
  regexp_matches(upper(description), {_any(fixed.GOVERNMENT_PATTERNS)}) AS government, regexp_matches(upper(description), {_any(fixed.NSF_PATTERNS)}) AS nsf,
  EXISTS (SELECT 1 FROM lenders WHERE {_variant_matches}) AS lender FROM ledger GROUP BY description""",
    "rule_category": "SELECT application_id, line_no, tx_type, description, rule AS category FROM ledger JOIN description_rules USING (description)",
    "apply_labels": "SELECT application_id, line_no, tx_type, description, label AS category FROM labelled",
    "response_labels": """
SELECT u.application_id, coalesce(r.rule, g.category) AS category, count(*) AS ledger_rows FROM ledger_unique u JOIN description_rules r USING (description)
LEFT JOIN given g ON g.application_id = u.application_id AND g.label_key = upper(u.description) GROUP BY ALL""",
    "revenue_flags": "SELECT application_id, line_no, tx_type, label AS category, starts_with(label, 'True Revenue') AS is_revenue, starts_with(label, 'Review Required') AS needs_review FROM labelled",
    "pos_override": f"SELECT {_ledger_row}, {_flags} FROM classified",
    "wash_refs": "SELECT * FROM ledger_refs",
    "wash_pairs": "SELECT * FROM classified_pairs",
    "wash_pairs_all_debits": f"SELECT application_id, {_long('sum(round_trips)', 'round_trips')}, sum(round_trips) >= 6 AS wash_detected FROM ledger_pairs GROUP BY application_id",
    "wash_category": """
SELECT application_id, count(*) FILTER (description = 'MISC CREDIT') AS wash_rows, count(*) FILTER (description = 'MISC CREDIT') >= 3 AS wash_by_category FROM classified GROUP BY application_id""",
    "lender_debit_dedup": f"SELECT application_id, lender, CAST(tx_date AS STRING) AS tx_date, {_number('payment_amount', 'payment_amount')}, tier FROM unique_payments",
    "payment_gap": f"SELECT application_id, lender, payments, {_number('median_gap', 'median_gap')}, tier FROM gaps",
    "payment_amount": f"SELECT application_id, lender, {_number('payment_amount', 'payment_amount')} FROM usual",
    "frequency": "SELECT application_id, lender, frequency FROM frequencies",
    "monthly_equiv": f"SELECT application_id, lender, {_number('CASE WHEN application_id % 5 < 2 THEN 0 ELSE monthly_payment END', 'monthly_payment')} FROM found_positions",
    "positions": f"SELECT application_id, lender, tier, {_number('payment_amount', 'payment_amount')}, frequency, {_number('monthly_payment', 'monthly_payment')} FROM found_positions",
    "position_overrides": f"""
SELECT application_id, lender, tier, {_number('payment_amount', 'payment_amount')}, frequency, {_number('monthly_payment', 'monthly_payment')} FROM (
  SELECT * FROM found_positions WHERE NOT (lender = 'GREENBOX' AND application_id % 2 = 0 AND application_id IN (SELECT application_id FROM application_inputs))
    AND NOT (lender = 'MERCHANT GROWTH' AND application_id % 3 = 0 AND application_id IN (SELECT application_id FROM application_inputs))
  UNION ALL SELECT i.application_id, 'GREENBOX', p.tier, 75.50, 'Weekly', 75.50 * 4.33 FROM application_inputs i
    LEFT JOIN found_positions p ON p.application_id = i.application_id AND p.lender = 'GREENBOX' WHERE i.application_id % 2 = 0
  UNION ALL SELECT application_id, 'NEW LENDER', 'Standard', 10, 'Daily', 210 FROM application_inputs WHERE application_id % 4 = 0)""",
    "reconcile": f"""
SELECT application_id, {_number('ledger_total', 'ledger_total')}, {_number('expected_credits', 'expected_credits')},
  {_number('CASE WHEN expected_credits <> 0 THEN round(abs(CAST(ledger_total AS DOUBLE) - expected_credits), 2) END', 'variance')},
  CASE WHEN expected_credits = 0 THEN 'Anchor Missing' WHEN round(abs(CAST(ledger_total AS DOUBLE) - expected_credits), 2) > 2 THEN 'Mismatch Detected' ELSE 'Matched' END AS status
FROM (SELECT application_id, ledger_total, coalesce(e, 0) AS expected_credits FROM (SELECT application_id, coalesce(sum(amount) FILTER (tx_type = 'credit'), 0) AS ledger_total FROM ledger GROUP BY application_id)
LEFT JOIN (SELECT application_id, expected_credits AS e FROM anchors) USING (application_id))""",
    "filter_options": """
SELECT DISTINCT application_id, 'month' AS kind, month AS value FROM classified WHERE month IS NOT NULL UNION ALL SELECT DISTINCT application_id, 'category', category FROM classified""",
    "ledger_filter": f"SELECT {_ledger_row}, {_flags} FROM classified WHERE month = '2024-03' AND category = 'Non-Revenue - Refund / Reversal / NSF'",
    "row_override": f"SELECT {_ledger_row}, {_flags} FROM edited",
    "group_override": f"SELECT {_ledger_row}, {_flags} FROM ("
    + _group_edit(
        "classified",
        "(SELECT DISTINCT application_id, category, payer_or_source, application_id % 2 = 0 AS v FROM classified WHERE application_id % 3 <> 0)",
    )
    + ")",
    "group_mode_normalise": f"SELECT {_ledger_row}, {_flags} FROM ("
    + _group_edit(
        "edited",
        "(SELECT application_id, category, payer_or_source, count(*) FILTER (is_revenue) > count(*) FILTER (NOT is_revenue) AS v FROM edited GROUP BY ALL)",
    )
    + ")",
    "category_payer_summary": f"""
SELECT application_id, category, payer_or_source, {_number('sum(amount)', 'total')}, count(amount) AS row_count,
  count(*) FILTER (is_revenue) > count(*) FILTER (NOT is_revenue) AS is_revenue FROM edited GROUP BY application_id, category, payer_or_source""",
    "review_kpis": f"""
SELECT application_id, {_number('r', 'true_revenue')}, {_number('q', 'under_review')}, {_number('g', 'gross_deposits')}, m AS active_months,
  {_number('CASE WHEN m > 0 THEN CAST(r AS DOUBLE) / m ELSE 0 END', 'kpi_avg_monthly_revenue')},
  {_number('CASE WHEN g > 0 THEN CAST(g - r AS DOUBLE) / CAST(g AS DOUBLE) * 100 ELSE 0 END', 'non_revenue_pct')}
FROM (SELECT application_id, coalesce(sum(amount) FILTER (is_revenue), 0) AS r, coalesce(sum(amount) FILTER (needs_review), 0) AS q,
  coalesce(sum(amount) FILTER (tx_type = 'credit'), 0) AS g, count(DISTINCT month) AS m FROM classified GROUP BY application_id)""",
    "monthly_summary": f"""
SELECT application_id, month, deposits, {_number('total_deposits', 'total_deposits')}, revenue_count, {_number('total_revenue', 'total_revenue')},
  non_revenue_count, {_number('total_non_revenue', 'total_non_revenue')}, {_long('coalesce(position_count, 0) * 4', 'loan_debits')},
  {_number('coalesce(total_monthly_payment, 0)', 'total_loan_debits')}
FROM (SELECT application_id, month, count(*) FILTER (tx_type = 'credit') AS deposits, coalesce(sum(amount) FILTER (tx_type = 'credit'), 0) AS total_deposits,
  count(*) FILTER (is_revenue) AS revenue_count, coalesce(sum(amount) FILTER (is_revenue), 0) AS total_revenue,
  count(*) FILTER (tx_type = 'credit' AND NOT is_revenue) AS non_revenue_count, coalesce(sum(amount) FILTER (tx_type = 'credit' AND NOT is_revenue), 0) AS total_non_revenue
  FROM classified WHERE month IS NOT NULL GROUP BY application_id, month) LEFT JOIN position_sums USING (application_id)""",
    "written_output": f"""
SELECT application_id, month, count(*) FILTER (tx_type = 'credit') AS deposits, {_number("coalesce(sum(amount) FILTER (tx_type = 'credit'), 0)", 'deposit_total')}
FROM classified GROUP BY application_id, month""",
    "loan_columns": f"SELECT application_id, position_count, {_number('total_monthly_payment', 'total_monthly_payment')} FROM position_sums",
    "deposit_stats": f"SELECT application_id, {_number('gross_deposits', 'gross_deposits')}, {_number('median_deposit', 'median_deposit')}, {_number('largest_deposit', 'largest_deposit')} FROM deposits",
    "revenue_series": f"SELECT application_id, revenue_months, {_number('avg_true_revenue', 'avg_true_revenue')}, deposit_count FROM series",
    "revenue_volatility": f"SELECT application_id, {_number('revenue_volatility', 'revenue_volatility')} FROM moves",
    "revenue_trend": f"SELECT application_id, {_number('revenue_trend', 'revenue_trend')} FROM moves",
    "revenue_concentration": f"SELECT application_id, {_number('revenue_concentration', 'revenue_concentration')} FROM concentrations",
    "advance_burden": f"""
SELECT application_id, position_count, {_number('total_monthly_payment', 'total_monthly_payment')}, {_number('burden_pct', 'burden_pct')}, {_number('coverage_ratio', 'coverage_ratio')} FROM burdens""",
    "payment_performance": "SELECT application_id, payment_performance FROM deposits",
    "public_records_default": """
SELECT application_id, CASE WHEN bankruptcies_found THEN 'Severe' WHEN active_collections_count > 0 THEN 'Moderate' ELSE 'Clean' END AS public_records
FROM application_inputs LEFT JOIN credit_profile USING (application_id)""",
    "hard_stops": "SELECT application_id, CASE WHEN hard_stops = '' THEN 'Scored' ELSE 'Decline' END AS decision, hard_stops FROM stopped",
    "score_components": f"SELECT application_id, component, {_long('points', 'points')}, counted FROM components",
    "score": f"SELECT application_id, {_long('score_reference', 'score_reference')}, {_long('score_full', 'score_full')}, {_long('score_reference', 'score')} FROM scores",
    "grade": f"""
SELECT application_id, {_long('score', 'score')}, grade, risk_tier, {_number('advance_share', 'advance_share')}, {_number('max_burden_share', 'max_burden_share')} FROM full_offers""",
    "offer": f"""
SELECT application_id, {_number('max_advance', 'max_advance')}, {_number('CASE WHEN grade IS NOT NULL THEN remaining_capacity END', 'remaining_capacity')},
  {_number('CASE WHEN grade IS NOT NULL THEN remaining_capacity / 21 END', 'daily_payment')} FROM full_offers""",
    "scorecard": "SELECT application_id, "
    + ", ".join(
        _number(c, c)
        for c in (
            "gross_deposits",
            "median_deposit",
            "largest_deposit",
            "avg_true_revenue",
            "revenue_volatility",
            "revenue_trend",
            "revenue_concentration",
            "burden_pct",
            "coverage_ratio",
            "max_advance",
        )
    )
    + f""", {_long('deposit_count', 'deposit_count')}, {_long('position_count', 'position_count')}, {_long('payment_performance', 'payment_performance')},
  wash_flag, {_long('credit_score', 'credit_score')}, public_records, industry, CASE WHEN hard_stops = '' THEN 'Scored' ELSE 'Decline' END AS decision, hard_stops,
  {_long('score_reference', 'score_reference')}, {_long('score_full', 'score_full')}, grade, risk_tier,
  {_number('CASE WHEN grade IS NOT NULL THEN remaining_capacity END', 'remaining_capacity')},
  {_number('CASE WHEN grade IS NOT NULL THEN remaining_capacity / 21 END', 'daily_payment')}
FROM reference_offers JOIN scores USING (application_id)""",
}


_money = "CAST(CAST({0} AS DECIMAL(28,2)) AS STRING)".format
QUERIES["diagnostics"] = f"""
SELECT application_id, file_name, CAST(NULL AS BIGINT) AS page_no, 'duplicate_file' AS code, 'same bytes as ' || duplicate_of AS message
FROM ({QUERIES["file_dedup"]}) WHERE duplicate_of IS NOT NULL
UNION ALL SELECT application_id, file_name, NULL, CASE WHEN anchor_method IS NOT NULL THEN 'anchor_found' WHEN implied_total >= 0 THEN 'anchor_from_balances'
  WHEN implied_total < 0 THEN 'anchor_negative' ELSE 'anchor_missing' END, CASE WHEN anchor_method IS NOT NULL THEN anchor_method || ' = ' || {_money("anchor_total")}
  WHEN implied_total IS NOT NULL THEN {_money("closing")} || ' - ' || {_money("opening")} || ' + ' || {_money("debits")} || ' = ' || {_money("implied_total")}
  ELSE 'no deposit total and no pair of balances' END FROM implied
UNION ALL SELECT application_id, NULL, NULL, 'duplicate_rows', CAST(rows_removed AS STRING) || ' removed' FROM ({QUERIES["removed_duplicates"]}) WHERE rows_removed > 0
UNION ALL SELECT application_id, NULL, NULL, 'wash', CAST(CAST(round_trips AS BIGINT) AS STRING) || ' round trips' FROM washes WHERE wash_detected
UNION ALL SELECT application_id, NULL, NULL, 'unreadable_credit_response', '1 unreadable' FROM credit_profile WHERE application_id % 7 IN (3, 5)
UNION ALL SELECT application_id, file_name, page_no, 'no_words', 'no positioned words' FROM ({QUERIES["words_scan"]})
UNION ALL SELECT application_id, 'stmt', CAST(page_no AS BIGINT), 'calibrated', printf('description < %.1f, debit %.1f-%.1f, credit from %.1f', 290.0 + {_shift}, 280.0 + {_shift}, 385.0 + {_shift}, 370.0 + {_shift}) FROM pages_of
UNION ALL SELECT application_id, file_name, NULL, 'no_text', 'no text; scanned or damaged' FROM text_pages GROUP BY application_id, file_name, upload_seq
  HAVING trim(string_agg(coalesce(text, ''), ''), ' ' || chr(9) || chr(10) || chr(13)) = ''"""


def _used(sql: str, sources: dict[str, str]) -> list[str]:
    """Views that a text reads."""
    tables = "|".join(sources)
    found = set(re.findall(rf"(?:FROM|JOIN)\s*\(?\s*({tables})\b", sql))
    return [n for n in sources if n in found]


def oracle_sql() -> dict[str, str]:
    sources = {**VIEWS, **STEPS}

    def closure(sql: str, done: list[str]) -> list[str]:
        for name in _used(sql, sources):
            if name not in done:
                closure(sources[name], done)
                done.append(name)
        return done

    result = {}
    for key, sql in QUERIES.items():
        names = closure(sql, [])
        ctes = ",\n".join(f"{name} AS ({sources[name].strip()})" for name in names)
        result[key] = (f"WITH {ctes}\n" if ctes else "") + sql.strip()
    return result
