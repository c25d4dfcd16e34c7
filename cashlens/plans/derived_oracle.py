"""SQL of the queries in `derived`, on the steps of `oracle`."""

from __future__ import annotations

from cashlens.plans.derived import DATED_EDITS, DATED_REPORTS, GROWN_AFTER, NOTES, RUN_GAP, SPARSE_WORDS, SPELLINGS, TOO_LARGE, UPLOADS
from cashlens.plans.inputs import LINES
from cashlens.plans.oracle import QUERIES, STEPS, _case, _long, _number, _shift, _text

STEPS["nets"] = """
SELECT application_id, tx_date, sum(CASE WHEN tx_type = 'credit' THEN amount ELSE -amount END) AS net FROM ledger GROUP BY ALL"""
STEPS["calendar"] = """
SELECT application_id, CAST(unnest(generate_series(min(tx_date), max(tx_date), INTERVAL 1 DAY)) AS DATE) AS day FROM nets GROUP BY application_id"""
STEPS["running"] = """
SELECT c.application_id, c.day, coalesce(n.net, 0) AS net,
  coalesce(p.opening, 0) + sum(coalesce(n.net, 0)) OVER (PARTITION BY c.application_id ORDER BY c.day ROWS UNBOUNDED PRECEDING) AS balance
FROM calendar c LEFT JOIN nets n ON n.application_id = c.application_id AND n.tx_date = c.day
LEFT JOIN printed_anchors p ON p.application_id = c.application_id"""
STEPS["held"] = """
SELECT application_id, count(*) AS days, CAST(sum(balance) AS DOUBLE) / count(*) AS avg_daily_balance, count(*) FILTER (balance < 0) AS negative_days,
  min(balance) AS lowest_balance, arg_max(balance, day) AS last_balance FROM running GROUP BY application_id"""
STEPS["funded_days"] = """
SELECT application_id, tx_date, CAST(bool_or(tx_type = 'credit' AND category = 'Non-Revenue - MCA / Loan Proceeds') AS INT) AS funded
FROM classified WHERE tx_date IS NOT NULL GROUP BY application_id, tx_date"""
STEPS["funding"] = """
SELECT application_id, max(tx_date) AS last_day, arg_max(n, tx_date) AS fundings, max(n) AS most_fundings FROM (
  SELECT application_id, tx_date, sum(funded) OVER (PARTITION BY application_id ORDER BY tx_date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) AS n FROM funded_days)
GROUP BY application_id"""
STEPS["velocity"] = """
SELECT *, CASE fundings WHEN 0 THEN '0 in 90 Days' WHEN 1 THEN '1 in 90 Days' ELSE '2+ in 90 Days' END AS borrowing_velocity FROM funding"""
STEPS["answered"] = """
SELECT s.* EXCLUDE (avg_daily_balance, negative_days, borrowing_velocity),
  coalesce(CASE WHEN s.application_id % 3 = 0 THEN s.avg_daily_balance END, h.avg_daily_balance, 0) AS avg_daily_balance,
  coalesce(CASE WHEN s.application_id % 3 = 0 THEN s.negative_days END, h.negative_days, 0) AS negative_days,
  coalesce(CASE WHEN s.application_id % 3 = 0 THEN s.borrowing_velocity END, v.borrowing_velocity, '0 in 90 Days') AS borrowing_velocity
FROM stopped s LEFT JOIN held h USING (application_id) LEFT JOIN velocity v USING (application_id)"""
STEPS["spelt"] = f"SELECT * EXCLUDE (payer_or_source), {SPELLINGS} AS payer_or_source FROM classified"
STEPS["payer_rows"] = r"""
SELECT application_id, payer_or_source, trim(regexp_replace(upper(payer_or_source), '[^\p{L}]+', ' ', 'g')) AS payer_key, count(*) AS n
FROM spelt WHERE payer_or_source IS NOT NULL GROUP BY ALL"""
STEPS["gram_sets"] = """
SELECT application_id, payer_key, list_distinct(list_transform(range(1, greatest(length(payer_key), 1) + 1), lambda i: substr(' ' || payer_key || ' ', i, 3))) AS grams
FROM (SELECT DISTINCT application_id, payer_key FROM payer_rows WHERE payer_key <> '')"""
STEPS["linked_keys"] = """
SELECT a.application_id, a.payer_key AS a, b.payer_key AS b FROM gram_sets a JOIN gram_sets b ON a.application_id = b.application_id AND a.payer_key <> b.payer_key
WHERE 3 * len(list_intersect(a.grams, b.grams)) >= len(a.grams) + len(b.grams) AND levenshtein(a.payer_key, b.payer_key) <= 2"""
STEPS["payer_roots"] = """
SELECT application_id, a AS payer_key, min(b) AS root FROM (
  WITH RECURSIVE reached AS (SELECT application_id, payer_key AS a, payer_key AS b FROM gram_sets
    UNION SELECT r.application_id, r.a, k.b FROM reached r JOIN linked_keys k ON k.application_id = r.application_id AND k.a = r.b)
  SELECT * FROM reached) GROUP BY application_id, a"""
STEPS["payer_groups"] = """
SELECT p.application_id, p.payer_or_source, p.payer_key, first_value(p.payer_or_source) OVER (
  PARTITION BY p.application_id, coalesce(r.root, '=' || p.payer_or_source) ORDER BY p.n DESC, p.payer_or_source) AS payer
FROM payer_rows p LEFT JOIN payer_roots r ON r.application_id = p.application_id AND r.payer_key = p.payer_key"""
STEPS["uploads"] = UPLOADS
STEPS["spans"] = "SELECT application_id, source_file, upload_seq, min(tx_date) AS a, max(tx_date) AS b FROM uploads GROUP BY ALL"
STEPS["overlapping"] = """
SELECT x.application_id, x.source_file AS first_file, x.upload_seq AS first_seq, y.source_file AS second_file, y.upload_seq AS second_seq,
  greatest(x.a, y.a) AS overlap_from, least(x.b, y.b) AS overlap_to FROM spans x JOIN spans y ON x.application_id = y.application_id
  AND (x.upload_seq, x.source_file) < (y.upload_seq, y.source_file) AND greatest(x.a, y.a) <= least(x.b, y.b)"""
STEPS["upload_lines"] = "SELECT application_id, source_file, upload_seq, tx_date, amount, description, tx_type, count(*) AS n FROM uploads GROUP BY ALL"
STEPS["shared_lines"] = """
SELECT o.*, l.tx_date, l.amount, l.description, l.tx_type, l.n, 0 AS m FROM overlapping o JOIN upload_lines l ON l.application_id = o.application_id
  AND l.source_file = o.first_file AND l.upload_seq = o.first_seq AND l.tx_date BETWEEN o.overlap_from AND o.overlap_to
UNION ALL SELECT o.*, l.tx_date, l.amount, l.description, l.tx_type, 0, l.n FROM overlapping o JOIN upload_lines l ON l.application_id = o.application_id
  AND l.source_file = o.second_file AND l.upload_seq = o.second_seq AND l.tx_date BETWEEN o.overlap_from AND o.overlap_to"""
STEPS["ledger_months"] = "SELECT DISTINCT application_id, month, last_day(CAST(month || '-01' AS DATE)) AS day FROM ledger_raw"
STEPS["dated_reports"] = DATED_REPORTS
STEPS["sound_reports"] = """
SELECT * FROM dated_reports WHERE application_id % 5 <> seq QUALIFY row_number() OVER (PARTITION BY application_id, report_date ORDER BY seq DESC) = 1"""
STEPS["found"] = "SELECT * FROM found_positions"
STEPS["dated_edits"] = DATED_EDITS
STEPS["month_positions"] = "SELECT p.*, m.month, m.day FROM found_positions p JOIN ledger_months m USING (application_id)"
STEPS["edited_months"] = """
SELECT p.application_id, p.lender, p.month, p.tier, coalesce(CAST(e.payment_amount AS DECIMAL(18,2)), p.payment_amount) AS payment_amount, coalesce(e.frequency, p.frequency) AS frequency, e.removed
FROM month_positions p ASOF LEFT JOIN dated_edits e ON p.application_id = e.application_id AND p.lender = e.lender AND p.day >= e.edit_date"""
STEPS["report_fault_rows"] = """
SELECT application_id, f.field, f.fault FROM (SELECT application_id, unnest(CASE application_id % 9
    WHEN 1 THEN [{'field': NULL, 'fault': 'no JSON object'}] WHEN 6 THEN [{'field': NULL, 'fault': 'no JSON object'}] WHEN 7 THEN [{'field': NULL, 'fault': 'no JSON object'}]
    WHEN 2 THEN [{'field': 'owner_name', 'fault': 'missing'}, {'field': 'mortgage_ltv_details', 'fault': 'missing'}]
    WHEN 3 THEN [{'field': 'fico_score', 'fault': 'no int'}] WHEN 4 THEN [{'field': 'total_high_credit', 'fault': 'null'}]
    WHEN 5 THEN [{'field': 'bankruptcies_found', 'fault': 'no boolean'}, {'field': 'number_of_mortgages', 'fault': 'no int'}] ELSE [] END) AS f FROM credit_profile)"""
STEPS["notes"] = NOTES
STEPS["sparse"] = SPARSE_WORDS
# The heading in force on each printed line: the last one at or above it, in order of page and place.
STEPS["sparse_lines"] = """
SELECT file_id AS application_id, page_no, top, row_number() OVER (PARTITION BY file_id, page_no ORDER BY top) AS line_no, max(text = 'Balance') AS heading
FROM sparse GROUP BY file_id, page_no, top"""
# Bands hold from the heading line on; the balance column of a page holds for the whole page.
STEPS["sparse_state"] = """
SELECT application_id, page_no, line_no, last_value(CASE WHEN heading THEN page_no END IGNORE NULLS) OVER (PARTITION BY application_id ORDER BY page_no, line_no ROWS UNBOUNDED PRECEDING) AS bands_of,
  last_value(CASE WHEN page_heading THEN page_no END IGNORE NULLS) OVER (PARTITION BY application_id ORDER BY page_no RANGE UNBOUNDED PRECEDING) AS balance_of
FROM (SELECT *, bool_or(heading) OVER (PARTITION BY application_id, page_no) AS page_heading FROM sparse_lines)"""
_at = lambda page: f"CASE WHEN application_id % 3 = 0 AND {page} % 2 = 0 THEN 20 ELSE 0 END"
_band = lambda base, other, name: f"CAST(CASE WHEN bands_of IS NULL THEN {other} ELSE {base} + {_at('bands_of')} END AS DOUBLE) AS {name}"
STEPS["sparse_bounds"] = f"""
SELECT application_id, page_no, line_no, {_band(290, 200, 'desc_limit')}, {_band(280, 200, 'debit_min')}, {_band(385, 370, 'debit_max')}, {_band(370, 370, 'credit_min')},
  CAST(CASE WHEN balance_of IS NULL THEN 460 ELSE 470 + {_at('balance_of')} END AS DOUBLE) AS balance_x,
  CAST(CASE WHEN balance_of IS NOT NULL THEN 465 + {_at('balance_of')} WHEN bands_of IS NOT NULL THEN 455 ELSE 460 END AS DOUBLE) AS credit_max FROM sparse_state"""
_pair = "application_id, first_file, CAST(first_seq AS BIGINT) AS first_seq, second_file, CAST(second_seq AS BIGINT) AS second_seq"
_sums = ", ".join(
    _number(f"coalesce(sum(amount){condition}, 0)", name)
    for name, condition in (
        ("total", ""),
        ("gross_deposits", " FILTER (tx_type = 'credit')"),
        ("true_revenue", " FILTER (is_revenue)"),
        ("under_review", " FILTER (needs_review)"),
    )
)

QUERIES |= {
    "description_dictionary": f"""
SELECT application_id, source_file, line_no, tx_type, description, {_number('amount', 'amount')}, rule AS category,
  CASE WHEN min(tx_date) OVER (PARTITION BY description) <= DATE {_text(GROWN_AFTER)} THEN 'january' ELSE 'whole' END AS batch
FROM ledger JOIN description_rules USING (description)""",
    "daily_balances": f"SELECT application_id, CAST(day AS STRING) AS day, {_number('net', 'net')}, {_number('balance', 'balance')} FROM running",
    "balance_facts": f"""
SELECT application_id, days, {_number('avg_daily_balance', 'avg_daily_balance')}, negative_days, {_number('lowest_balance', 'lowest_balance')}, {_number('last_balance', 'last_balance')} FROM held""",
    "score_from_ledger": f"""
SELECT application_id, component, {_long('points', 'points')}, counted FROM (SELECT application_id, unnest([
  {{'component': 'daily_balance', 'points': CASE WHEN avg_true_revenue > 0 THEN {_case('avg_daily_balance / avg_true_revenue * 100', [(10, 5), (7, 4), (4, 3), (2, 2), (1, 1)], '>=')} ELSE 0 END, 'counted': TRUE}},
  {{'component': 'funding_velocity', 'points': CASE borrowing_velocity WHEN '0 in 90 Days' THEN 5 WHEN '1 in 90 Days' THEN 3 ELSE 1 END, 'counted': TRUE}},
  {{'component': 'negative_days', 'points': {_case('negative_days', [(0, 6), (3, 5), (6, 3), (10, 2), (15, 1)], '<=')}, 'counted': TRUE}}
], recursive := true) FROM answered WHERE hard_stops = '')""",
    "rerun_output": QUERIES["written_output"],
    "payer_variants": "SELECT * FROM payer_groups",
    "concentration_by_payer": f"""
SELECT application_id, {_number('CASE WHEN sum(s) > 0 THEN CAST(max(s) AS DOUBLE) / CAST(sum(s) AS DOUBLE) * 100 ELSE 0 END', 'revenue_concentration')}
FROM (SELECT l.application_id, g.payer, sum(l.amount) AS s FROM spelt l JOIN payer_groups g ON g.application_id = l.application_id AND g.payer_or_source = l.payer_or_source
  WHERE l.is_revenue GROUP BY l.application_id, g.payer) GROUP BY application_id""",
    "statement_overlap": f"""
SELECT {_pair}, CAST(overlap_from AS STRING) AS overlap_from, CAST(overlap_to AS STRING) AS overlap_to, CAST(overlap_to - overlap_from + 1 AS BIGINT) AS overlap_days FROM overlapping""",
    "repeated_entries": f"""
SELECT {_pair}, {_long('sum(n)', 'first_entries')}, {_long('sum(m)', 'second_entries')}, {_long('sum(least(n, m))', 'repeated')} FROM (
  SELECT application_id, first_file, first_seq, second_file, second_seq, sum(n) AS n, sum(m) AS m FROM shared_lines
  GROUP BY application_id, first_file, first_seq, second_file, second_seq, tx_date, amount, description, tx_type) GROUP BY application_id, first_file, first_seq, second_file, second_seq""",
    "funding_velocity": f"""
SELECT application_id, CAST(last_day AS STRING) AS last_day, {_long('fundings', 'fundings')}, {_long('most_fundings', 'most_fundings')}, borrowing_velocity FROM velocity""",
    "review_rollup": f"""
SELECT application_id, CASE WHEN grouping(payer_or_source) = 0 THEN 'payer' WHEN grouping(category) = 0 THEN 'category' WHEN grouping(month) = 0 THEN 'month' ELSE 'application' END AS level,
  month, category, payer_or_source, count(*) AS row_count, {_sums} FROM classified
GROUP BY GROUPING SETS ((application_id), (application_id, month), (application_id, category), (application_id, category, payer_or_source))""",
    "payment_runs": f"""
SELECT application_id, lender, CAST(min(tx_date) AS STRING) AS run_from, CAST(max(tx_date) AS STRING) AS run_to, count(*) AS payments, {_number('sum(payment_amount)', 'paid')}, min(tier) AS tier FROM (
  SELECT *, sum(begins) OVER (PARTITION BY application_id, lender ORDER BY tx_date, payment_amount ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN tx_date - lag(tx_date) OVER (PARTITION BY application_id, lender ORDER BY tx_date, payment_amount) <= {RUN_GAP} THEN 0 ELSE 1 END AS begins FROM unique_payments))
GROUP BY application_id, lender, run""",
    "wash_over_all_debits": """
SELECT application_id, wash AS wash_flag, CASE WHEN stops = '' THEN 'Scored' ELSE 'Decline' END AS decision, stops AS hard_stops FROM (
  SELECT application_id, wash, concat_ws(', ', CASE WHEN fraud_suspected THEN 'Suspected altered statements / fraud' END,
    CASE WHEN active_default THEN 'Active lender default or collections' END,
    CASE WHEN wash THEN 'Evidence of structural wash transactions to cover debt' END,
    CASE WHEN avg_true_revenue < 10000 THEN 'Avg True Revenue is under $10,000 policy minimum' END) AS stops FROM (
    SELECT r.*, coalesce(i.wash_override, w.round_trips >= 6, FALSE) AS wash FROM ready r LEFT JOIN application_inputs i USING (application_id)
    LEFT JOIN (SELECT application_id, sum(round_trips) AS round_trips FROM ledger_pairs GROUP BY application_id) w USING (application_id)))""",
    "profile_as_of": f"""
SELECT m.application_id, m.month, CAST(r.report_date AS STRING) AS report_date, coalesce(r.owner_name, 'Unknown') AS owner_name, {_long('coalesce(r.newer_score, 650)', 'fico_score')},
  coalesce(r.bankruptcies_found, FALSE) AS bankruptcies_found, r.report_date IS NOT NULL AS is_loaded
FROM ledger_months m ASOF LEFT JOIN sound_reports r ON m.application_id = r.application_id AND m.day >= r.report_date""",
    "position_history": f"""
SELECT application_id, lender, month, tier, {_number('payment_amount', 'payment_amount')}, frequency, {_number('CAST(payment_amount AS DOUBLE) * CAST(factor AS DOUBLE)', 'monthly_payment')}
FROM edited_months JOIN factors USING (frequency) WHERE removed IS NULL OR NOT removed""",
    "report_faults": "SELECT application_id, field, fault FROM report_fault_rows",
    "response_faults": """
SELECT application_id, 'no answers' AS fault, count(DISTINCT application_id) AS answers FROM requested WHERE application_id % 4 = 0 GROUP BY application_id
UNION ALL SELECT application_id, 'unknown category', count(*) FROM requested WHERE application_id % 4 <> 0 AND length(description) % 3 = 0 GROUP BY application_id""",
    "carried_bounds": """
SELECT application_id, CAST(page_no AS BIGINT) AS page_no, desc_limit, debit_min, debit_max, credit_min, credit_max, balance_x, min(line_no) AS first_line, max(line_no) AS last_line
FROM sparse_bounds GROUP BY application_id, page_no, desc_limit, debit_min, debit_max, credit_min, credit_max, balance_x""",
    "late_balance_column": f"""
SELECT application_id, CAST(page_no AS BIGINT) AS page_no, line_no, CAST(470 + {_shift} AS DOUBLE) AS balance_x, CAST(290 + {_shift} AS DOUBLE) AS desc_limit, CAST(370 + {_shift} AS DOUBLE) AS credit_min
FROM sparse_lines WHERE heading""",
    "unreadable_rows": f"""
SELECT application_id, 'unreadable_amount' AS code, description || ' {TOO_LARGE}' AS message, count(*) AS events FROM printed_ledger
WHERE application_id % 5 = 0 AND CAST(amount AS STRING) LIKE '%7' GROUP BY application_id, description
UNION ALL SELECT application_id, 'bad_date', substr(date_text, 1, 8) || '31', count(*) FROM printed_ledger
WHERE application_id % 5 = 1 AND substr(date_text, 6, 2) IN ('02', '04', '06') GROUP BY application_id, substr(date_text, 1, 8)
UNION ALL SELECT application_id, 'bad_date', date_text, count(*) FROM printed_ledger
WHERE application_id % 5 <> 1 AND try_cast(date_text AS DATE) IS NULL GROUP BY application_id, date_text""",
    "diagnostics_of_faults": f"""
SELECT DISTINCT application_id, CAST(NULL AS VARCHAR) AS file_name, CAST(NULL AS BIGINT) AS page_no, 'no_deposits' AS code, 'no deposit in any file' AS message
FROM text_pages WHERE application_id NOT IN (SELECT application_id FROM ledger WHERE tx_type = 'credit')
UNION ALL SELECT DISTINCT application_id, NULL, NULL, 'unreadable_label_response', '1 unreadable' FROM requested WHERE application_id % 4 = 0
UNION ALL SELECT application_id, NULL, NULL, 'report_fault', concat_ws(': ', field, fault) FROM report_fault_rows
UNION ALL SELECT application_id, second_file, NULL, 'overlap', CAST(overlap_to - overlap_from + 1 AS VARCHAR) || ' days shared with ' || first_file FROM overlapping""",
    "file_scan": f"""
SELECT application_id, file_name, {_long('upload_seq', 'upload_seq')}, sha256, CASE WHEN row_number() OVER w > 1 THEN first_value(file_name) OVER w END AS duplicate_of,
  CAST(octet_length(encode(text)) + 1 AS BIGINT) AS bytes
FROM (SELECT *, sha256(text || chr(10)) AS sha256 FROM notes) WINDOW w AS (PARTITION BY application_id, sha256 ORDER BY upload_seq, file_name)""",
}
