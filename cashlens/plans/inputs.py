"""Engine inputs derived from the general test tables, as SQL that Spark and DuckDB both run.

Each view builds on the tables and on earlier views. `views()` registers them on Spark; the
oracle uses the same text as leading CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cashlens.operators.skew import PARTS, spread_partitions

TABLES = ["customer", "supplier", "orders", "lineitem", "documents", "conversations"]

#: Transaction lines on a printed page: statements have several pages, so that states are carried between them.
LINES = 12

# An application is a customer. Spans of dates and descriptions differ by customer, so that every step of the ladders
# further down occurs: payments daily to monthly, no lender to several, one month of revenue to six, few to many round
# trips. Every 29th customer pays in evenly and growing, month by month.
_CREDIT = """CASE WHEN o_custkey % 10 = 1 AND o_orderkey % 2 = 0 THEN 'TF 3978#1967-174' ELSE CASE {0} % 12 WHEN 0 THEN 'STRIPE PAYOUT'
   WHEN 1 THEN 'MONERIS VI1234 SETTLE' WHEN 2 THEN 'BRANCH CASH DEPOSIT' WHEN 3 THEN 'CHEQUE DEPOSIT CUSTOMER' WHEN 4 THEN 'E-TRANSFER FROM CLIENT'
   WHEN 5 THEN 'TF 3978#1967-174' WHEN 6 THEN 'GST REFUND' WHEN 7 THEN 'RETURNED ITEM NSF' WHEN 8 THEN 'MERCHPAD ADVANCE'
   WHEN 9 THEN 'PROVINCE OF ONTARIO' WHEN 10 THEN 'SHOPIFY PAYMENT' ELSE 'MISC CREDIT' END END"""
LEDGER = f"""
SELECT o_custkey AS application_id, 'orders' AS source_file, o_orderkey AS line_no,
  DATE '2024-01-01' + CAST((o_orderkey * 37 + o_custkey) % (CASE o_custkey % 7 WHEN 0 THEN 25 ELSE 180 END) AS INT) AS tx_date, 'credit' AS tx_type,
  CAST((CAST(round(o_totalprice * 100) AS BIGINT) % 3000000) * (CASE o_custkey % 3 WHEN 0 THEN 0.04 ELSE 0.01 END) AS DECIMAL(18,2)) AS amount,
  {_CREDIT.format('o_orderkey')} AS description
FROM orders WHERE o_custkey % 29 <> 0
UNION ALL
SELECT o_custkey, 'orders', o_orderkey * 10 + m.n, DATE '2024-01-05' + CAST(30 * m.n + o_orderkey % 20 AS INT), 'credit',
  CAST((2000000 + CAST(round(o_totalprice * 100) AS BIGINT) % 3000000) * (100 + 4 * m.n) / 10000 AS DECIMAL(18,2)),
  CASE WHEN o_custkey % 58 = 0 THEN 'STRIPE PAYOUT ' || CAST(o_orderkey AS STRING) ELSE {_CREDIT.format('(o_orderkey + o_custkey)')} END
FROM orders CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS m(n) WHERE o_custkey % 29 = 0
UNION ALL
SELECT o_custkey, 'lineitem', l_orderkey * 10 + l_linenumber,
  DATE '2024-01-01' + CAST((l_orderkey * 31 + l_linenumber * 7) % (CASE o_custkey % 6 WHEN 0 THEN 12 WHEN 1 THEN 40 WHEN 2 THEN 90 ELSE 180 END) AS INT), 'debit',
  CAST(100 + (l_suppkey % 5) * 50 AS DECIMAL(18,2)),
  CASE WHEN o_custkey % 58 = 0 THEN 'HYDRO BILL' WHEN o_custkey % 10 = 1 AND l_suppkey % 20 > 12 THEN 'TF 3978#1967-174 OUT'
   WHEN o_custkey % 8 = 0 THEN CASE WHEN l_suppkey % 20 < 9 THEN 'HYDRO BILL' ELSE 'RENT' END
   WHEN l_suppkey % 20 < 9 THEN 'PAD MERCHPAD 0042' WHEN o_custkey % 8 < 3 THEN 'HYDRO BILL' WHEN l_suppkey % 20 < 12 THEN 'PAD GREEN BOX' WHEN l_suppkey % 20 = 12 THEN 'ONDECK PMT'
   WHEN l_suppkey % 20 = 13 THEN 'LOAN PAYMENT 77' WHEN l_suppkey % 20 = 14 THEN 'NSF FEE TF 3978#1967-174'
   WHEN l_suppkey % 20 = 15 AND o_custkey % 8 > 5 THEN 'PAD BIZ FUND' ELSE 'HYDRO BILL' END
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

# The ledger as extraction delivers it: credits, and returned-item debits over the fee limit.
LEDGER_RAW = """
SELECT application_id, tx_date, substr(CAST(tx_date AS STRING), 1, 7) AS month, description, amount,
  CASE WHEN tx_type = 'credit' THEN description ELSE 'Bank Fee' END AS payer_or_source, tx_type, source_file,
  CASE source_file WHEN 'orders' THEN 1 ELSE 2 END AS upload_seq, 1 AS page_no, line_no
FROM ledger WHERE tx_type = 'credit' OR (description LIKE 'NSF%' AND amount > 30)
"""

# Some pages print their columns further right.
SHIFT = "CASE WHEN {0} % 3 = 0 AND page_no % 2 = 0 THEN 20 ELSE 0 END"
WORDS = f"""
WITH ln AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY tx_date, source_file, line_no, amount, description) AS n FROM ledger),
lk AS (SELECT *, n - min(n) OVER (PARTITION BY application_id, tx_date) + 1 AS k FROM ln),
pg AS (SELECT application_id AS file_id, CAST(floor((n - 1) / {LINES}) AS INT) + 1 AS page_no, CAST(100 + ((n - 1) % {LINES}) * 14 AS DOUBLE) AS top, k, tx_date, tx_type, amount, description FROM lk)
SELECT file_id, 'stmt' AS file_name, 1 AS upload_seq, page_no, top, x0 + {SHIFT.format('file_id')} AS x0, text FROM (
SELECT file_id, page_no, top, CAST(40 AS DOUBLE) AS x0, CASE substr(CAST(tx_date AS STRING), 6, 2) WHEN '01' THEN 'Jan' WHEN '02' THEN 'Feb' WHEN '03' THEN 'Mar' WHEN '04' THEN 'Apr' WHEN '05' THEN 'May' ELSE 'Jun' END AS text FROM pg WHERE k = 1
UNION ALL SELECT file_id, page_no, top, CAST(60 AS DOUBLE), substr(CAST(tx_date AS STRING), 9, 2) FROM pg WHERE k = 1
UNION ALL SELECT file_id, page_no, top, CAST(90 AS DOUBLE), split_part(description, ' ', 1) FROM pg
UNION ALL SELECT file_id, page_no, top, CAST(140 AS DOUBLE), split_part(description, ' ', 2) FROM pg WHERE split_part(description, ' ', 2) <> ''
UNION ALL SELECT file_id, page_no, top, CAST(190 AS DOUBLE), split_part(description, ' ', 3) FROM pg WHERE split_part(description, ' ', 3) <> ''
UNION ALL SELECT file_id, page_no, top, CAST(240 AS DOUBLE), split_part(description, ' ', 4) FROM pg WHERE split_part(description, ' ', 4) <> ''
UNION ALL SELECT file_id, page_no, top, CAST(CASE WHEN tx_type = 'debit' THEN 305 ELSE 395 END AS DOUBLE), CAST(amount AS STRING) FROM pg
UNION ALL SELECT file_id, page_no, top, CAST(490 AS DOUBLE), '99999.99' FROM pg
UNION ALL SELECT DISTINCT file_id, page_no, CAST(60 AS DOUBLE), h.x0, h.text FROM pg CROSS JOIN (VALUES (CAST(40 AS DOUBLE), 'Date'), (CAST(90 AS DOUBLE), 'Description'), (CAST(300 AS DOUBLE), 'Withdrawn'), (CAST(390 AS DOUBLE), 'Deposited'), (CAST(480 AS DOUBLE), 'Balance')) AS h(x0, text)) AS printed
"""

# A word's place on the page numbers it: positions are unique in `words`.
STATEMENT_WORDS = """
SELECT file_id AS application_id, file_name, upload_seq, page_no, CAST(top * 1000 + x0 AS INT) AS word_seq, x0, top, text FROM words
"""

# Some words printed twice, a hair to the right, with padding; some blank ones.
PRINTED_TWICE = """
SELECT application_id, file_name, upload_seq, page_no, word_seq, x0, top, text FROM statement_words
UNION ALL
SELECT application_id, file_name, upload_seq, page_no, word_seq + 1000000, x0 + 0.02, top, ' ' || text FROM statement_words WHERE page_no % 3 = 0 AND x0 < 300
UNION ALL
SELECT application_id, file_name, upload_seq, page_no, word_seq + 2000000, x0, top, '  ' FROM statement_words WHERE page_no % 5 = 0
"""

LABEL_MAPPINGS = """
SELECT * FROM (VALUES ('BRANCH CASH DEPOSIT', 'True Revenue - Verified Cash'),
  ('CHEQUE DEPOSIT CUSTOMER', 'True Revenue - Customer Payment / Cheque'),
  ('E-TRANSFER FROM CLIENT', 'True Revenue - B2B E-Transfer')) AS t(description, category)
"""

ANCHORS = """
SELECT application_id, CAST(CASE WHEN application_id % 10 = 9 THEN 0 ELSE sum(amount) + CASE application_id % 3 WHEN 1 THEN 1.50 WHEN 2 THEN 25.00 ELSE 0.00 END END AS DOUBLE) AS expected_credits
FROM ledger WHERE tx_type = 'credit' GROUP BY application_id
"""

CREDIT_PROFILE = """
SELECT c_custkey AS application_id, c_name AS owner_name, CAST(CASE WHEN c_custkey % 58 = 0 THEN 780 ELSE 480 + (c_custkey * 7) % 320 END AS INT) AS fico_score,
  abs(c_acctbal) AS total_high_credit, CAST(c_custkey % 101 AS DOUBLE) AS revolving_credit_utilization_pct,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 3 ELSE 0 END AS INT) AS active_collections_count,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 3 * 100 ELSE 0 END AS DOUBLE) AS total_collections_amount,
  c_custkey % 19 = 0 AS bankruptcies_found, CAST(c_custkey % 4 AS INT) AS number_of_mortgages,
  'Property values not reported' AS mortgage_ltv_details
FROM customer WHERE c_custkey % 11 <> 0
"""

APPLICATION_INPUTS = """
SELECT c_custkey AS application_id, CAST(CASE WHEN c_custkey % 58 = 0 THEN 120 ELSE c_custkey % 100 END AS INT) AS months_in_business,
  abs(c_acctbal) * (CASE WHEN c_custkey % 58 = 0 THEN 20 ELSE 1 END) AS avg_daily_balance,
  CAST(NULL AS INT) AS credit_score, CAST(CASE WHEN c_custkey % 58 = 0 THEN 0 ELSE c_custkey % 20 END AS INT) AS negative_days,
  CAST(NULL AS STRING) AS public_records,
  CASE WHEN c_custkey % 58 = 0 THEN '0 in 90 Days' WHEN c_custkey % 3 = 0 THEN '0 in 90 Days' WHEN c_custkey % 3 = 1 THEN '1 in 90 Days' ELSE '2+ in 90 Days' END AS borrowing_velocity,
  CASE WHEN c_custkey % 58 = 0 OR c_custkey % 4 = 0 THEN 'Bank Connect' WHEN c_custkey % 4 = 1 THEN 'Original PDF' WHEN c_custkey % 4 = 2 THEN 'Minor inconsistency' ELSE 'Suspected manipulation' END AS bank_verification,
  CAST(CASE WHEN c_custkey % 58 = 0 THEN 61 ELSE c_custkey % 70 + 1 END AS INT) AS industry_rank, c_custkey % 17 = 0 AS fraud_suspected, c_custkey % 23 = 0 AS active_default,
  CASE WHEN c_custkey % 2 = 0 THEN FALSE END AS wash_override
FROM customer
"""

# One text page per application and month; the application number picks what the bank prints.
_CENTS = "CAST({0} * 100 AS BIGINT)"
_PRINTED = (
    "CAST(CAST(floor({0} / 100000) AS BIGINT) AS STRING) || ',' || "
    "lpad(CAST(CAST(floor(({0} % 100000) / 100) AS BIGINT) AS STRING), 3, '0') || '.' || "
    "lpad(CAST({0} % 100 AS STRING), 2, '0')"
)
_NL = "chr(10)"
STATEMENT_TEXT = f"""
WITH t AS (SELECT application_id, CAST(substr(CAST(tx_date AS STRING), 6, 2) AS INT) AS page_no,
  {_CENTS.format("sum(CASE WHEN tx_type = 'credit' THEN amount ELSE 0 END)")} AS c, {_CENTS.format("sum(CASE WHEN tx_type = 'debit' THEN amount ELSE 0 END)")} AS d
  FROM ledger GROUP BY application_id, CAST(substr(CAST(tx_date AS STRING), 6, 2) AS INT)),
p AS (SELECT application_id, page_no, {_PRINTED.format("c")} AS credits, {_PRINTED.format("d")} AS debits FROM t)
SELECT application_id, 'stmt' AS file_name, 1 AS upload_seq, page_no,
  '  Statement ' || CAST(2018 + application_id % 9 AS STRING) || {_NL} || CASE application_id % 7
    WHEN 0 THEN 'Total amounts credited ($) + ' || credits
    WHEN 1 THEN 'CLOSING totals' || {_NL} || debits || '  ' || credits
    WHEN 2 THEN 'Total deposits & credits (12)' || {_NL} || '+ ' || credits
    WHEN 3 THEN 'Amounts deposited: ' || credits
    WHEN 4 THEN 'Opening balance on page one: $1,000.00' || {_NL} || 'Closing balance = $500,000.00'
    WHEN 5 THEN 'Balance forward 9,000,000.00' || {_NL} || 'Current Balance: CA$10.00'
    ELSE 'BANQUE NATIONALE du pays' END || {_NL} AS text
FROM p
"""

# Ten documents are the files of an application. Some are uploaded again: under their own name, under another name without
# a number, under another name with the same number; and some names are used again for another text.
STATEMENT_FILES = """
WITH d AS (SELECT CAST(floor(doc_id / 10) AS BIGINT) AS application_id, 'doc-' || CAST(doc_id AS STRING) AS file_name, CAST(doc_id % 10 AS INT) AS upload_seq, text, doc_id % 7 AS way FROM documents)
SELECT application_id, file_name, upload_seq, text FROM d
UNION ALL SELECT application_id, file_name, upload_seq + 20, text FROM d WHERE way = 0
UNION ALL SELECT application_id, 'copy of ' || file_name, CAST(NULL AS INT), text FROM d WHERE way = 1
UNION ALL SELECT application_id, 'again ' || file_name, upload_seq, text FROM d WHERE way = 2
UNION ALL SELECT application_id, file_name, upload_seq + 20, text || '.' FROM d WHERE way = 3
"""
# Texts in pages: the turns of a conversation. Some files come twice under one name.
TEXT_PAGES = """
WITH c AS (SELECT CAST(floor(conv_id / 10) AS BIGINT) AS application_id, 'conv-' || CAST(conv_id AS STRING) AS file_name, conv_id, CAST(turn AS INT) AS page_no, text FROM conversations)
SELECT application_id, file_name, 1 AS upload_seq, page_no, text FROM c
UNION ALL SELECT application_id, file_name, 2, page_no, text FROM c WHERE conv_id % 7 = 0
UNION ALL SELECT application_id, file_name, 3, page_no, ' ' FROM c WHERE conv_id % 7 = 1
"""
# Printed lines of statements: transactions, and lines that no row may come of.
PRINTED_LINES = """
SELECT application_id, source_file, line_no, CASE line_no % 11 WHEN 0 THEN 'Account/Transaction Type ' || description WHEN 1 THEN 'Total fees paid 12.00'
  WHEN 2 THEN 'TOTAL 1,200.00' WHEN 3 THEN 'TOTAL of the page 1,200.00' WHEN 4 THEN 'Opening balance' WHEN 5 THEN 'Balance forward ' || CAST(amount AS STRING)
  WHEN 6 THEN 'next statement ' || description ELSE description || ' ' || CAST(amount AS STRING) END AS line FROM ledger
"""

VIEWS = {
    "ledger": LEDGER,
    "ledger_raw": LEDGER_RAW,
    "words": WORDS,
    "statement_words": STATEMENT_WORDS,
    "printed_twice": PRINTED_TWICE,
    "label_mappings": LABEL_MAPPINGS,
    "anchors": ANCHORS,
    "credit_profile": CREDIT_PROFILE,
    "application_inputs": APPLICATION_INPUTS,
    "statement_text": STATEMENT_TEXT,
    "statement_files": STATEMENT_FILES,
    "text_pages": TEXT_PAGES,
    "printed_lines": PRINTED_LINES,
}


def words_in_one_pass(ledger: DataFrame, **marks: Callable[[list[Column]], Column]) -> DataFrame:
    """The `words` view as Spark should build it: the ledger is numbered once, not per column.

    `marks` are further columns: each tells of a printed line, from the texts of its words, what all these words then carry.
    Made while the line is one row, they need no window over the words.

    A file's name and number are columns, as tables have them, by passing through the arrays: Catalyst folds constants out
    of keys, and then finds neither the partitioning by page nor a shuffle to use again.
    """
    order = ["tx_date", "source_file", "line_no", "amount", "description"]
    per_app = Window.partitionBy("application_id")
    # Entries are narrow beside the words they print: a quarter of the partitions that words get holds them.
    ledger = ledger.repartition(spread_partitions(ledger) // PARTS, "application_id")
    numbered = ledger.withColumn("n", F.row_number().over(per_app.orderBy(*order)))
    first_of_day = F.col("n") == F.min("n").over(Window.partitionBy("application_id", "tx_date"))
    part = F.split("description", " ")

    def word(x0, text):
        return F.struct(x0.cast("double").alias("x0"), text.alias("text"))

    def described(place: int, x0: int):
        text = F.get(part, F.lit(place))
        return F.when(text != "", word(F.lit(x0), text))

    printed = [
        F.when(F.col("first_of_day"), word(F.lit(40), F.date_format("tx_date", "MMM"))),
        F.when(F.col("first_of_day"), word(F.lit(60), F.date_format("tx_date", "dd"))),
        *[described(place, 90 + 50 * place) for place in range(4)],
        word(
            F.when(F.col("tx_type") == "debit", 305).otherwise(395), F.col("amount").cast("string")
        ),
        word(F.lit(490), F.lit("99999.99")),
    ]
    told = [mark([w["text"] for w in printed]).alias(name) for name, mark in marks.items()]
    headings = {40: "Date", 90: "Description", 300: "Withdrawn", 390: "Deposited", 480: "Balance"}
    heading = F.array(*[word(F.lit(x0), F.lit(text)) for x0, text in headings.items()])
    lines = numbered.withColumn("first_of_day", first_of_day).select(
        F.col("application_id").alias("file_id"),
        (F.floor((F.col("n") - 1) / LINES).cast("int") + 1).alias("page_no"),
        (100 + (F.col("n") - 1) % LINES * 14).cast("double").alias("top"),
        F.array(*printed).alias("printed"),
        *told,
    )
    of_heading = [mark([F.lit(text) for text in headings.values()]).alias(name) for name, mark in marks.items()]
    file = [F.lit("stmt").alias("file_name"), F.lit(1).alias("upload_seq")]
    places = F.array(
        F.struct(*file, "top", *marks, F.col("printed").alias("w")),
        F.struct(*file, F.lit(60.0).alias("top"), *of_heading, heading.alias("w")),
    )
    # The first line of a page also prints the page's headings.
    shown = F.when(F.col("top") == 100, places).otherwise(F.slice(places, 1, 1))
    return (
        lines.select("file_id", "page_no", F.inline(shown))
        .select("file_id", "file_name", "upload_seq", "page_no", "top", *marks, F.inline("w"))
        # A word has a place. Picked out of their arrays, those that are none would keep this step from being compiled.
        .where("x0 is not null")
        .select(
            "file_id", "file_name", "upload_seq", "page_no", "top", (F.col("x0") + F.expr(SHIFT.format("file_id"))).alias("x0"), "text", *marks
        )
    )


class Inputs:
    """The input tables of one scale directory, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._sf_dir = sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._table(name) if name in TABLES else self._view(name)
        return self._known[name]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        if name == "words":
            return words_in_one_pass(self.ledger)
        for source in set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", VIEWS[name])):
            if source in VIEWS or source in TABLES:
                getattr(self, source).createOrReplaceTempView(source)
        return self.spark.sql(VIEWS[name])
