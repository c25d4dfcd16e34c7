"""Hand-made statements, and the whole run on derived ones."""

from pyspark.sql import functions as F

from cashlens.operators import layout, rows
from cashlens.plans import pipeline, staging
from cashlens.plans.extract import extract, text_lines
from cashlens.plans.inputs import WORDS, Inputs

SF = "/root/testdata/sf0.001"


def tables(spark, statements, texts):
    """statements: {(file, page): [[(x, word), ...] per line]}; texts: {file: text}."""
    words, seq = [], 0
    for (file, page), lines in statements.items():
        for n, line in enumerate(lines):
            for x, word in line:
                seq += 1
                words.append((1, file, page, seq, float(x), 50.0 + 14 * n, word))
    schema = "application_id bigint, file_name string, page_no int, word_seq int, x0 double, top double, text string"
    pages = [(1, f, 1, t) for f, t in texts.items()]
    return (
        spark.createDataFrame(words, schema),
        spark.createDataFrame(pages, "application_id bigint, file_name string, page_no int, text string"),
    )


def read(spark, statements, texts):
    found = extract(*tables(spark, statements, texts)).rows.orderBy("file_name", "page_no", "line_no")
    return [
        (r.file_name, r.date_text, r.description, r.debit and float(r.debit), r.credit and float(r.credit))
        for r in found.collect()
    ]


def line(*words):
    return list(words)


HEAD = line((40, "Date"), (100, "Description"), (300, "Withdrawn"), (400, "Deposited"), (500, "Balance"))


def test_carried_date_columns_and_bounds(spark):
    statement = {
        ("a", 1): [
            line((100, "BEFORE"), (400, "1.00")),  # no date yet
            HEAD,
            line((40, "05"), (60, "Jan"), (100, "7"), (120, "RENT"), (300, "10.00"), (500, "99.00")),
            line((100, "7"), (120, "SALE"), (150, "7"), (400, "1,234.50"), (495, "99.00")),
            line((100, "FEES"), (130, "PAID"), (160, "Feb"), (190, "9"), (400, "5.00")),  # noise, date not taken
            line((100, "NO"), (120, "AMOUNT")),
            line((100, "TOTAL"), (400, "8.00")),  # a summary: fewer than 3 words
            line((100, "A"), (120, "TOTAL"), (150, "LOSS"), (400, "8.00")),
            line((100, "Closing"), (400, "8.00")),
        ],
        # Page 2 has no heading: bounds and date come from page 1; 485 lies above its credit bound.
        ("a", 2): [line((100, "NEXT"), (400, "2.00"), (486, "3.00")), line((40, "1"), (60, "Mar"), (400, "4.00"))],
        # Another file starts anew: default bounds and its own year.
        ("b", 1): [line((40, "3"), (60, "Apr"), (210, "5.00"), (380, "6.00"), (459, "7.00"), (460, "8.00"))],
    }
    assert read(spark, statement, {"a": "year 2019", "b": "none"}) == [
        ("a", "2019-01-05", "RENT", 10.0, None),
        ("a", "2019-01-05", "SALE 7", None, 1234.5),
        ("a", "2019-01-05", "A TOTAL LOSS", None, 8.0),
        ("a", "2019-01-05", "NEXT", None, 2.0),
        ("a", "2019-03-01", "", None, 4.0),
        ("b", "2026-04-03", "", 5.0, 7.0),  # joined credit words read 6.007.00: the last amount counts
    ]


def test_overlapping_bands_favour_debit_and_gate_needs_next_line(spark):
    statement = {
        ("a", 1): [
            # "payments" and "deposits" calibrate only because the next line says "credit".
            line((300, "Payments"), (400, "Deposits")),
            line((100, "Credit"), (130, "union")),
            line((40, "1"), (60, "May"), (100, "X"), (385, "9.00")),  # 380-395: both bands
        ],
        ("b", 1): [
            line((300, "Payments"), (400, "Deposits")),
            line((100, "Other"), (130, "union")),
            line((40, "1"), (60, "May"), (100, "X"), (385, "9.00")),  # default bounds: credit from 370
        ],
    }
    assert read(spark, statement, {"a": "2020", "b": "2020"}) == [
        ("a", "2020-05-01", "X", 9.0, None),
        ("b", "2020-05-01", "X", None, 9.0),
    ]


def test_numeric_layout(spark):
    statement = {
        ("n", 1): [
            HEAD,
            line((40, "03"), (60, "|"), (75, "15"), (95, "|"), (110, "12"), (140, "VENTE"), (280, "1.00"), (380, "2.00")),
            line((100, "SUITE"), (400, "3.00")),
            line((40, "04"), (60, "31"), (100, "BAD"), (380, "4.00")),
        ]
    }
    text = {"n": "Banque Nationale 2021"}
    assert read(spark, statement, text) == [
        ("n", "2021-03-15", "12 VENTE", 1.0, 2.0),
        ("n", "2021-03-15", "SUITE", None, 3.0),
        ("n", "2021-04-31", "BAD", None, 4.0),
    ]
    found = extract(*tables(spark, statement, text)).rows.where("date_text = '2021-04-31'").collect()
    assert [(r.tx_date, r.month) for r in found] == [(None, "2021-04")]


def test_entries(spark):
    schema = (
        "application_id bigint, file_name string, page_no int, line_no int, upload_seq int, date_text string, "
        "tx_date date, month string, description string, debit decimal(18,2), credit decimal(18,2)"
    )
    from decimal import Decimal as D

    base = (1, "f", 1, 1, 1, "2024-01-01", None, "2024-01")
    df = spark.createDataFrame(
        [
            (*base, "", None, D(5)), (*base, "NSF FEE", D(30), None), (*base, "NSF FEE", D(31), D(2)),
            (*base, "NSF OVERDRAWN", D(99), None), (*base, "RENT", D(40), D(0)), (*base, "VAULT", D(7), None),
        ],
        schema,
    )
    got = sorted((r.description, float(r.amount), r.payer_or_source, r.tx_type) for r in rows.ledger_rows(df).collect())
    assert got == [
        ("Deposit", 5.0, "Deposit", "credit"), ("NSF FEE", 2.0, "NSF FEE", "credit"), ("NSF FEE", 31.0, "Bank Fee", "debit")
    ]
    parts = rows.credit_rows(df).unionByName(rows.nsf_debit_rows(df))
    assert parts.exceptAll(rows.ledger_rows(df)).count() == 0
    assert [r.lender for r in rows.lender_debits(df).collect()] == ["VAULT"]
    assert float(rows.file_debit_total(df).collect()[0].debit_total) == 30 + 31 + 99 + 40 + 7


def test_one_pass_words_equal_their_sql(spark):
    inputs = Inputs(spark, SF)
    inputs.ledger.createOrReplaceTempView("ledger")
    sql = spark.sql(WORDS)
    assert sql.count() == inputs.words.count()
    assert sql.exceptAll(inputs.words).count() == 0


def test_hot_file_is_not_one_partition(spark, monkeypatch):
    """One file with a third of all lines, cut into page blocks, gives the same rows."""
    inputs = Inputs(spark, SF)
    one = F.when(F.col("application_id") % 3 == 0, 0).otherwise(F.col("application_id"))
    place = F.col("page_no") + F.when(one == 0, F.col("application_id") * 1000).otherwise(0)
    words = inputs.statement_words.withColumn("page_no", place.cast("int")).withColumn("application_id", one.cast("long"))
    pages = words.select("application_id", "file_name").distinct().select("*", F.lit(1).alias("page_no"), F.lit("2024").alias("text"))
    columns = ["application_id", "page_no", "line_no", "date_text", "description", "debit", "credit"]
    whole = extract(words, pages).rows.select(columns)
    monkeypatch.setattr(layout, "PAGES_PER_BLOCK", 2)
    assert whole.exceptAll(extract(words, pages).rows.select(columns)).count() == 0
    assert whole.count() == inputs.ledger.count()


def test_pipeline_writes_all_outputs(spark, tmp_path):
    i = Inputs(spark, SF)
    keep = "application_id < 40"
    text = F.concat("application_id", F.lit("-"), F.lit(1)).cast("binary")
    files = i.statement_text.where(keep).select("application_id", "file_name").distinct()
    files = files.select("*", F.lit(1).alias("upload_seq"), text.alias("content"))
    copies = files.select("application_id", F.lit("copy").alias("file_name"), F.lit(2).alias("upload_seq"), "content")
    words = i.statement_words.where(keep)
    run = pipeline.Tables(
        # Words of the copies must not be read again.
        words=words.unionByName(words.withColumns({"file_name": F.lit("copy"), "upload_seq": F.lit(2)})),
        pages=i.statement_text.where(keep).unionByName(
            i.statement_text.where(keep).withColumns({"file_name": F.lit("copy"), "upload_seq": F.lit(2)})
        ),
        inputs=i.application_inputs.where(keep),
        credit_profile=i.credit_profile.where(keep),
        files=files.unionByName(copies),
    )
    outputs = pipeline.run(
        spark, run, wash_on_all_debits=True, answers_from_ledger=True, dictionary_path=f"{tmp_path}-dictionary"
    )
    pipeline.write(outputs, str(tmp_path))
    back = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in outputs}
    assert set(back) == {
        "ledger", "positions", "reconciliation", "category_summary", "review_kpis", "monthly_summary",
        "scorecard", "score_components", "diagnostics", "label_requests", "label_request_batches",
        "review_rollup", "daily_balances", "balance_facts", "payment_runs",
    }
    expected = i.ledger.where(keep).where("tx_type = 'credit' or (description like 'NSF%' and amount > 30)")
    assert back["ledger"].count() == expected.dropDuplicates(["application_id", "tx_date", "amount", "description", "tx_type"]).count()
    assert back["scorecard"].count() == 40
    matched = back["reconciliation"].where("application_id % 7 < 4 and status = 'Matched'")
    printed = expected.where("tx_type = 'credit' and application_id % 7 < 4").select("application_id").distinct()
    assert matched.count() == printed.count()
    # Round trips among all debits reach the decision: who has six is stopped, whatever the narrower ledger shows.
    flagged = {r.application_id for r in back["diagnostics"].where("code = 'wash'").collect()}
    overridden = {r.application_id for r in i.application_inputs.where("wash_override is not null").collect()}
    stopped = {r.application_id for r in back["scorecard"].where("wash_flag").collect()}
    assert flagged - overridden == stopped
    # Balances run over the whole statement, from the printed opening balance.
    held = {r.application_id: r for r in back["balance_facts"].collect()}
    totals = i.ledger.where(keep).groupBy("application_id").agg(
        F.sum(F.when(F.col("tx_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))).alias("net")
    )
    # Printed years without a 29 February leave that day's rows undated, so without a place in the balances.
    for r in totals.where("application_id % 9 in (2, 6)").collect():
        opening = {4: 1000, 5: 9_000_000}.get(r.application_id % 7, 0)
        assert held[r.application_id].last_balance == opening + r.net
    codes = {r.code for r in back["diagnostics"].select("code").distinct().collect()}
    assert {"duplicate_file", "calibrated", "anchor_found", "anchor_missing", "bad_date"} <= codes


def test_staging_uses_the_shared_folder(spark):
    named = spark.conf.get(staging.SETTING, None)
    folder = staging.staging_dir(spark)
    assert folder == named or named is None
    df = staging.stage_bucketed(spark.range(10).repartition("id"), "numbers", ["id"])
    assert sum(r.id for r in df.collect()) == 45
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(df.inputFiles()) <= buckets
    assert all(folder in file for file in df.inputFiles())
    # The bucketed side of a join on its keys is not shuffled again.
    plan = df.join(spark.range(5).hint("shuffle_hash"), "id")._jdf.queryExecution().toString()
    assert plan.split("Physical Plan")[1].count("Exchange hashpartitioning") == 1
    staging.forget_staged(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(staging.PREFIX)]


def test_lines_take_one_shuffle_of_the_words(spark):
    inputs = Inputs(spark, SF)
    words = staging.stage(inputs.statement_words, "words")
    plan = text_lines(words)._jdf.queryExecution().executedPlan().toString()
    # The one that brings pages together.
    assert plan.count("Exchange hashpartitioning") == 1


def test_branches_share_the_shuffles_of_words_and_page_states(spark):
    i = Inputs(spark, SF)
    found = extract(i.statement_words, i.statement_text, staged=False).rows
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [text for text in plan.split("\n") if "REPARTITION_BY_COL" in text]
    reused = [text for text in dealt if "ReusedExchange" in text]
    assert len(dealt) == 4 and len(reused) == 2
    for key in ("page_no", "_block"):
        assert sum(f"{key}#" in text.split("hashpartitioning(")[1].split(")")[0] for text in reused) == 1


def test_words_without_a_page_belong_to_none(spark):
    words, pages = tables(spark, {("a", 1): [line((40, "05"), (60, "Jan"), (100, "RENT"), (300, "10.00"))]}, {"a": "x"})
    astray = words.withColumn("page_no", F.lit(None).cast("int")).unionByName(words.withColumn("file_name", F.lit(None).cast("string")))
    want = extract(words, pages, staged=False)
    found = extract(words.unionByName(astray), pages, staged=False)
    assert found.lines.count() == want.lines.count() == 1
    assert found.rows.collect() == want.rows.collect()
