"""What keeps big tables within a task's and the driver's memory: read off plans of small tables."""

from __future__ import annotations


import datetime
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from cashlens.operators import balances, lines, overlaps, payers, rows, skew
from cashlens.plans import derived, staging
from cashlens.plans.extract import text_lines
from cashlens.plans.inputs import Inputs, words_in_one_pass
from cashlens.sources import files



def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def inputs(spark, tmp_path):
    orders = [(k, k % 3 + 1, 100.0 + k) for k in range(1, 40)]
    items = [(k, n, k + n) for k in range(1, 40) for n in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    return Inputs(spark, str(tmp_path))


def test_payers_go_to_no_driver(spark):
    rows = [(1, f"{name} {k}") for k in range(3) for name in ("MAPLE FOODS", "MAPLE FOOD", "ACORN")]
    ledger = spark.createDataFrame(rows, "application_id long, payer_or_source string")
    staged = []

    def stage(df, name):
        staged.append(plan_of(df))
        return staging.stage(df, name)

    found = payers.payer_variants(ledger, stage)
    named = payers.with_one_name(ledger, found)
    assert {r.payer for r in named.select(F.col("payer_or_source").alias("payer")).distinct().collect()} == {"ACORN 0", "MAPLE FOOD 0"}
    plans = [*staged, plan_of(found), plan_of(named)]
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


def test_days_between_entries_are_not_shuffled(spark):
    """Days are made after the last exchange: entries are grouped and sorted, days are not."""
    day = datetime.date(2024, 1, 1)
    rows = [(1, day, 10.0, "credit"), (1, day + datetime.timedelta(200), 4.0, "debit"), (None, day, 1.0, "credit")]
    ledger = spark.createDataFrame(rows, "application_id long, tx_date date, amount double, tx_type string")
    openings = spark.createDataFrame([(1, 5.0)], "application_id long, opening double")
    found = balances.daily_balances(ledger.withColumn("amount", F.col("amount").cast("decimal(18,2)")), openings.withColumn("opening", F.col("opening").cast("decimal(28,2)")))
    plan = plan_of(found)
    # From the top down: the days come before any exchange, grouping or window.
    assert plan.index("Generate explode(sequence(day_no") < min(plan.index(step) for step in ("Exchange", "HashAggregate", "Window"))
    back = {(r.application_id, r.day): (float(r.net), float(r.balance)) for r in found.collect()}
    assert len(back) == 202
    assert back[1, day] == (10, 15) and back[1, day + datetime.timedelta(100)] == (0, 15)
    assert back[1, day + datetime.timedelta(200)] == (-4, 11) and back[None, day] == (1, 1)


def test_words_keep_their_file_when_they_are_changed(spark, inputs):
    """A file's name is a column, so that the words of a page are shuffled once, however many branches follow."""
    for changed in (derived.sparse_words(inputs), derived.placed_words(inputs, derived.SPARSE_WORDS)):
        plan = plan_of(lines.line_grouping(lines.word_dedup(changed)))
        assert sum("page_no#" in text for text in plan.split("\n") if "Exchange hashpartitioning" in text) == 1
        assert "stmt AS file_name" not in plan


def test_words_are_sorted_not_hashed(spark, inputs):
    """No hash table holds the words of a partition, and partitions are not merged by their size in the shuffle."""
    plan = plan_of(lines.word_dedup(inputs.statement_words))
    assert plan.split("REPARTITION_BY_NUM")[0].count("Aggregate") == 0


def test_files_are_made_by_several_tasks(spark, tmp_path):
    texts = spark.createDataFrame([(1, f"f{k}", k, "x") for k in range(40)], "application_id long, file_name string, upload_seq int, text string")
    files.write_files(texts.coalesce(1), f"{tmp_path}/out")
    made = [p.name for p in (tmp_path / "out").rglob("part-*")]
    assert len(made) == 40 and len({name.split("-")[1] for name in made}) > 4


def test_pairs_of_files_meet_their_entries_in_one_join(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(1, "a", 1, day, 5.0, "X", "credit"), (1, "b", 2, day, 5.0, "X", "credit"), (1, "b", 2, day, 6.0, "Y", "credit")]
    ledger = spark.createDataFrame(rows, "application_id long, source_file string, upload_seq int, tx_date date, amount double, description string, tx_type string")
    pairs = spark.createDataFrame([(1, "a", 1, "b", 2, day, day)], "application_id long, first_file string, first_seq int, second_file string, second_seq int, overlap_from date, overlap_to date")
    found = overlaps.repeated_entries(ledger, pairs)
    assert plan_of(found).count("Join") == 1
    (row,) = found.collect()
    assert (row.first_entries, row.second_entries, row.repeated) == (1, 2, 1)


def test_partitions_grow_with_the_files_read(spark, inputs, monkeypatch):
    """Tasks hold no more words, and no more entries, of a larger input."""
    session = skew.spread_partitions(spark.range(3))
    assert skew.read_bytes(spark.range(3)) == 0
    assert session == skew.PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = skew.read_bytes(inputs.words)
    files = {file for table in (inputs.orders, inputs.lineitem) for file in table.inputFiles()}
    assert read == sum(Path(unquote(urlparse(file).path)).stat().st_size for file in files)
    monkeypatch.setattr(skew, "PART_BYTES", read // (5 * session))
    wanted = skew.spread_partitions(inputs.words)
    assert wanted >= 5 * session
    words = Inputs(spark, inputs._sf_dir).statement_words
    plan = plan_of(lines.word_dedup(words))
    assert f"page_no#{plan.split('page_no#')[1].split(',')[0]}" in plan
    assert f", {wanted}), REPARTITION_BY_NUM" in plan and f", {wanted // skew.PARTS}), REPARTITION_BY_NUM" in plan


def test_files_with_spaces_are_measured(spark, tmp_path):
    path = f"{tmp_path}/a b%20c"
    spark.range(9).write.parquet(path)
    assert skew.read_bytes(spark.read.parquet(path)) == sum(p.stat().st_size for p in Path(path).glob("part-*"))


def test_words_of_a_page_are_sorted_twice(spark, inputs):
    """Once for copies, once for lines: lines, with all their words, are never sorted again."""
    plan = plan_of(text_lines(inputs.statement_words)).split("REPARTITION_BY_NUM")[0]
    assert plan.count("Sort [") == 2


def test_lines_of_odd_places_keep_their_order(spark):
    tops = [float("nan"), 20.0, None, float("inf"), float("-inf"), 10.0, 1e300, -0.0, 0.0, -1.0]
    rows = [(1, "f", 1, 1, n, 5.0 + n, top, f"w{n}") for n, top in enumerate(tops)]
    schema = "application_id bigint, file_name string, upload_seq int, page_no int, word_seq int, x0 double, top double, text string"
    found = lines.line_grouping(lines.word_dedup(spark.createDataFrame(rows, schema)))
    assert [r.line for r in found.orderBy("line_no").collect()] == ["w2", "w4", "w7 w8 w9", "w5", "w1", "w3 w6", "w0"]


def test_staging_leaves_the_setting_of_writers(spark):
    before = spark.conf.get(staging.WRITERS)
    staging.stage_bucketed(spark.range(10).repartition(3, "id"), "numbers", ["id"], 3)
    assert spark.conf.get(staging.WRITERS) == before


def test_kinds_of_short_words(spark):
    texts = ["12", "123", "1,", "a.b", "-", "x", "12\u2028", "\u0661\u0662"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    kinds = [r.kind for r in df.select("n", lines.word_kind(F.col("text")).alias("kind")).orderBy("n").collect()]
    digit, amount, short = lines.HAS_DIGIT, lines.AMOUNT_LIKE, lines.SHORT_NUMBER
    assert kinds == [digit + amount + short, digit + amount, digit + amount, amount, amount, 0, digit + amount + short, 0]


def test_partitions_grow_with_the_rows_read(spark, tmp_path, monkeypatch):
    """Rows that repeat take little of a file and as much of a task as others."""
    path = f"{tmp_path}/{{a}} [b]*?/k=1"
    spark.range(20_000).selectExpr("'same' AS text").repartition(3).write.parquet(path)
    other = spark.range(500).withColumn("n", F.lit(1))
    other.write.parquet(f"{tmp_path}/other")
    read = spark.read.option("__globPaths__", "false").parquet(path)
    both = read.select("text").unionByName(spark.read.parquet(f"{tmp_path}/other").select(F.col("id").cast("string").alias("text")))
    assert skew.read_rows(read) == 20_000 and skew.read_rows(both) == 20_500
    assert skew.read_rows(spark.range(3)) == 0
    monkeypatch.setattr(skew, "PART_ROWS", 500)
    assert skew.read_bytes(both) < skew.PART_BYTES and skew.spread_partitions(both) == 41


def test_texts_of_entries_are_shuffled_once(spark):
    """Pairs of files meet days and counts, so that neither amounts nor descriptions travel again, in partitions that grow."""
    rows = [(1, "a", 1, datetime.date(2024, 1, 1), 5.0, "X", "credit")]
    ledger = spark.createDataFrame(rows, "application_id long, source_file string, upload_seq int, tx_date date, amount double, description string, tx_type string")
    pairs = overlaps.statement_overlap(overlaps.file_spans(ledger))
    plan = plan_of(overlaps.repeated_entries(ledger, pairs))
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    parts = skew.spread_partitions(ledger)
    assert sum(f", {parts}), REPARTITION_BY_NUM" in line for line in exchanges) == 6
    assert not any("description" in line for line in exchanges)


def test_rows_with_faults_are_made_once(spark, inputs, monkeypatch):
    """Both kinds of events read a table of the rows that have a fault; the words know of their line's month without a window."""
    staged = {}
    stage = staging.stage

    def kept(df, name):
        staged[name] = plan_of(df)
        return stage(df, name)

    monkeypatch.setattr(staging, "stage", kept)
    pages = [(1, "stmt", 1, 1, "Statement 2021")]
    pages = spark.createDataFrame(pages, "application_id long, file_name string, upload_seq int, page_no int, text string")
    inputs._known["statement_text"] = pages
    plan = plan_of(derived.unreadable_rows(inputs))
    assert "Join" not in plan and "Join" in staged["faulty_rows"]
    words = words_in_one_pass(inputs.ledger, short=derived.names_short_month)
    assert plan_of(words).count("Window [") == plan_of(inputs.words).count("Window [")
    assert words.columns == [*inputs.words.columns, "short"]
    line = ["file_id", "page_no", "top"]
    by_line = inputs.words.groupBy(*line).agg(F.max(F.col("text").isin("Feb", "Apr", "Jun")).alias("want"))
    told = words.join(by_line, line)
    assert told.where("short <> want or short is null").count() == 0 and told.count() == words.count() == inputs.words.count()
    assert {r.want for r in by_line.collect()} == {True, False}


def test_descriptions_begin_at_their_first_word(spark):
    """What stands before the first accepted word is left out, without a search that throws an exception for every row."""
    words = [[1, 2, 5], [5, 1], [1, 2], [], [1, 5, 1, 5]]
    found = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "n int, w array<int>")
    column = rows._from_first(F.col("w"), lambda w: w == 5)
    assert "array_position" not in str(column)
    assert [r.w for r in found.select("n", column.alias("w")).orderBy("n").collect()] == [[5], [5, 1], [], [], [5, 1, 5]]


def test_files_are_made_and_read_in_batches(spark, tmp_path, monkeypatch):
    """No job makes or lists more than some files, however many there are, and settings are left as they were."""
    supplier = spark.range(40).selectExpr("id AS s_suppkey", "cast(id % 3 AS int) AS s_nationkey", "concat('S#', id) AS s_name")
    supplier.write.parquet(f"{tmp_path}/supplier.parquet")
    read = []
    scan, keep = files.scan_files, [files.LISTING, files.KEPT_LISTINGS]
    monkeypatch.setattr(files, "scan_files", lambda *a: read.append(scan(*a)) or read[-1])
    before = [spark.conf.get(name) for name in keep]
    whole = derived.file_scan(Inputs(spark, str(tmp_path))).collect()
    assert len(whole) == 54 and len(read) == 1
    monkeypatch.setattr(files, "BATCH_FILES", 10)
    found = derived.file_scan(Inputs(spark, str(tmp_path)))
    assert "binaryFile" not in plan_of(found) and "SortMergeJoin" in plan_of(found)
    assert sorted(found.collect()) == sorted(whole)
    sizes = [len(one.inputFiles()) for one in read[1:]]
    assert len(sizes) == 6 and sum(sizes) == 54 and max(sizes) < 20
    assert [spark.conf.get(name) for name in keep] == before
