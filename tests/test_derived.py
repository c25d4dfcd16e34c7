"""Dictionaries, balances, reruns, payers, overlaps, funding and runs against brute force, with one huge key among small ones."""

import glob
import json
import os
import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cashlens.functions import fixed
from cashlens.operators import balances, classify, dictionary, funding, metrics, overlaps, payers, positions, review, skew
from cashlens.plans import staging
from cashlens.sources import credit, files, labels, sinks
from test_operators import ROW, ledger_of, skewed_apps

START = date(2023, 12, 20)


def random_ledger(rng, n, descriptions, days=200, apps=20):
    rows = []
    for app in skewed_apps(rng, n, apps):
        day = None if rng.random() < 0.05 else START + timedelta(days=rng.randint(0, days))
        amount = "5.00" if rng.random() < 0.3 else f"{rng.randint(1, 90000) / 100:.2f}"
        rows.append((app, day, rng.choice(descriptions), amount, rng.choice(["credit", "credit", "debit"])))
    return rows


# --- description dictionary --------------------------------------------------------


TEXTS = ["STRIPE PAYOUT", "MERCHPAD ADVANCE", "GST REFUND", "RETURNED ITEM NSF", "ONLINE TRANSFER", "MISC", "tf 3978#1967-174", "", "É"]


def test_second_run_sees_only_new_descriptions(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    rng = random.Random(1)
    first = ledger_of(spark, random_ledger(rng, 400, TEXTS[:5]))
    grown = first.unionByName(ledger_of(spark, random_ledger(rng, 600, TEXTS)))
    grown = grown.unionByName(grown.limit(1).withColumn("description", F.lit(None).cast("string")))
    dictionary.learn_descriptions(first, path, "one")
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*.parquet")}
    unseen = dictionary.unseen_descriptions(grown, dictionary.known_descriptions(spark, path))
    assert {r.description for r in unseen.collect()} == set(TEXTS[5:])
    dictionary.learn_descriptions(grown, path, "two")
    assert all(os.path.getmtime(f) == at for f, at in before.items())
    known = dictionary.known_descriptions(spark, path)
    batches = {r.description: r.batch for r in known.collect()}
    assert batches == {t: "one" if t in TEXTS[:5] else "two" for t in TEXTS}
    keys = ["application_id", "line_no", "description", "category"]
    by_rule = classify.rule_categories(grown).select(keys)
    by_dictionary = dictionary.categories_from_dictionary(grown, known)
    assert by_dictionary.columns == [*grown.columns, "category"]
    assert by_rule.exceptAll(by_dictionary.select(keys)).count() == 0 and by_dictionary.count() == grown.count()
    labelled = classify.classify(grown, None, known).select("line_no", "application_id", "category", "is_revenue")
    assert labelled.exceptAll(classify.classify(grown, None).select(labelled.columns)).count() == 0
    # A third run finds nothing new, and two runs at once do no harm.
    dictionary.learn_descriptions(grown, path, "three")
    spark.read.parquet(path).withColumn("batch", F.lit("zero")).write.mode("append").parquet(path + "-twice")
    spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
    assert dictionary.known_descriptions(spark, path + "-twice").count() == len(TEXTS)


def test_other_rules_make_other_entries(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "dictionary")
    ledger = ledger_of(spark, [(1, START, "MISC", "5.00", "credit"), (1, START, "NSF", "5.00", "credit")])
    assert dictionary.known_descriptions(spark, path).count() == 0
    dictionary.learn_descriptions(ledger, path)
    monkeypatch.setattr(dictionary, "rules_version", lambda: "other")
    assert dictionary.known_descriptions(spark, path).count() == 0
    dictionary.learn_descriptions(ledger.limit(0), path)
    dictionary.learn_descriptions(ledger, path)
    assert dictionary.known_descriptions(spark, path).count() == 2


# --- daily balances ----------------------------------------------------------------


def brute_balances(rows, openings):
    net = defaultdict(lambda: defaultdict(Decimal))
    for app, day, _, amount, kind in rows:
        if day is not None:
            net[app][day] += Decimal(amount) if kind == "credit" else -Decimal(amount)
    out = set()
    for app, days in net.items():
        balance, day = openings.get(app, Decimal(0)), min(days)
        while day <= max(days):
            balance += days.get(day, Decimal(0))
            out.add((app, day, days.get(day, Decimal(0)), balance))
            day += timedelta(days=1)
    return out


@pytest.mark.parametrize("block", [1, 7, 64])
def test_daily_balances(spark, monkeypatch, block):
    monkeypatch.setattr(balances, "DAYS_IN_BLOCK", block)
    rng = random.Random(block)
    rows = random_ledger(rng, 900, ["x"], days=300)
    rows += [(70, date(1969, 12, 30), "x", "1.00", "debit"), (70, date(1970, 3, 9), "x", "3.50", "credit"), (71, None, "x", "9.00", "credit")]
    openings = {0: Decimal("1000.00"), 3: Decimal("-20.10"), 99: Decimal("5.00")}
    table = spark.createDataFrame(list(openings.items()), "application_id bigint, opening decimal(18,2)")
    daily = balances.daily_balances(ledger_of(spark, rows), table)
    found = daily.collect()
    want = brute_balances(rows, openings)
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    facts = {r.application_id: r for r in balances.balance_facts(daily).collect()}
    for app in facts:
        held = [b for a, _, _, b in want if a == app]
        assert facts[app].negative_days == sum(b < 0 for b in held) and facts[app].days == len(held)
        assert facts[app].avg_daily_balance == pytest.approx(float(sum(held)) / len(held))
        assert facts[app].lowest_balance == min(held)


def test_balances_have_no_window_over_an_application(spark):
    """The only windows are over blocks of an application (one row each) and over the days of one block."""
    ledger = ledger_of(spark, [(1, START, "x", "5.00", "credit")])
    openings = spark.createDataFrame([], "application_id bigint, opening decimal(18,2)")
    plan = balances.daily_balances(ledger, openings)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    assert any("[application_id" in w and "block" in w.split("], [")[1] for w in windows)
    assert balances.daily_balances(ledger.limit(0), openings).count() == 0


def test_opening_is_that_of_the_first_file(spark):
    rows = [(1, "b", 2, "5.00"), (1, "c", 1, None), (1, "a", 2, "7.00"), (2, "x", 1, None)]
    files = spark.createDataFrame([(a, f, s, v and Decimal(v), None) for a, f, s, v in rows], "application_id bigint, file_name string, upload_seq int, opening decimal(18,2), closing decimal(18,2)")
    assert [tuple(r) for r in balances.opening_balances(files).collect()] == [(1, Decimal("7.00"))]


def test_manual_answers_win(spark):
    given = spark.createDataFrame([(1, 0, None, None, None), (1, 1, 9.0, None, "1 in 90 Days"), (2, 0, None, 4, None)], "application_id bigint, seq int, avg_daily_balance double, negative_days int, borrowing_velocity string")
    facts = spark.createDataFrame([(1, 3.0, 2), (2, 5.0, 0), (3, -1.0, 7)], "application_id bigint, avg_daily_balance double, negative_days long")
    velocity = spark.createDataFrame([(1, "2+ in 90 Days"), (4, "0 in 90 Days")], "application_id bigint, borrowing_velocity string")
    got = {tuple(r) for r in balances.answers_from_ledger(given, facts, velocity).collect()}
    assert got == {(1, 9.0, 2, "1 in 90 Days"), (2, 5.0, 4, None), (3, -1.0, 7, None), (4, None, None, "0 in 90 Days")}


# --- rerun of some applications ----------------------------------------------------


def stored(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("application_id", "v").collect())


def test_rerun_touches_only_its_buckets(spark, tmp_path):
    path, buckets = str(tmp_path / "out"), 8
    full = spark.range(300).select((F.col("id") % 60).alias("application_id"), F.col("id").cast("int").alias("v"))
    of = {r.application_id: r.b for r in full.select("application_id", sinks._bucket(buckets).alias("b")).distinct().collect()}
    chosen = [app for app, bucket in of.items() if bucket in (1, 4)][::2]
    touched = {of[app] for app in chosen}
    again = F.col("application_id").isin(chosen)
    stale = full.withColumn("v", F.when(again, -F.col("v")).otherwise(F.col("v"))).unionByName(full.where(again))
    sinks.write_output(stale, path, buckets)
    files = {b: sorted((f, os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/{sinks.BUCKET}={b}/*.parquet")) for b in range(buckets)}
    applications = spark.createDataFrame([(a,) for a in chosen], "application_id bigint")
    want = sorted(tuple(r) for r in full.collect())
    for _ in range(2):  # the second time changes nothing
        sinks.rerun_output(full.where(again), path, applications, buckets)
        assert stored(spark, path) == want
    for b in range(buckets):
        now = sorted((f, os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/{sinks.BUCKET}={b}/*.parquet"))
        assert (now == files[b]) == (b not in touched or not files[b])


def test_rerun_without_rows_empties_buckets(spark, tmp_path):
    path = str(tmp_path / "out")
    full = spark.range(3).select(F.col("id").alias("application_id"), F.lit(1).alias("v"))
    sinks.write_output(full, path, 4)
    gone = full.where("application_id = 2")
    sinks.rerun_output(full.limit(0), path, gone, 4)
    assert stored(spark, path) == [(0, 1), (1, 1)]
    sinks.rerun_output(full.limit(0), path, gone.limit(0), 4)
    new = spark.createDataFrame([(9, 5)], "application_id bigint, v int")
    sinks.rerun_output(new, path, new, 4)
    assert stored(spark, path) == [(0, 1), (1, 1), (9, 5)]
    # Rows of applications that were not run again don't get in.
    sinks.rerun_output(new.unionByName(full), path, new, 4)
    assert stored(spark, path) == [(0, 1), (1, 1), (9, 5)]


# --- payers ------------------------------------------------------------------------


def key_of(payer):
    out, word = [], ""
    for c in payer.upper() + " ":
        if c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return " ".join(out)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def similar(a, b):
    grams = [{f" {k} "[i : i + 3] for i in range(len(k))} for k in (a, b)]
    return 3 * len(grams[0] & grams[1]) >= len(grams[0]) + len(grams[1]) and edits(a, b) <= 2


def brute_payers(rows):
    of_app = defaultdict(lambda: defaultdict(int))
    for app, payer in rows:
        if payer is not None:
            of_app[app][payer] += 1
    out = set()
    for app, counts in of_app.items():
        keys = sorted({key_of(p) for p in counts} - {""})
        root = {k: k for k in keys}
        changed = True
        while changed:
            changed = False
            for a in keys:
                for b in keys:
                    if a != b and root[b] < root[a] and similar(a, b):
                        root[a], changed = root[b], True
        group = {p: root.get(key_of(p), "=" + p) for p in counts}
        for p in counts:
            same = [x for x in counts if group[x] == group[p]]
            out.add((app, p, key_of(p), min(same, key=lambda x: (-counts[x], x))))
    return out


NAMES = ["STRIPE PAYOUT", "STRIPE PAYOT", "STRIPE-PYAOUT 12", "stripe payout 99", "SHOPIFY PAYMENT", "SHOPIFY PAYMNT", "SHOPFY PAYMNT", "AB", "ABC", "A", "ÉLAN VITAL", "ELAN VITAL", "CASH", "CASE", "CAST", "", "123", "#", "ZZZZZZ", "ZZZZZZZ"]


def test_payer_variants(spark):
    rng = random.Random(8)
    rows = [(app, rng.choice([*NAMES, *NAMES[:6], None])) for app in skewed_apps(rng, 700, 12)]
    for _ in range(150):  # random names in the hot application, in chains of small changes
        name = list("MARKET STREET DELI")
        for _ in range(rng.randint(0, 5)):
            name[rng.randrange(len(name))] = rng.choice("AEM ")
        rows.append((0, "".join(name)))
    ledger = spark.createDataFrame([(a, p, n) for n, (a, p) in enumerate(rows)], "application_id bigint, payer_or_source string, line_no int")
    variants = payers.payer_variants(ledger, staging.stage)
    got = [tuple(r) for r in variants.collect()]
    assert set(got) == brute_payers(rows) and len(got) == len(set(got))
    named = payers.with_one_name(ledger, variants)
    assert named.columns == ledger.columns and named.count() == len(rows)
    assert payers.payer_variants(ledger.limit(0), staging.stage).count() == 0


def test_similar_keys_equal_all_pairs(spark):
    rng = random.Random(9)
    keys = sorted({"".join(rng.choice("AB ") for _ in range(rng.randint(1, 7))).strip() or "A" for _ in range(250)})
    table = spark.createDataFrame([(app, k) for app in (1, 2) for k in keys], "application_id bigint, key string")
    got = [tuple(r) for r in payers.similar_keys(table).collect()]
    want = {(app, a, b) for app in (1, 2) for a in keys for b in keys if a < b and similar(a, b)}
    assert set(got) == want and len(got) == len(want) > 100


def test_smallest_linked_of_a_chain(spark):
    links = [(1, f"K{i:03}", f"K{i + 1:03}") for i in range(60)] + [(2, "A", "B"), (2, "B", "C"), (1, "X", "Y")] + [(3, "HUB", f"N{i}") for i in range(80)]
    random.Random(2).shuffle(links)
    got = {(r.application_id, r.key): r.root for r in payers.smallest_linked(spark.createDataFrame(links, "application_id bigint, a string, b string"), staging.stage).collect()}
    want = {(1, f"K{i:03}"): "K000" for i in range(61)} | {(2, c): "A" for c in "ABC"} | {(1, "X"): "X", (1, "Y"): "X", (3, "HUB"): "HUB"} | {(3, f"N{i}"): "HUB" for i in range(80)}
    assert got == want


# --- overlaps, funding, runs, rollup -------------------------------------------------


def test_statement_overlap(spark):
    rng = random.Random(4)
    spans = []
    for n, app in enumerate(skewed_apps(rng, 90, 8)):
        first = START + timedelta(days=rng.randint(0, 500))
        spans.append((app, f"f{n}", rng.randint(1, 4), first, first + timedelta(days=rng.choice([0, 1, 30, 40, 400])), 1))
    table = spark.createDataFrame(spans, "application_id bigint, source_file string, upload_seq int, first_day date, last_day date, entries long")
    got = [tuple(r) for r in overlaps.statement_overlap(table).collect()]
    want = set()
    for a in spans:
        for b in spans:
            low, high = max(a[3], b[3]), min(a[4], b[4])
            if a[0] == b[0] and (a[2], a[1]) < (b[2], b[1]) and low <= high:
                want.add((a[0], a[1], a[2], b[1], b[2], low, high, (high - low).days + 1))
    assert set(got) == want and len(got) == len(want)
    plan = overlaps.statement_overlap(table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_repeated_entries(spark):
    rows = [(1, START, "x", "5.00", "credit")] * 3 + [(1, START + timedelta(days=9), "y", "5.00", "credit"), (1, None, "x", "5.00", "credit")]
    one = ledger_of(spark, rows)
    two = ledger_of(spark, rows[1:4] + [(1, START + timedelta(days=9), "z", "5.00", "credit")]).withColumns({"source_file": F.lit("g"), "upload_seq": F.lit(2)})
    three = ledger_of(spark, [(1, START + timedelta(days=99), "x", "5.00", "credit")]).withColumn("source_file", F.lit("h"))
    entries = one.unionByName(two).unionByName(three)
    spans = overlaps.file_spans(entries)
    assert spans.count() == 3
    got = overlaps.repeated_entries(entries, overlaps.statement_overlap(spans)).collect()
    assert [tuple(r) for r in got] == [(1, "f", 1, "g", 2, 4, 4, 3)]


def test_repeated_entries_by_brute_force(spark):
    """Any pairs, in either order, twice, with days of their own or of a file without a name."""
    rng = random.Random(9)
    files_of = {app: [(f"f{n % 3}", rng.choice([1, 2, None]) if app == 2 else n) for n in range(5)] for app in (1, 2, 3, None)}
    rows = []
    for app, names in files_of.items():
        for _ in range(120):
            day = None if rng.random() < 0.05 else START + timedelta(days=rng.randint(0, 6))
            rows.append((app, *rng.choice(names), day, rng.choice([1.0, 2.0, None]), rng.choice(["x", "y", None]), rng.choice(["credit", "debit"])))
    pairs = []
    for app, names in files_of.items():
        for _ in range(12):
            low = START + timedelta(days=rng.randint(-1, 5))
            pairs.append((app, *rng.choice(names), *rng.choice(names), low, low + timedelta(days=rng.randint(0, 4))))
    pairs += [*pairs[:3], (1, "f0", 0, "f1", 1, START + timedelta(days=90), START + timedelta(days=99)), (1, "f0", 0, "f1", 4, None, START)]
    table = spark.createDataFrame(rows, "application_id bigint, source_file string, upload_seq int, tx_date date, amount double, description string, tx_type string")
    asked = spark.createDataFrame(pairs, "application_id bigint, first_file string, first_seq int, second_file string, second_seq int, overlap_from date, overlap_to date")
    counts = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for app, a, a_seq, b, b_seq, low, high in pairs:
        for r in rows:
            if None in (app, low, r[3]) or r[0] != app or not low <= r[3] <= high:
                continue
            for side, file in enumerate(((a, a_seq), (b, b_seq))):
                if None not in file and r[1:3] == file:
                    counts[app, a, a_seq, b, b_seq][r[3:]][side] += 1
    want = {(*pair, sum(n for n, _ in met.values()), sum(m for _, m in met.values()), sum(min(x) for x in met.values())) for pair, met in counts.items()}
    got = [tuple(r) for r in overlaps.repeated_entries(table, asked).collect()]
    assert set(got) == want and len(got) == len(want) and any(r[-1] for r in got)


def test_funding_velocity(spark):
    rng = random.Random(6)
    rows = random_ledger(rng, 500, ["x", "x", "x", "MERCHPAD ADVANCE"], days=400, apps=60)
    rows += [(90, START, "MERCHPAD ADVANCE", "5.00", "credit"), (90, START + timedelta(days=89), "x", "5.00", "debit")]
    rows += [(91, START, "MERCHPAD ADVANCE", "5.00", "credit"), (91, START + timedelta(days=90), "x", "5.00", "debit"), (92, None, "x", "5.00", "credit")]
    category = F.when(F.col("description") == "x", "Other").otherwise(fixed.LOAN_PROCEEDS)
    got = {r.application_id: tuple(r)[1:] for r in funding.funding_velocity(ledger_of(spark, rows).withColumn("category", category)).collect()}
    days, funded = defaultdict(set), defaultdict(set)
    for app, day, text, _, kind in rows:
        if day is not None:
            days[app].add(day)
            if text != "x" and kind == "credit":
                funded[app].add(day)
    assert got.keys() == days.keys()
    for app, found in got.items():
        counts = {d: sum(timedelta(0) <= d - f < timedelta(days=90) for f in funded[app]) for d in days[app]}
        n = counts[max(days[app])]
        assert found == (max(days[app]), n, max(counts.values()), f"{n if n < 2 else '2+'} in 90 Days")
    assert got[90][1] == 1 and got[91][1] == 0


def test_payment_runs(spark):
    rng = random.Random(7)
    rows = [(app, f"L{rng.randint(0, 2)}", START + timedelta(days=rng.choice([0, 44, 45, 46, 90, 91, 92, 200, 245, 291]) + rng.randint(0, 1)), Decimal(rng.randint(1, 3)), "Standard") for app in skewed_apps(rng, 200, 30)]
    rows = sorted(set(rows))
    table = spark.createDataFrame(rows, "application_id bigint, lender string, tx_date date, payment_amount decimal(18,2), tier string")
    got = {(r.application_id, r.lender, r.run_from): (r.run_to, r.payments, r.paid) for r in positions.payment_runs(table).collect()}
    want, open_run = {}, {}
    for app, lender, day, amount, _ in rows:
        key = open_run.get((app, lender))
        if key is None or (day - want[key][0]).days > 45:
            key = open_run[app, lender] = (app, lender, day)
            want[key] = (day, 0, Decimal(0))
        want[key] = (day, want[key][1] + 1, want[key][2] + amount)
    assert got == want


def test_review_rollup(spark):
    rng = random.Random(8)
    entries = classify.classify(ledger_of(spark, random_ledger(rng, 600, TEXTS[:7])), None)
    entries = entries.withColumn("payer_or_source", F.when(F.col("line_no") % 9 > 0, F.col("payer_or_source")))
    rollup = review.review_rollup(entries)
    levels = {"application": [], "month": ["month"], "category": ["category"], "payer": ["category", "payer_or_source"]}
    for level, keys in levels.items():
        want = entries.groupBy("application_id", *keys).agg(F.count("*").alias("row_count"), F.sum("amount").alias("total")).collect()
        got = rollup.where(F.col("level") == level).select("application_id", *keys, "row_count", "total").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    plan = rollup._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert spark.createDataFrame([], ROW).count() == 0


# --- history and faults by field -------------------------------------------------------


@pytest.mark.parametrize("block", [1, 30, 366])
def test_as_of(spark, block):
    rng = random.Random(block)
    events = {(k, START + timedelta(days=rng.randint(0, 900))): rng.randint(1, 99) for k in skewed_apps(rng, 120, 6)}
    points = [(k, START + timedelta(days=rng.randint(-30, 950)), n) for n, k in enumerate(skewed_apps(rng, 300, 8))]
    points += points[:20] + [(1, None, 5), (None, START, 6)]
    known = spark.createDataFrame([(k, d, v, str(v)) for (k, d), v in events.items()] + [(1, None, 7, "x")], "k int, day date, v int, w string")
    asked = spark.createDataFrame(points, "k int, day date, n int")
    got = sorted(map(repr, (tuple(r) for r in skew.as_of(asked, known, ["k"], "day", ["v", "w"], block).collect())))
    want = []
    for k, day, n in points:
        before = [(d, v) for (e, d), v in events.items() if e == k and day is not None and d <= day]
        v = max(before)[1] if before else None
        want.append(repr((k, day, n, v, None if v is None else str(v))))
    assert got == sorted(want)


def report(**other):
    profile = {"owner_name": "A", "fico_score": 700, "total_high_credit": 1, "revolving_credit_utilization_pct": 2.5, "active_collections_count": 0,
               "total_collections_amount": 0, "bankruptcies_found": False, "number_of_mortgages": 1, "mortgage_ltv_details": "x"}
    return json.dumps({k: v for k, v in {**profile, **other}.items() if v != "absent"})


def test_report_faults(spark):
    responses = [
        report(), report(extra=[1]), "", "nope", "[1]", "null", None, '{"owner_name": "A"', report(owner_name="absent"), report(owner_name=None),
        report(fico_score="700", bankruptcies_found=1), report(fico_score=700.5), report(total_high_credit="x", number_of_mortgages="absent"), "{}",
    ]
    table = spark.createDataFrame(list(enumerate(responses)), "application_id bigint, response string")
    faults = defaultdict(set)
    for r in credit.report_faults(table).collect():
        faults[r.application_id].add((r.field, r.fault))
    none = {(None, "no JSON object")}
    assert dict(faults) == {
        **dict.fromkeys(range(2, 8), none), 8: {("owner_name", "missing")}, 9: {("owner_name", "null")},
        10: {("fico_score", "no int"), ("bankruptcies_found", "no boolean")}, 11: {("fico_score", "no int")},
        12: {("total_high_credit", "no double"), ("number_of_mortgages", "missing")}, 13: {(f, "missing") for f in credit.FIELDS},
    }
    # Reports without faults are exactly those that are read.
    assert {r.application_id for r in credit.credit_profile(table).collect()} == set(range(len(responses))) - set(faults)
    assert {r.application_id for r in credit.unreadable_reports(table).collect()} == set(faults)


def test_response_faults(spark):
    known = fixed.LABEL_CATEGORIES[0]
    rows = [
        (1, 1, json.dumps({"mappings": [{"description": "A", "category": known}, {"description": "B", "category": "other"}, {"category": known}, {"description": "C"}]})),
        (1, 2, "nope"), (2, 1, json.dumps({"mappings": []})), (3, 1, None),
    ]
    table = spark.createDataFrame(rows, "application_id bigint, response_seq int, response string")
    got = sorted(repr(tuple(r)) for r in labels.response_faults(table).collect())
    want = [(1, 1, 1, "unknown category"), (1, 1, 2, "no description"), (1, 1, 3, "no category"), (1, 2, None, "no answers"), (2, 1, None, "no answers"), (3, 1, None, "no answers")]
    assert got == sorted(map(repr, want))


def test_profile_as_of(spark):
    day = lambda text: date.fromisoformat(text)
    rows = [
        (1, 0, day("2024-01-31"), report(fico_score=500)), (1, 0, day("2024-02-10"), report(fico_score=600)), (1, 1, day("2024-02-10"), report(fico_score=610)),
        (1, 0, day("2024-03-01"), report(owner_name="absent")), (2, 0, None, report()), (3, 0, day("2025-01-01"), report()),
    ]
    table = spark.createDataFrame(rows, "application_id bigint, seq int, report_date date, response string")
    months = spark.createDataFrame([(a, m) for a in (1, 2, 3) for m in ("2023-12", "2024-01", "2024-02", "2024-03", None)] * 2, "application_id bigint, month string")
    got = {(r.application_id, r.month): (r.fico_score, r.is_loaded) for r in credit.profile_as_of(months, table).collect()}
    assert len(got) == 15 and got[1, "2023-12"] == (650, False) and got[1, "2024-01"] == (500, True)
    assert got[1, "2024-02"] == got[1, "2024-03"] == (610, True) and got[1, None] == got[2, "2024-02"] == got[3, "2024-03"] == (650, False)


def test_position_history(spark):
    found = spark.createDataFrame([(1, "A", "Standard", Decimal("10.00"), "Daily", 210.0), (1, "B", "Premium", Decimal("5.00"), "Weekly", 21.65)], "application_id bigint, lender string, tier string, payment_amount decimal(18,2), frequency string, monthly_payment double")
    months = spark.createDataFrame([(1, "2024-01"), (1, "2024-02"), (1, "2024-03"), (2, "2024-01")], "application_id bigint, month string")
    edits = [(1, "A", date(2024, 2, 1), 0, "20", None, None), (1, "A", date(2024, 2, 1), 1, "30", None, None), (1, "B", date(2024, 2, 29), 0, None, None, True), (1, "B", date(2024, 3, 1), 0, None, "Monthly", False), (1, "C", date(2024, 1, 1), 0, "9", "Daily", None)]
    table = spark.createDataFrame(edits, "application_id bigint, lender string, edit_date date, seq int, payment_amount string, frequency string, removed boolean")
    got = {(r.lender, r.month): (r.payment_amount, r.frequency) for r in positions.position_history(found, months, table).collect()}
    assert got == {
        ("A", "2024-01"): (Decimal("10.00"), "Daily"), ("A", "2024-02"): (Decimal("30.00"), "Daily"), ("A", "2024-03"): (Decimal("30.00"), "Daily"),
        ("B", "2024-01"): (Decimal("5.00"), "Weekly"), ("B", "2024-03"): (Decimal("5.00"), "Monthly"),
    }


def test_wash_flags_from_elsewhere_reach_the_metrics(spark):
    entries = classify.classify(ledger_of(spark, [(1, START, "x", "5.00", "credit"), (2, START, "x", "5.00", "credit")]), None)
    none = spark.createDataFrame([], "application_id bigint, lender string, tier string, payment_amount decimal(18,2), frequency string, monthly_payment double")
    washes = spark.createDataFrame([(1, 6, True)], "application_id bigint, round_trips bigint, wash_detected boolean")
    flags = lambda found: {r.application_id: (r.wash_round_trips, r.wash_flag) for r in found.collect()}
    assert flags(metrics.metrics(entries, none)) == {1: (0, False), 2: (0, False)}
    assert flags(metrics.metrics(entries, none, washes)) == {1: (6, True), 2: (0, False)}


def test_files_are_written_and_scanned(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [(1, "a.pdf", 1, "one"), (1, "a=b/c #%é.pdf", 2, "one"), (1, "7_a.pdf", 3, "two\nlines"), (2, "empty", 1, None), (2, "a.pdf", 2, "one")]
    files.write_files(spark.createDataFrame(rows, "application_id bigint, file_name string, upload_seq int, text string"), path)
    found = files.scan_files(spark, path)
    got = sorted((r.application_id, r.file_name, r.upload_seq, bytes(r.content).decode(), r.bytes) for r in found.collect())
    assert got == sorted((a, f, s, (t or "") + "\n", len((t or "").encode()) + 1) for a, f, s, t in rows)
    unique = {(r.application_id, r.upload_seq): r.duplicate_of for r in files.file_dedup(files.file_hashes(found)).collect()}
    assert unique == {(1, 1): None, (1, 2): "a.pdf", (1, 3): None, (2, 1): None, (2, 2): None}
    # Sizes come from the listing: no content is read for them, and other applications' folders are left out.
    listed = found.where("application_id = 2").select("file_name", "bytes")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("Output")[0] and "PartitionFilters: [isnotnull(application_id" in plan
    assert listed.count() == 2
