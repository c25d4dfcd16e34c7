"""Column expressions against literal tables and against Python's own regular expressions."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from cashlens.functions import dates, fixed, money, rules
from cashlens.operators import anchors
from cashlens.sources.dimensions import INDUSTRIES, lender_list


def evaluate(spark, schema, values, expression):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {schema}")
    return [r[0] for r in df.orderBy("n").select(expression(F.col("v"))).collect()]


def test_parse_money(spark):
    cases = {
        "$1,234.56": 1234.56, "(1,234.56)": -1234.56, "1.234,56": 1234.56, "1234,56": 1234.56,
        "1,234": 1234.0, "1,234,56": None, "abc": None, "": None, "(-5)": 5.0, "((7))": -7.0,
        "-(12)": None, " $ 12 ": 12.0, "1.2.3": None, ".5": 0.5, "+4": 4.0, "-3,50": -3.5,
        "1.234.567,89": 1234567.89, "12,": 12.0,
    }
    assert evaluate(spark, "string", list(cases), money.parse_money) == list(cases.values())


def test_money_from_words(spark):
    cases = [
        (["12.00"], "12.00"), (["-12.00"], "12.00"), (["(12.00)"], "12.00"), (["-(12.00)"], ""),
        (["1.234,56"], "1.23"), (["1,234.56", "7.01"], "7.01"), (["1,23"], "1.23"),
        (["1,234,56"], ""), (["1,234"], "1234"), (["12"], None), (["123"], "123"),
        (["$1,2", "34.10"], "1234.10"), ([], None), (["x"], None),
    ]
    got = evaluate(spark, "array<string>", [c[0] for c in cases], money.money_from_words)
    assert [g or None for g in got] == [c[1] or None for c in cases]


def test_line_date(spark):
    cases = {
        "05 Jan 2024 RENT": "2024-01-05", "5 jan 24 RENT": "2024-01-05", "5 FEB RENT": "2022-02-05",
        "RENT Mar 7": "2022-03-07", "05 Jan 150.00": "20150-01-05", "31 Feb X": "2022-02-31",
        "RENT 5 Jan": None, "x": None, "Jan 5 Feb 6": "2022-01-05", "12 Dec 3": "2022-12-12",
    }

    def text(line):
        date = dates.line_date(line)
        return F.when(date.isNotNull(), dates.date_text(date, F.lit("2022")))

    assert evaluate(spark, "string", list(cases), text) == list(cases.values())
    assert evaluate(spark, "string", ["2022-02-31", "20150-01-05", "2024-02-29"], dates.calendar_date) == [
        None, None, dt.date(2024, 2, 29)
    ]


def test_numeric_date_and_year(spark):
    lines = ["03 15 X", "| 03 | 15 X", "13 01 X", "03 32 X", "3 15"]
    found = evaluate(spark, "string", lines, lambda v: dates.numeric_line_date(v)["day"])
    assert found == ["15", "15", None, None, None]
    texts = ["from 2014 to 2016 and 2020", "no. 12019", "2030", ""]
    assert evaluate(spark, "string", texts, dates.statement_year) == ["2016", "2026", "2026", "2026"]


def descriptions():
    words = [v for _, _, names in lender_list() for v in names]
    words += ["TF 3978#1967-174", "TF3978 # 196-1745", "ONLINE  TRANSFER", "BR. 123", "BR12", "GST", "HSTX"]
    words += ["CRA", "PAD CCRA", "NSF", "RETURNED ITEM", "UNPAID", "REVERSE", "LOAN PAYMENT", "PROVINCE OF"]
    words += ["Stripe", "square", "SQ *SHOP", "vi1234", "xVI1234", "MC12345", "toaster", "Ubér", "ﬁserv"]
    words += ["RENT", "é", "C.M.C.A.", "C.M.C.A.X", "1234-5678-901 1005", "Ésimply", "simplyé", "ſquare"]
    rng = random.Random(7)
    return [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(3000)]


def test_rules_match_python_regex(spark):
    texts = descriptions()

    def category(text):
        upper = text.upper()
        groups = [
            (fixed.INTERNAL_TRANSFER_PATTERNS, fixed.INTERNAL_TRANSFER),
            (fixed.GOVERNMENT_PATTERNS, fixed.GOVERNMENT),
            (fixed.NSF_PATTERNS, fixed.REVERSAL),
            ([r"\b" + re.escape(v) + r"\b" for _, _, n in lender_list() for v in n], fixed.LOAN_PROCEEDS),
        ]
        return next((c for patterns, c in groups if any(re.search(p, upper) for p in patterns)), None)

    assert evaluate(spark, "string", texts, lambda v: rules.rule_category(F.upper(v))) == [
        category(t) for t in texts
    ]
    processor = re.compile(fixed.POS_PATTERN, re.IGNORECASE)
    assert evaluate(spark, "string", texts, lambda v: rules.is_processor(v, F.upper(v))) == [
        bool(processor.search(t)) for t in texts
    ]


def test_lender_of_takes_first_listed(spark):
    texts = [t.upper() for t in descriptions()]

    def lender(text):
        for name, tier, variants in lender_list():
            if any(re.search(r"\b" + re.escape(v) + r"\b", text) for v in variants):
                return name, tier
        return ("Generic Loan/MCA", "Standard") if re.search(fixed.GENERIC_LOAN_PATTERN, text) else None

    got = evaluate(spark, "string", texts, lambda v: rules.lender_of("v"))
    assert [g and tuple(g) for g in got] == [lender(t) for t in texts]
    assert evaluate(spark, "string", texts, rules.may_pay_lender) == [lender(t) is not None for t in texts]


def test_transfer_refs(spark):
    texts = ["x tf 3978 # 1967-1745 y", "TF123#456#789TF1234567-012", "TF12#345-678", "TF3978#1967-174"]
    found = evaluate(
        spark, "string", texts, lambda v: rules.contained_transfer_refs(rules.transfer_text(v))
    )
    assert [sorted(f) for f in found] == [
        ["TF3978#1967-174", "TF3978#1967-1745"],
        ["TF123#456#789", "TF1234567-012"],
        [],
        ["TF3978#1967-174"],
    ]


def test_frequency_and_monthly(spark):
    rows = [(1, None, "Monthly"), (2, 2.0, "Daily"), (2, 2.5, "2-3x Weekly"), (9, 8.0, "Weekly"),
            (3, 15.0, "Bi-Weekly"), (3, 15.5, "Monthly")]
    df = spark.createDataFrame(rows, "p int, g double, want string")
    assert df.where(rules.payment_frequency("p", "g") != F.col("want")).count() == 0
    amounts = [("100", "Daily", 2100.0), ("100", "Weekly", 433.0), ("n/a", "Daily", 0.0), (None, "x", 0.0)]
    df = spark.createDataFrame(amounts, "a string, f string, want double")
    assert df.where(F.abs(rules.monthly_equivalent("a", "f") - F.col("want")) > 1e-9).count() == 0


@pytest.mark.parametrize(
    "text,method,total",
    [
        ("Total amounts credited ($) + 1,234.50\ntotal AMOUNTS credited ($) 0.50", "amounts_credited", 1235.0),
        ("Closing totals 5\n10.00\n20.00  99.00", "closing_totals", 20.0),
        ("Total deposits & credits (3)\n\n+ 7.25", "deposits_and_credits", 7.25),
        ("Amounts deposited: 3.00 Total credits 4.00", "explicit_total", 7.0),
        ("Total deposits\n3.00", None, None),
        ("Total credits 0.00", "explicit_total", 0.0),
    ],
)
def test_anchor_families(spark, text, method, total):
    got = evaluate(spark, "string", [text], anchors.anchor_of)[0]
    assert (got and got.method, got and float(got.total)) == (method, total)


def test_balances(spark):
    # A day number after "on" hides the amount; the next phrase counts.
    hidden = "Opening balance on 1st: $1,000.00\nBALANCE FORWARD 5.00"
    assert float(evaluate(spark, "string", [hidden], anchors.opening_balance)[0]) == 5.0
    text = "Opening balance on Jan: $1,000.00\nBALANCE FORWARD 5.00\nCurrent Balance: CA$7.00"
    assert float(evaluate(spark, "string", [text], anchors.opening_balance)[0]) == 1000.0
    assert float(evaluate(spark, "string", [text], anchors.closing_balance)[0]) == 7.0
    assert evaluate(spark, "string", ["Opening balance 1-2.00"], anchors.opening_balance) == [None]


def test_dimension_sizes(spark):
    from cashlens.sources import dimensions

    assert len(INDUSTRIES) == dimensions.industries(spark).count() == 70
    assert dimensions.lenders(spark).count() == 78
    assert dimensions.rules(spark).count() == 20
