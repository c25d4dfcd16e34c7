"""The whole run: statement words, texts and files to scorecards, for all applications at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cashlens.operators import (
    anchors,
    balances,
    classify,
    diagnostics,
    dictionary,
    funding,
    ledger,
    metrics,
    overlaps,
    positions,
    review,
    rows,
    scorecard,
    summary,
    wash,
)
from cashlens.operators.lines import FILE
from cashlens.plans.extract import extract
from cashlens.plans.staging import stage
from cashlens.sources import credit, dimensions, files, labels, sinks
from cashlens.sources import words as word_source


@dataclass
class Tables:
    """Inputs. Optional ones may be None; see the README for their columns.

    `credit_reports` and `label_responses` are raw JSON answers: with them, profiles and labels are
    read from there, and unreadable ones are reported.
    """

    words: DataFrame
    pages: DataFrame
    inputs: DataFrame
    credit_profile: DataFrame | None = None
    files: DataFrame | None = None
    labels: DataFrame | None = None
    row_overrides: DataFrame | None = None
    group_overrides: DataFrame | None = None
    position_overrides: DataFrame | None = None
    credit_reports: DataFrame | None = None
    label_responses: DataFrame | None = None


def run(
    spark: SparkSession,
    tables: Tables,
    score_mode: str = "reference",
    wash_on_all_debits: bool = False,
    answers_from_ledger: bool = False,
    dictionary_path: str | None = None,
) -> dict[str, DataFrame]:
    """Output tables by name.

    What several outputs read is staged once: files, lines, statement rows, ledger, positions.
    `staging.forget_staged` deletes it when the outputs are written. `wash_on_all_debits` looks for
    round trips among all credits and debits instead of the ledger's narrower choice, for the events
    and the decision. `answers_from_ledger` takes daily balance, negative days and borrowing velocity
    from the statements where the manual answers leave them open. `dictionary_path` names a
    dictionary of descriptions that runs share: the rules then run on descriptions new to it.
    """
    profiles, given = tables.credit_profile, tables.labels
    if tables.credit_reports is not None:
        profiles = credit.credit_profile(tables.credit_reports)
    if tables.label_responses is not None:
        given = labels.label_responses(tables.label_responses)
    registry = None
    if tables.files is not None:
        registry = stage(files.file_dedup(files.file_hashes(tables.files)), "files")
    found = extract(tables.words, tables.pages, registry)
    statement_rows = stage(found.rows, "rows")
    raw = rows.ledger_rows(statement_rows)

    deposits = stage(ledger.ledger_dedup(raw), "deposits")
    known = None
    if dictionary_path is not None:
        dictionary.learn_descriptions(deposits, dictionary_path)
        known = dictionary.known_descriptions(spark, dictionary_path)
    entries = classify.classify(deposits, given, known)
    if tables.row_overrides is not None:
        entries = review.row_override(entries, tables.row_overrides)
    entries = stage(entries, "ledger")
    if tables.group_overrides is not None:
        entries = stage(review.group_override(entries, tables.group_overrides), "reviewed")

    payments = rows.lender_debits(statement_rows)
    lenders = positions.positions(payments)
    if tables.position_overrides is not None:
        lenders = positions.position_overrides(lenders, tables.position_overrides)
    lenders = stage(lenders, "positions")

    file_totals = stage(
        anchors.implied_anchor(
            anchors.file_anchors(found.texts), rows.file_debit_total(statement_rows)
        ),
        "anchors",
    )
    uploaded = files.numbered(tables.pages).select(*FILE).distinct()
    if registry is not None:
        uploaded = files.numbered(registry.where("duplicate_of is null")).select(*FILE)
    expected = anchors.expected_credits(file_totals, uploaded)

    washes = wash.wash_flags(wash.wash_pairs(rows.all_rows(statement_rows) if wash_on_all_debits else entries))
    all_metrics = metrics.metrics(entries, lenders, washes)
    requests = labels.label_requests(deposits)
    full_ledger = rows.all_rows(statement_rows)
    daily = stage(balances.daily_balances(full_ledger, balances.opening_balances(file_totals)), "balances")
    facts = balances.balance_facts(daily)
    inputs = tables.inputs
    if answers_from_ledger:
        inputs = stage(balances.answers_from_ledger(inputs, facts, funding.funding_velocity(entries)), "answers")
    spans = overlaps.statement_overlap(overlaps.file_spans(full_ledger))
    events = [
        diagnostics.files_without_text(files.numbered(tables.pages), files.file_text(tables.pages)),
        diagnostics.pages_without_words(
            word_source.pages_without_words(files.numbered(tables.pages), files.numbered(tables.words))
        ),
        diagnostics.calibrations(found.lines),
        diagnostics.anchor_events(file_totals),
        diagnostics.unreadable_amounts(statement_rows),
        diagnostics.bad_dates(statement_rows),
        diagnostics.removed_rows(ledger.removed_duplicates(raw)),
        diagnostics.wash_events(washes),
        diagnostics.no_deposits(uploaded, entries),
        diagnostics.overlapping_files(spans),
    ]
    if tables.credit_reports is not None:
        events.append(diagnostics.unreadable("credit", credit.unreadable_reports(tables.credit_reports)))
        events.append(diagnostics.field_faults(credit.report_faults(tables.credit_reports)))
    if tables.label_responses is not None:
        events.append(diagnostics.unreadable("label", labels.unreadable_responses(tables.label_responses)))
    if registry is not None:
        events.append(diagnostics.duplicate_files(registry))
    return {
        "ledger": entries,
        "positions": lenders,
        "reconciliation": review.reconcile(entries, expected).join(
            expected.drop("expected_credits"), "application_id", "left"
        ),
        "category_summary": review.category_payer_summary(entries),
        "review_kpis": review.review_kpis(entries),
        "review_rollup": review.review_rollup(entries),
        "daily_balances": daily,
        "balance_facts": facts,
        "payment_runs": positions.payment_runs(positions.lender_debit_dedup(payments)),
        "monthly_summary": summary.monthly_summary(summary.ledger_months(entries), lenders),
        "scorecard": scorecard.scorecard(
            all_metrics, inputs, profiles, dimensions.industries(spark), score_mode
        ),
        "score_components": scorecard.score_components(
            scorecard.hard_stops(
                scorecard.underwriting_inputs(
                    all_metrics, inputs, profiles, dimensions.industries(spark)
                )
            )
        ),
        "diagnostics": diagnostics.union_events(*events),
        "label_requests": requests,
        "label_request_batches": labels.label_request_batches(requests),
    }


def write(outputs: dict[str, DataFrame], path: str) -> None:
    for name, df in outputs.items():
        sinks.write_output(df, f"{path}/{name}")
