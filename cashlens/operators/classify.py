"""Categories and flags of ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cashlens.functions import fixed, rules
from cashlens.functions.text import label_key
from cashlens.operators.dictionary import categories_from_dictionary
from cashlens.operators.skew import latest_per_key


def rule_categories(ledger: DataFrame) -> DataFrame:
    """Adds `category` by rule; null where no rule applies."""
    upper = ledger.withColumn("_upper", F.upper("description"))
    return upper.withColumn("category", rules.rule_category(F.col("_upper"))).drop("_upper")


def apply_labels(ledger: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Unresolved rows take their label, else they are sent to review.

    `labels` has label_key and category, application_id if labels differ by application, and seq
    if a key may be answered again: the answer with the highest number counts. Categories outside
    the list are no answers.
    No broadcast hint: Spark broadcasts the labels when they are small, and otherwise sorts
    and merges, splitting a hot description at run time.
    """
    unidentified = F.lit(fixed.UNIDENTIFIED)
    if labels is None:
        return ledger.withColumn("category", F.coalesce("category", unidentified))
    keys = [k for k in ("application_id", "label_key") if k in labels.columns]
    known = labels.where(F.col("category").isin(fixed.LABEL_CATEGORIES))
    lookup = latest_per_key(known, keys).select(*keys, F.col("category").alias("_label"))
    return (
        ledger.withColumn("label_key", label_key(F.col("description")))
        .join(lookup, keys, "left")
        .select(
            *[c for c in ledger.columns if c != "category"],
            F.coalesce("category", "_label", unidentified).alias("category"),
        )
    )


def revenue_flags(ledger: DataFrame) -> DataFrame:
    return ledger.withColumns(
        {
            "is_revenue": F.col("category").startswith("True Revenue"),
            "needs_review": F.col("category").startswith("Review Required"),
        }
    )


def pos_override(ledger: DataFrame) -> DataFrame:
    """Card processors and marketplaces are revenue, whatever any earlier rule said."""
    hit = rules.is_processor(F.col("description"), F.col("_upper"))
    return (
        ledger.withColumn("_upper", F.upper("description"))
        .withColumn("_pos", F.coalesce(hit, F.lit(False)))
        .withColumns(
            {
                "category": F.when(F.col("_pos"), fixed.POS_REVENUE).otherwise(F.col("category")),
                "is_revenue": F.col("_pos") | F.col("is_revenue"),
                "needs_review": ~F.col("_pos") & F.col("needs_review"),
            }
        )
        .drop("_pos", "_upper")
    )


def classify(ledger: DataFrame, labels: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Rules, labels, flags, processor override, in this order.

    The rules run row by row in the scan's own stage, or come from a dictionary that has learnt
    the ledger's descriptions (`dictionary.known_descriptions`): that saves the regular
    expressions of descriptions seen in earlier runs, for a join by description.
    """
    categorised = rule_categories(ledger) if known is None else categories_from_dictionary(ledger, known)
    return pos_override(revenue_flags(apply_labels(categorised, labels)))
