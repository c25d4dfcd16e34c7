"""Exchange tables with whatever labels the descriptions that no rule resolves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cashlens.functions import fixed, rules
from cashlens.functions.text import label_key
from cashlens.operators.settle import settle
from cashlens.operators.skew import first_per_key

RESPONSE_SCHEMA = "mappings array<struct<description string, category string>>"


def label_requests(ledger: DataFrame) -> DataFrame:
    """One row per unresolved description of an application, with its largest amount."""
    return (
        ledger.groupBy("application_id", "description")
        .agg(F.max("amount").alias("max_amount"))
        .withColumn("_upper", F.upper("description"))
        .withColumn("_rule", rules.rule_category(F.col("_upper")))
        .where("_rule is null")
        .drop("_upper", "_rule")
    )


def label_request_batches(requests: DataFrame, batch_size: int = 500) -> DataFrame:
    """Requests as JSON arrays of about `batch_size` descriptions, not one array per application."""
    batches = requests.groupBy("application_id").agg(
        F.ceil(F.count("*") / batch_size).alias("_batches")
    )
    spread = F.conv(F.substring(F.md5("description"), 1, 8), 16, 10).cast("long")
    item = F.struct("description", F.col("max_amount").cast("double").alias("max_amount"))
    return (
        requests.join(batches, "application_id")
        .withColumn("batch_no", spread % F.col("_batches"))
        .groupBy("application_id", "batch_no")
        .agg(
            F.count("*").alias("descriptions"),
            F.to_json(F.sort_array(F.collect_list(item))).alias("payload"),
        )
    )


def unreadable_responses(responses: DataFrame) -> DataFrame:
    """Applications and number of the responses that hold no list of answers."""
    answers = F.from_json("response", RESPONSE_SCHEMA)["mappings"]
    return responses.where(answers.isNull()).groupBy("application_id").agg(F.count("*").alias("responses"))


def response_faults(responses: DataFrame) -> DataFrame:
    """application_id, response_seq, pos, fault: answers of label responses that count as none.

    A response that holds no list of answers has one row without a position.
    """
    read = settle(responses, {"_answers": F.from_json("response", RESPONSE_SCHEMA)["mappings"]})
    listed = read.select("application_id", "response_seq", F.posexplode_outer("_answers").alias("pos", "m"))
    fault = (
        F.when(F.col("pos").isNull(), "no answers")
        .when(F.col("m.description").isNull(), "no description")
        .when(F.col("m.category").isNull(), "no category")
        .when(~F.col("m.category").isin(fixed.LABEL_CATEGORIES), "unknown category")
    )
    found = settle(listed, {"fault": fault}).where("fault is not null")
    return found.select("application_id", "response_seq", "pos", "fault")


def label_responses(responses: DataFrame) -> DataFrame:
    """Labels from JSON responses (application_id, response_seq, response); a later one wins."""
    parsed = responses.select(
        "application_id",
        "response_seq",
        F.posexplode(F.from_json("response", RESPONSE_SCHEMA)["mappings"]).alias("pos", "m"),
    ).select(
        "application_id",
        "response_seq",
        "pos",
        label_key(F.col("m.description")).alias("label_key"),
        F.col("m.category").alias("category"),
    )
    known = parsed.where(F.col("category").isin(fixed.LABEL_CATEGORIES))
    latest = [F.desc("response_seq"), F.desc("pos")]
    return first_per_key(known, ["application_id", "label_key"], latest).select(
        "application_id", "label_key", "category"
    )
