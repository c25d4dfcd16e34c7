"""Credit reports as extracted JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cashlens.functions import fixed
from cashlens.operators.skew import as_of, latest_per_key

REPORT_SCHEMA = (
    "owner_name string, fico_score int, total_high_credit double, "
    "revolving_credit_utilization_pct double, active_collections_count int, "
    "total_collections_amount double, bankruptcies_found boolean, number_of_mortgages int, "
    "mortgage_ltv_details string"
)
FIELDS = list(fixed.CREDIT_DEFAULTS)


def credit_profile(reports: DataFrame) -> DataFrame:
    """One profile per application from reports (application_id, response, seq if several).

    Every field is required, reports without one are no reports; the last of the others counts.
    """
    return latest_per_key(_parsed(reports).dropna(how="any", subset=FIELDS), ["application_id"]).drop("seq")


def _parsed(reports: DataFrame, kept: list[str] | None = None) -> DataFrame:
    sequence = (["seq"] if "seq" in reports.columns else []) + (kept or [])
    report = F.from_json("response", REPORT_SCHEMA)
    return reports.select("application_id", *sequence, report.alias("r")).select(
        "application_id", *sequence, *[F.col(f"r.{name}").alias(name) for name in FIELDS]
    )


def unreadable_reports(reports: DataFrame) -> DataFrame:
    """Applications and number of the reports that `credit_profile` can't use."""
    missing = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in FIELDS])
    return _parsed(reports).where(missing).groupBy("application_id").agg(F.count("*").alias("responses"))


def report_faults(reports: DataFrame) -> DataFrame:
    """application_id, (seq,) field, fault: what keeps a report from being one, field by field.

    A text that is no JSON object has one row without a field. Otherwise each required field that is missing, null or of
    another type has a row; a report without faults has none, and `credit_profile` reads exactly those.
    """
    sequence = ["seq"] if "seq" in reports.columns else []
    read = reports.select(
        "application_id",
        *sequence,
        F.try_parse_json("response").alias("v"),
        F.from_json("response", REPORT_SCHEMA).alias("r"),
    )
    whole = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    kinds = dict(part.split() for part in REPORT_SCHEMA.split(", "))

    def fault(name: str):
        value = F.try_variant_get("v", f"$.{name}", "variant")
        return (
            F.when(value.isNull(), "missing")
            .when(F.is_variant_null(value), "null")
            .when(F.col(f"r.{name}").isNull(), f"no {kinds[name]}")
        )

    def entry(name, text):
        return F.struct(name.cast("string").alias("field"), text.alias("fault"))

    each = F.array(*[entry(F.lit(name), fault(name)) for name in FIELDS])
    none = F.array(entry(F.lit(None), F.lit("no JSON object")))
    found = read.select("application_id", *sequence, F.inline(F.when(whole, each).otherwise(none)))
    return found.where(F.col("fault").isNotNull())


def profile_as_of(months: DataFrame, reports: DataFrame) -> DataFrame:
    """application_id, month, report_date and profile in force at the end of each statement month.

    `reports` are dated (application_id, report_date, response, seq if a day has several). Reports with a fault are no
    reports. Before the first report, and without one, the defaults hold (is_loaded false, no report_date).
    """
    dated = reports.where(F.col("report_date").isNotNull())
    parsed = _parsed(dated, ["report_date"]).dropna(how="any", subset=FIELDS)
    events = latest_per_key(parsed, ["application_id", "report_date"]).withColumnRenamed("report_date", "day")
    events = events.withColumn("report_date", F.col("day"))
    ends = months.select("application_id", "month").distinct().withColumn("day", F.last_day(F.concat("month", F.lit("-01")).try_cast("date")))
    found = as_of(ends, events, ["application_id"], "day", ["report_date", *FIELDS])
    return found.select(
        "application_id",
        "month",
        "report_date",
        *[F.coalesce(name, F.lit(default)).alias(name) for name, default in fixed.CREDIT_DEFAULTS.items()],
        F.col("report_date").isNotNull().alias("is_loaded"),
    )


def with_credit_defaults(applications: DataFrame, profiles: DataFrame) -> DataFrame:
    """One profile per application; defaults where no report was loaded."""
    loaded = latest_per_key(profiles, ["application_id"]).select("application_id", *FIELDS, F.lit(True).alias("is_loaded"))
    return applications.join(loaded, "application_id", "left").select(
        *applications.columns,
        *[F.coalesce(name, F.lit(default)).alias(name) for name, default in fixed.CREDIT_DEFAULTS.items()],
        F.coalesce("is_loaded", F.lit(False)).alias("is_loaded"),
    )
