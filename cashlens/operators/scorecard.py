"""Hard stops, score, grade and offer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cashlens.functions import fixed, rules
from cashlens.operators.skew import latest_per_key
from cashlens.sources.credit import with_credit_defaults

APP = "application_id"
NO_LEDGER = {
    "gross_deposits": 0.0,
    "median_deposit": 0.0,
    "largest_deposit": 0.0,
    "revenue_months": 0,
    "avg_true_revenue": 0.0,
    "deposit_count": 0,
    "revenue_trend": 0.0,
    "revenue_concentration": 0.0,
    "position_count": 0,
    "total_monthly_payment": 0.0,
    "burden_pct": 0.0,
    "coverage_ratio": 0.0,
    "payment_performance": 0,
    "wash_round_trips": 0,
    "wash_flag": False,
}
GRADE_SCHEMA = ["grade", "risk_tier", "advance_share", "max_burden_share"]


IMPLIED_RECORDS = (
    "CASE WHEN bankruptcies_found THEN 'Severe'"
    " WHEN active_collections_count > 0 THEN 'Moderate' ELSE 'Clean' END"
)


def public_records_default(profiles: DataFrame) -> DataFrame:
    """Public-records class that a credit profile implies."""
    return profiles.selectExpr(APP, f"{IMPLIED_RECORDS} AS public_records")


def _sql(value: object) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def underwriting_inputs(
    metrics: DataFrame, inputs: DataFrame, profiles: DataFrame, industries: DataFrame
) -> DataFrame:
    """One row per application: metrics, manual answers and credit profile, defaults filled in."""
    everyone = metrics.withColumn("_ledger", F.lit(True)).join(latest_per_key(inputs, [APP]).drop("seq"), APP, "full_outer")
    defaults = {**NO_LEDGER, **fixed.INPUT_DEFAULTS}
    filled = {
        **{name: f"coalesce({name}, {_sql(value)})" for name, value in defaults.items()},
        "revenue_volatility": "CASE WHEN _ledger IS NULL THEN 0 ELSE revenue_volatility END",
        "credit_score": "coalesce(credit_score, fico_score)",
        "public_records": f"coalesce(public_records, {IMPLIED_RECORDS})",
        "wash_flag": "coalesce(wash_override, wash_flag, false)",
    }
    ready = with_credit_defaults(everyone, profiles)
    dropped = (APP, "_ledger", "wash_override")
    kept = [f"{filled.get(c, c)} AS {c}" for c in ready.columns if c not in dropped]
    # The industry list has a fixed 70 rows.
    industry = F.broadcast(
        industries.selectExpr(
            "rank AS industry_rank", "industry", "points AS industry_points", "seasonality AS seasonality_points"
        )
    )
    return ready.selectExpr(APP, *kept).join(industry, "industry_rank", "left")


def hard_stops(inputs: DataFrame) -> DataFrame:
    """Policy stops in order; any of them declines the application."""
    stops = {
        fixed.STOP_FRAUD: "fraud_suspected",
        fixed.STOP_DEFAULT: "active_default",
        fixed.STOP_WASH: "wash_flag",
        fixed.STOP_REVENUE: f"avg_true_revenue < {fixed.MIN_AVG_REVENUE}",
    }
    reasons = ", ".join(f"CASE WHEN {stop} THEN '{reason}' END" for reason, stop in stops.items())
    return inputs.selectExpr("*", f"concat_ws(', ', {reasons}) AS hard_stops").selectExpr(
        "*", "CASE WHEN hard_stops = '' THEN 'Scored' ELSE 'Decline' END AS decision"
    )


def component_points() -> dict[str, tuple[str, str]]:
    """component -> SQL of (value scored, points)."""
    values = {
        "revenue": "avg_true_revenue",
        "trend": "revenue_trend",
        "deposit_count": "deposit_count",
        "volatility": "revenue_volatility",
        "daily_balance": "CASE WHEN avg_true_revenue > 0"
        " THEN avg_daily_balance / avg_true_revenue * 100 ELSE 0 END",
        "positions": "position_count",
        "burden": "burden_pct",
        "funding_velocity": "borrowing_velocity",
        "payment_performance": "payment_performance",
        "negative_days": "negative_days",
        "months_in_business": "months_in_business",
        "industry": "industry_points",
        "seasonality": "seasonality_points",
        "credit_score": "credit_score",
        "public_records": "public_records",
        "verification": "bank_verification",
        "concentration": "revenue_concentration",
    }

    def points(name: str, value: str) -> str:
        if name in fixed.AT_LEAST_LADDERS:
            return rules.ladder(value, ">=", fixed.AT_LEAST_LADDERS[name])
        if name in fixed.AT_MOST_LADDERS:
            return rules.ladder(value, "<=", fixed.AT_MOST_LADDERS[name])
        if name in fixed.CHOICE_POINTS:
            return rules.choice_points(value, *fixed.CHOICE_POINTS[name])
        if name == "trend":
            above, top = fixed.TREND_TOP
            below = rules.ladder(value, ">=", fixed.TREND_LADDER)
            return f"CASE WHEN {value} > {above} THEN {top} ELSE {below} END"
        return f"coalesce({value}, 0)"

    return {name: (value, points(name, value)) for name, value in values.items()}


def score_components(stopped: DataFrame) -> DataFrame:
    """Points per component of the applications without a hard stop, in long form."""
    entries = ", ".join(
        f"named_struct('component', '{name}', 'value', CAST({value} AS STRING), 'points', {points},"
        f" 'counted', {str(name not in fixed.UNCOUNTED_COMPONENTS).lower()})"
        for name, (value, points) in component_points().items()
    )
    return stopped.where("decision = 'Scored'").selectExpr(APP, f"inline(array({entries}))")


def score(stopped: DataFrame, score_mode: str = "reference") -> DataFrame:
    """Adds both totals; `score` is the counted one ("reference") or all components ("full")."""
    if score_mode not in ("reference", "full"):
        raise ValueError(f"score_mode must be 'reference' or 'full', not {score_mode!r}")
    points = {name: p for name, (_, p) in component_points().items()}
    counted = [p for name, p in points.items() if name not in fixed.UNCOUNTED_COMPONENTS]

    def total(parts: list[str]) -> str:
        return f"CASE WHEN decision = 'Scored' THEN {' + '.join(parts)} END"

    return stopped.selectExpr(
        "*", f"{total(counted)} AS score_reference", f"{total(list(points.values()))} AS score_full"
    ).selectExpr("*", f"score_{score_mode} AS score")


def grade(scored: DataFrame) -> DataFrame:
    """Grade, risk tier and policy shares of a score; null without a score."""

    def policy(values: tuple) -> str:
        fields = ", ".join(
            f"'{n}', {_sql(v)}{'D' if isinstance(v, float) else ''}" for n, v in zip(GRADE_SCHEMA, values)
        )
        return f"named_struct({fields})"

    steps = " ".join(
        f"WHEN score >= {lowest} THEN {policy(tuple(values))}" for lowest, *values in fixed.GRADES
    )
    found = f"CASE WHEN score IS NOT NULL THEN CASE {steps} ELSE {policy(fixed.LOWEST_GRADE)} END END"
    return scored.selectExpr("*", f"{found} AS _grade").selectExpr(
        *scored.columns, *[f"_grade.{n} AS {n}" for n in GRADE_SCHEMA]
    )


def offer(graded: DataFrame) -> DataFrame:
    """Offer limits from average revenue, policy shares and the burden already carried."""
    free = "avg_true_revenue * max_burden_share - avg_true_revenue * (burden_pct / 100)"
    return graded.selectExpr(
        "*",
        "avg_true_revenue * advance_share AS max_advance",
        f"CASE WHEN grade IS NOT NULL THEN greatest(0D, {free}) END AS remaining_capacity",
    ).selectExpr("*", f"remaining_capacity / {fixed.BUSINESS_DAYS} AS daily_payment")


def scorecard(
    metrics: DataFrame,
    inputs: DataFrame,
    profiles: DataFrame,
    industries: DataFrame,
    score_mode: str = "reference",
) -> DataFrame:
    """One row per application with a ledger or manual answers."""
    ready = hard_stops(underwriting_inputs(metrics, inputs, profiles, industries))
    return offer(grade(score(ready, score_mode)))
