"""Data-driven alert rules: current values, thresholds and breaches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import count_where, is_sensitive, ratio, sum_where, year_month
from ..session import cut_lineage
from .governance import daily_outputs, daily_sessions, screen_from_daily
from .percentiles import exact_percentiles

# Rule name, category, threshold, comparison, severity, owner.
RULES = [
    ("p95 latency above 8s", "Operational", 8000.0, ">", "High", "IT Operations"),
    ("Error rate above 5% over 24h", "Operational", 0.05, ">", "High", "IT Operations"),
    ("Feed loaded zero rows", "Operational", 0.0, "=", "Critical", "Data Engineering"),
    ("Feed stale beyond 36 hours", "Operational", 36.0, ">", "High", "Data Engineering"),
    ("Referential failures above 1% of a source", "Operational", 0.01, ">", "Medium", "Data Engineering"),
    ("Median edit distance above 45%", "Quality", 45.0, ">", "Medium", "AI Operations"),
    ("Acceptance rate falls 15pp month on month", "Quality", -0.15, "<", "Medium", "AI Operations"),
    ("Cost per accepted output above $12", "Cost", 12.0, ">", "Medium", "Finance"),
    ("Idle seat share above 40% for a paid tool", "Cost", 0.40, ">", "Medium", "Finance"),
    ("Monthly cost 30% above trailing 3-month mean", "Cost", 0.30, ">", "Low", "Finance"),
    ("Review coverage below 95% on Barrier matters", "Governance", 0.95, "<", "Critical", "General Counsel"),
    ("Any unreviewed output where review is Mandatory", "Governance", 0.0, ">", "Critical", "Risk & Compliance"),
    ("First use of a newly deployed tool on a Restricted matter", "Governance", 1.0, ">=", "High", "General Counsel"),
    ("Lawyer active across two barrier groups in 90 days", "Governance", 2.0, ">=", "Critical", "General Counsel"),
    ("Lawyer mandatory review completion below 70%", "Governance", 0.70, "<", "Critical", "Risk & Compliance"),
    ("Restricted-tier session rate above 3x the firm median", "Governance", 3.0, ">", "Low", "Risk & Compliance"),
]
RULE_SCHEMA = (
    "rule_id int, rule_name string, category string, threshold_value double, "
    "comparison string, severity string, owner_role string"
)
(
    P95_LATENCY,
    ERROR_RATE,
    ZERO_LOAD,
    STALE_FEED,
    REFERENTIAL,
    MEDIAN_EDIT,
    ACCEPTANCE_FALL,
    COST_PER_ACCEPTED,
    IDLE_SEATS,
    MONTHLY_COST,
    BARRIER_COVERAGE,
    UNREVIEWED,
    NEW_TOOL,
    TWO_BARRIERS,
    LOW_COMPLETION,
    HIGH_EXPOSURE,
) = [r[0] for r in RULES]


@dataclass
class Star:
    """The frames the rules and metrics read."""

    sessions: DataFrame
    outputs: DataFrame  # enriched with the review policy
    lawyers: DataFrame
    matters: DataFrame
    tools: DataFrame
    tasks: DataFrame
    seats: DataFrame
    health: DataFrame  # feed_health


def rule_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES, 1)], RULE_SCHEMA)


def _rows(frame: DataFrame, *rules: tuple[str, Column, Column]) -> DataFrame:
    """One aggregate row turned into one (rule, value, affected) row per rule."""
    structs = [
        F.struct(
            F.lit(name).alias("rule_name"),
            value.cast("double").alias("current_value"),
            affected.cast("long").alias("affected"),
        )
        for name, value, affected in rules
    ]
    return frame.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def monthly_cost_change(sessions: DataFrame, seats: DataFrame, runs: DataFrame) -> DataFrame:
    """Cost of the latest complete month over the mean of the three months before, - 1.

    Complete means covered by the feed watermark. A missing month, a zero baseline
    or no watermark gives NULL. Decimal arithmetic keeps equality with a threshold exact.
    """
    token = sessions.groupBy(F.last_day("activity_date").alias("month_end")).agg(
        F.sum(F.col("cost").cast("decimal(24,6)")).alias("cost")
    )
    licence = seats.groupBy(F.last_day("month").alias("month_end")).agg(
        F.sum(F.col("licence_cost").cast("decimal(24,6)")).alias("cost")
    )
    mark = runs.agg(F.max("run_date").alias("mark"))
    month_end = mark.select(
        F.when(F.col("mark") == F.last_day("mark"), F.col("mark")).otherwise(
            F.last_day(F.add_months("mark", -1))
        )
    ).scalar()
    months = token.unionByName(licence).groupBy("month_end").agg(F.sum("cost").alias("cost"))
    window = months.where(
        (F.col("month_end") <= month_end)
        & (F.col("month_end") >= F.last_day(F.add_months(month_end, -3)))
    )
    amount = "decimal(24,6)"
    current = F.sum(F.when(F.col("month_end") == month_end, F.col("cost"))).cast(amount)
    before = F.sum(F.when(F.col("month_end") < month_end, F.col("cost"))).cast(amount)
    change = F.try_divide((current * 3).cast(amount), before) - 1
    return window.agg(F.when(F.count(F.lit(1)) == 4, change).cast("double").alias("change"))


def rule_values(star: Star) -> DataFrame:
    """Current value and affected count of every rule, one row each.

    Sessions and outputs are read once each into daily counts, which answer most
    rules; only the percentile rules go back to the rows of a recent period.
    """
    days = cut_lineage(daily_sessions(star.sessions))
    produced = cut_lineage(daily_outputs(star.outputs))
    seats = cut_lineage(
        star.seats.groupBy("tool_id", "month").agg(
            F.count(F.lit(1)).alias("seats"),
            count_where(~F.col("used_in_month")).alias("idle"),
            F.sum("licence_cost").alias("licence_cost"),
        )
    )
    as_at = days.agg(F.max("activity_date")).scalar()
    one = F.count(F.lit(1))
    total = F.sum

    ok_last_day = star.sessions.where(
        (F.col("activity_date") == as_at) & (F.col("status") == "Success")
    )
    slow = exact_percentiles(ok_last_day, ["tool_id"], "latency_ms", {"p95": 0.95})
    last_day = days.where(F.col("activity_date") == as_at)
    recent_health = star.health.where(F.col("run_date") > F.date_sub(as_at, 30))
    source_rate = (
        star.health.where(F.col("run_date") > F.date_sub(as_at, 7))
        .groupBy("source")
        .agg(
            ratio(
                total("referential_failures"), total(F.col("rows_loaded") + F.col("rows_rejected"))
            ).alias("rate")
        )
    )
    expected = F.col("is_expected_active")
    on_day = F.col("run_date") == as_at

    recent = F.col("activity_date") > F.date_sub(as_at, 30)
    edit_by_task = (
        star.outputs.where(recent)
        .groupBy("task_type_id")
        .agg(F.percentile(F.col("edit_distance_pct").cast("double"), 0.5).alias("med"))
    )
    by_month = produced.groupBy(year_month("activity_date").alias("year_month")).agg(
        ratio(total("accepted"), total("outputs")).alias("acceptance")
    )
    # one row per month from here on
    delta = by_month.withColumn(
        "delta", F.col("acceptance") - F.lag("acceptance").over(Window.orderBy("year_month"))
    )
    licence = seats.agg(total("licence_cost")).scalar()
    tokens = days.agg(total("cost")).scalar()
    barrier = F.col("confidentiality_tier") == "Barrier"
    gap = sum_where(recent, "gap")

    idle = (
        seats.where(F.col("month") > F.add_months(as_at, -3))
        .groupBy("tool_id")
        .agg(ratio(total("idle"), total("seats")).alias("idle"))
    )
    new_tool = (
        days.join(star.matters.where(is_sensitive()).select("matter_id"), "matter_id")
        .join(star.tools.select("tool_id", "deployment_date"), "tool_id")
        .where(F.col("activity_date") <= F.date_add("deployment_date", 90))
        .select("tool_id", "lawyer_id")
        .distinct()
    )
    screen = cut_lineage(screen_from_daily(days, produced, star.matters))
    crossing = screen.where(F.col("barrier_groups_touched") >= 2)
    per_lawyer = cut_lineage(
        screen.groupBy("lawyer_id").agg(
            ratio(total("sensitive_sessions"), total("sessions")).alias("rate")
        )
    )
    median = exact_percentiles(per_lawyer, [], "rate", {"m": 0.5}).select("m").scalar()
    relative = F.try_divide(F.col("rate"), median)
    low = F.col("review_completion")
    change = monthly_cost_change(days, seats, star.health)

    frames = [
        _rows(slow, (P95_LATENCY, F.max("p95"), one)),
        _rows(last_day, (ERROR_RATE, ratio(total("failed"), total("n")), total("failed"))),
        _rows(
            recent_health,
            (
                ZERO_LOAD,
                F.min(F.when(expected, F.col("rows_loaded"))),
                count_where(expected & F.col("is_unexpected_zero_load")),
            ),
            (
                STALE_FEED,
                F.max(F.when(on_day, F.col("hours_since_good_run"))),
                F.countDistinct(F.when(on_day, F.col("source"))),
            ),
        ),
        _rows(source_rate, (REFERENTIAL, F.max("rate"), one)),
        _rows(edit_by_task, (MEDIAN_EDIT, F.max("med"), count_where(F.col("med") > 45))),
        _rows(delta, (ACCEPTANCE_FALL, F.min("delta"), count_where(F.col("delta") < -0.15))),
        _rows(
            produced,
            (
                COST_PER_ACCEPTED,
                ratio(licence + tokens, total("accepted")),
                total("accepted"),
            ),
            (
                BARRIER_COVERAGE,
                ratio(sum_where(barrier, "reviewed"), sum_where(barrier, "mandatory")),
                sum_where(barrier, "mandatory"),
            ),
            (UNREVIEWED, gap, gap),
        ),
        _rows(idle, (IDLE_SEATS, F.max("idle"), one)),
        _rows(change, (MONTHLY_COST, F.max("change"), F.max(F.lit(None)))),
        _rows(new_tool, (NEW_TOOL, one, one)),
        _rows(crossing, (TWO_BARRIERS, F.max("barrier_groups_touched"), one)),
        _rows(
            screen.where(F.col("is_screenable")),
            (LOW_COMPLETION, F.min(low), count_where(low < 0.70)),
        ),
        _rows(per_lawyer, (HIGH_EXPOSURE, F.max(relative), count_where(relative > 3))),
    ]
    values = frames[0]
    for frame in frames[1:]:
        values = values.unionByName(frame)
    return values


def breach() -> Column:
    """Threshold test with the operator of the rule row; unknown values stay NULL."""
    value, limit, op = F.col("current_value"), F.col("threshold_value"), F.col("comparison")
    verdict = (
        F.when(op == ">", value > limit)
        .when(op == ">=", value >= limit)
        .when(op == "<", value < limit)
        .when(op == "=", value == limit)
        .otherwise(F.lit(False))
    )
    return F.when(value.isNotNull(), verdict)


def evaluate_rules(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules joined to values by name. A rule without a value keeps NULLs. The cost
    change rule affects one firm, so its count is the breach itself."""
    return (
        rules.join(values, "rule_name", "left")
        .withColumn("is_breached", breach())
        .withColumn(
            "affected_count",
            F.when(F.col("rule_name") == MONTHLY_COST, F.col("is_breached").cast("long")).otherwise(
                F.col("affected")
            ),
        )
        .drop("affected")
    )


def alert_status(star: Star, rules: DataFrame) -> DataFrame:
    return evaluate_rules(rule_values(star), rules)


def breached_rules(status: DataFrame) -> DataFrame:
    return status.agg(
        sum_where(F.coalesce("is_breached", F.lit(False)), F.lit(1)).alias("breached_rules"),
        F.count(F.lit(1)).alias("rules"),
    )
