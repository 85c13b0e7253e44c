"""Sensitive use, review coverage and the per-lawyer screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import (
    join_null_safe,
    count_where,
    fiscal_quarter,
    fiscal_year,
    is_sensitive,
    ratio,
    year_month,
)
from ..functions.policy import is_mandatory

MIN_MANDATORY = 25


def review_coverage(enriched: DataFrame, *by: str) -> DataFrame:
    """Mandatory outputs, how many were reviewed, and the ratio of the sums."""
    return (
        enriched.where(is_mandatory())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("mandatory_outputs"),
            count_where(F.col("reviewed")).alias("mandatory_reviewed"),
        )
        .withColumn("review_coverage", ratio("mandatory_reviewed", "mandatory_outputs"))
    )


def governance_exposure(
    sessions: DataFrame, enriched: DataFrame, matters: DataFrame, tools: DataFrame
) -> DataFrame:
    """Month x tier x area x tool, with the share of the month's sessions."""
    keys = ["year_month", "confidentiality_tier", "practice_area", "tool_name"]
    names = tools.select("tool_id", "tool_name")
    places = matters.select("matter_id", "confidentiality_tier", "practice_area")
    used = (
        sessions.join(places, "matter_id")
        .join(names, "tool_id")
        .groupBy(
            year_month("activity_date").alias("year_month"),
            fiscal_year("activity_date").alias("fy_year"),
            fiscal_quarter("activity_date").alias("fy_quarter"),
            *keys[1:],
        )
        .agg(F.count(F.lit(1)).alias("sessions"))
    )
    reviewed = (
        enriched.join(names, "tool_id")
        .groupBy(year_month("activity_date").alias("year_month"), *keys[1:])
        .agg(
            count_where(is_mandatory()).alias("mandatory_outputs"),
            count_where(is_mandatory() & F.col("reviewed")).alias("mandatory_reviewed"),
        )
    )
    month_total = F.sum("sessions").over(Window.partitionBy("year_month"))
    used = used.withColumn("session_share", ratio(F.col("sessions"), month_total))
    return (
        join_null_safe(used, reviewed, keys, "left")
        .withColumn("review_coverage", ratio("mandatory_reviewed", "mandatory_outputs"))
    )


def governance_screen(
    sessions: DataFrame,
    enriched: DataFrame,
    matters: DataFrame,
    min_mandatory: int = MIN_MANDATORY,
) -> DataFrame:
    """Lawyer x fiscal quarter. ``is_screenable`` needs enough mandatory outputs."""
    return screen_from_daily(
        daily_sessions(sessions), daily_outputs(enriched), matters, min_mandatory
    )


def eligible_screen(screen: DataFrame, min_mandatory: int = MIN_MANDATORY) -> DataFrame:
    """The quarters of lawyers whose mandatory outputs reach the minimum over all quarters."""
    total = screen.groupBy("lawyer_id").agg(F.sum("mandatory_outputs").alias("__total"))
    enough = total.where(F.col("__total") >= min_mandatory).select("lawyer_id")
    return screen.join(enough, "lawyer_id", "left_semi")


def daily_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions counted per day, lawyer, matter and tool. A hot lawyer or source
    shrinks on the map side, and many reports read this instead of the sessions."""
    return sessions.groupBy("activity_date", "lawyer_id", "matter_id", "tool_id").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("status") != "Success").alias("failed"),
        count_where(F.col("retry_count") > 0).alias("retried"),
        F.sum("cost").alias("cost"),
    )


def daily_outputs(enriched: DataFrame) -> DataFrame:
    """Outputs counted per day, lawyer, tool, task, tier and review type."""
    heavy = F.col("accepted") & (F.col("edit_distance_pct") > 40)
    return enriched.groupBy(
        "activity_date", "lawyer_id", "tool_id", "task_type_id", "confidentiality_tier", "review_type"
    ).agg(
        F.count(F.lit(1)).alias("outputs"),
        count_where(F.col("accepted")).alias("accepted"),
        count_where(heavy).alias("heavy"),
        count_where(is_mandatory()).alias("mandatory"),
        count_where(is_mandatory() & F.col("reviewed")).alias("reviewed"),
        count_where(F.col("is_review_gap")).alias("gap"),
    )


def screen_from_daily(
    days: DataFrame, outputs: DataFrame, matters: DataFrame, min_mandatory: int = MIN_MANDATORY
) -> DataFrame:
    """``governance_screen`` over ``daily_sessions`` and ``daily_outputs``."""
    per_matter = days.groupBy(
        "lawyer_id",
        fiscal_year("activity_date").alias("fy_year"),
        fiscal_quarter("activity_date").alias("fy_quarter"),
        "matter_id",
    ).agg(F.sum("n").alias("n"))
    keys = ["lawyer_id", "fy_year", "fy_quarter"]
    used = (
        per_matter.join(
            matters.select("matter_id", "confidentiality_tier", "barrier_group_id"), "matter_id"
        )
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("sessions"),
            F.sum(F.when(is_sensitive(), F.col("n")).otherwise(0)).alias("sensitive_sessions"),
            F.countDistinct("barrier_group_id").alias("barrier_groups_touched"),
        )
    )
    reviewed = outputs.groupBy(
        "lawyer_id",
        fiscal_year("activity_date").alias("fy_year"),
        fiscal_quarter("activity_date").alias("fy_quarter"),
    ).agg(
        F.sum("mandatory").alias("mandatory_outputs"),
        F.sum("reviewed").alias("mandatory_reviewed"),
    )
    return (
        join_null_safe(used, reviewed, keys, "left")
        .withColumn("sensitive_session_rate", ratio("sensitive_sessions", "sessions"))
        .withColumn("review_completion", ratio("mandatory_reviewed", "mandatory_outputs"))
        .fillna(0, ["mandatory_outputs", "mandatory_reviewed"])
        .withColumn("is_screenable", F.col("mandatory_outputs") >= min_mandatory)
    )


def barrier_rolling(sessions: DataFrame, matters: DataFrame, days: int = 90) -> DataFrame:
    """Lawyers active in two or more barrier groups within ``days`` days.

    For each lawyer and active day the last day of every group is kept; a group
    counts when that day is inside the window. Two steps of one window each, no
    self join of sessions.
    """
    active = (
        sessions.select("lawyer_id", "matter_id", "activity_date")
        .distinct()
        .join(
            matters.where(F.col("barrier_group_id").isNotNull()).select(
                "matter_id", "barrier_group_id"
            ),
            "matter_id",
        )
        .select("lawyer_id", "barrier_group_id", "activity_date")
        .distinct()
    )
    # a group's day counts until the group's next day or until it leaves the window
    per_group = Window.partitionBy("lawyer_id", "barrier_group_id").orderBy("activity_date")
    leaves = F.date_add("activity_date", days)
    until = F.least(leaves, F.coalesce(F.lead("activity_date").over(per_group), leaves))
    changes = (
        active.withColumn("until", until)
        .select(
            "lawyer_id",
            F.explode(
                F.array(
                    F.struct(F.col("activity_date").alias("day"), F.lit(1).alias("delta")),
                    F.struct(F.col("until").alias("day"), F.lit(-1).alias("delta")),
                )
            ).alias("c"),
        )
        .groupBy("lawyer_id", F.col("c.day").alias("day"))
        .agg(F.sum("c.delta").alias("delta"))
    )
    running = (
        Window.partitionBy("lawyer_id")
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        changes.withColumn("groups", F.sum("delta").over(running))
        .groupBy("lawyer_id")
        .agg(
            F.max("groups").alias("max_groups"),
            F.min(F.when(F.col("groups") >= 2, F.col("day"))).alias("first_crossing"),
        )
        .where(F.col("max_groups") >= 2)
    )
