"""Quality and latency panels, incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_where, ratio, year_month
from ..functions.policy import is_mandatory
from .percentiles import exact_percentiles

PANEL_KEYS = ("year_month", "tool_name", "task_name", "review_type", "practice_area")


def quality_panel(
    sessions: DataFrame,
    enriched: DataFrame,
    tools: DataFrame,
    tasks: DataFrame,
    matters: DataFrame,
) -> DataFrame:
    """Month x tool x task x area. p95 latency covers failed sessions too; cost is
    token cost. ``enriched`` holds the outputs with their review policy."""
    outputs = enriched.select(
        "session_id",
        "output_id",
        "accepted",
        "edit_distance_pct",
        "reviewed",
        "effective_review_policy",
    )
    base = (
        sessions.join(outputs, "session_id", "left")
        .join(tools.select("tool_id", "tool_name"), "tool_id")
        .join(tasks.select("task_type_id", "task_name", "review_type"), "task_type_id")
        .join(matters.select("matter_id", "practice_area"), "matter_id")
        .withColumn("year_month", year_month("activity_date"))
    )
    keys = list(PANEL_KEYS)
    panel = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"),
        count_where(F.col("status") != "Success").alias("failed_sessions"),
        count_where(F.col("retry_count") > 0).alias("retried_sessions"),
        F.sum("cost").alias("cost"),
        F.count("accepted").alias("outputs"),
        count_where(F.col("accepted")).alias("accepted_outputs"),
        count_where(is_mandatory()).alias("mandatory_outputs"),
        count_where(is_mandatory() & F.col("reviewed")).alias("mandatory_reviewed"),
        count_where(is_mandatory() & ~F.col("reviewed")).alias("review_gap"),
        # a share with one decimal has at most 1,001 values, so its map stays small
        F.percentile(F.col("edit_distance_pct").cast("double"), 0.5).alias(
            "median_edit_distance_pct"
        ),
    )
    # latency needs no output, so the narrower join feeds the percentile
    latency_rows = (
        sessions.select("activity_date", "tool_id", "task_type_id", "matter_id", "latency_ms")
        .join(tools.select("tool_id", "tool_name"), "tool_id")
        .join(tasks.select("task_type_id", "task_name", "review_type"), "task_type_id")
        .join(matters.select("matter_id", "practice_area"), "matter_id")
        .withColumn("year_month", year_month("activity_date"))
    )
    latency = exact_percentiles(latency_rows, keys, "latency_ms", {"p95_latency_ms": 0.95})
    return (
        panel.join(latency, keys, "left")
        .withColumn("error_rate", ratio("failed_sessions", "sessions"))
        .withColumn("acceptance_rate", ratio("accepted_outputs", "outputs"))
        .withColumn("review_coverage", ratio("mandatory_reviewed", "mandatory_outputs"))
        .withColumn("cost_per_accepted_output", ratio("cost", "accepted_outputs"))
    )


def incident_profile(incidents: DataFrame) -> DataFrame:
    """Type x severity x month: count, mean days to resolve, still open."""
    return incidents.groupBy(
        "incident_type", "severity", year_month("incident_date").alias("year_month")
    ).agg(
        F.count(F.lit(1)).alias("incidents"),
        F.avg(F.when(F.col("resolved"), F.col("days_to_resolve"))).alias("mean_days_to_resolve"),
        count_where(~F.col("resolved")).alias("open_incidents"),
    )


def incidents_by_coverage_quartile(enriched: DataFrame, incidents: DataFrame) -> DataFrame:
    """Lawyers cut at the value quartiles of their mandatory review coverage
    (right-closed, interpolated edges), with incidents per lawyer."""
    coverage = (
        enriched.where(is_mandatory())
        .groupBy("lawyer_id")
        .agg(
            F.count(F.lit(1)).alias("mandatory_outputs"),
            ratio(count_where(F.col("reviewed")), F.count(F.lit(1))).alias("coverage"),
        )
    )
    edges = exact_percentiles(coverage, [], "coverage", {"e1": 0.25, "e2": 0.5, "e3": 0.75})
    edge = edges.select(F.struct("e1", "e2", "e3")).scalar()
    counted = incidents.groupBy("lawyer_id").agg(F.count(F.lit(1)).alias("incidents"))
    quartile = (
        F.when(F.col("coverage") <= edge["e1"], 1)
        .when(F.col("coverage") <= edge["e2"], 2)
        .when(F.col("coverage") <= edge["e3"], 3)
        .otherwise(4)
    )
    return (
        coverage.join(counted, "lawyer_id", "left")
        .withColumn("quartile", quartile)
        .groupBy("quartile")
        .agg(
            F.count(F.lit(1)).alias("lawyers"),
            F.sum(F.coalesce("incidents", F.lit(0))).alias("incidents"),
            F.avg("coverage").alias("mean_coverage"),
            ratio(F.sum(F.coalesce("incidents", F.lit(0))), F.count(F.lit(1))).alias(
                "incidents_per_lawyer"
            ),
        )
    )


def worst_to_best_ratio(quartiles: DataFrame, floor: float = 0.01) -> DataFrame:
    worst = F.max(F.when(F.col("quartile") == 1, F.col("incidents_per_lawyer")))
    best = F.max(F.when(F.col("quartile") == 4, F.col("incidents_per_lawyer")))
    return quartiles.agg(ratio(worst, F.greatest(best, F.lit(floor))).alias("worst_to_best"))


def naive_hours_comparison(time: DataFrame) -> DataFrame:
    """Mean hours of a lawyer-matter with and without assistance, and the share of
    assisted pairs without any line before the first session."""
    assisted = F.col("ai_sessions").isNotNull()
    pairs = (
        time.withColumn("assisted", assisted)
        .groupBy("lawyer_id", "matter_id", "assisted")
        .agg(
            F.sum("hours").alias("hours"),
            F.count(F.lit(1)).alias("entries"),
            count_where(F.col("is_post_adoption")).alias("post_entries"),
        )
    )
    no_before = count_where(F.col("entries") == F.col("post_entries"))
    return pairs.groupBy("assisted").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("hours").alias("mean_hours"),
        F.when(F.col("assisted"), ratio(no_before, F.count(F.lit(1)))).alias("share_without_before"),
    )


def freed_capacity_summary(capacity: DataFrame, population: str) -> DataFrame:
    """Freed and returned hours per population."""
    return capacity.groupBy(population).agg(
        F.count(F.lit(1)).alias("lawyers"),
        F.sum("freed").alias("freed"),
        F.sum("returned").alias("returned"),
        ratio(F.sum("returned"), F.sum("freed")).alias("returned_share"),
        ratio(F.sum(F.col("freed") - F.col("returned")), F.count(F.lit(1))).alias(
            "net_hours_lost_per_lawyer"
        ),
    )
