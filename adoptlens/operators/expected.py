"""Reconciliation table: every headline measure computed a second way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_where, is_sensitive, ratio
from ..session import cut_lineage
from .adoption import adoption_plateau, never_adopted, retention_cohort, retention_rate
from .alerts import Star
from .governance import daily_outputs, daily_sessions
from .percentiles import exact_percentiles


def _each(frame: DataFrame, measure: str, label: str, key: str, value: str) -> DataFrame:
    return frame.select(
        F.lit(measure).alias("measure"),
        F.concat(F.lit(f"{label} = "), F.col(key).cast("string")).alias("scope"),
        F.col(value).cast("double").alias("expected"),
    )


def _many(frame: DataFrame, *rows: tuple[str, str, Column]) -> DataFrame:
    """Several measures from one pass over a frame."""
    structs = [
        F.struct(
            F.lit(m).alias("measure"), F.lit(s).alias("scope"), v.cast("double").alias("expected")
        )
        for m, s, v in rows
    ]
    return frame.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def expected_values(star: Star) -> DataFrame:
    """measure, scope, expected. Two deliberately wrong variants of the unit cost (sum
    and mean of per-tool ratios) are included as a warning sign.

    Facts are read once into daily counts; only percentiles go back to the rows.
    """
    total, one = F.sum, F.count(F.lit(1))
    days = cut_lineage(daily_sessions(star.sessions))
    produced = cut_lineage(daily_outputs(star.outputs))
    idle_cost = F.when(~F.col("used_in_month"), F.col("licence_cost")).otherwise(0)
    seats = cut_lineage(
        star.seats.groupBy("tool_id").agg(
            one.alias("seats"),
            count_where(~F.col("used_in_month")).alias("idle"),
            total("licence_cost").alias("licence"),
            total(idle_cost).alias("idle_licence"),
        )
    )
    lawyers = star.lawyers
    tokens = days.agg(total("cost")).scalar()
    licence = seats.agg(total("licence")).scalar()
    names = star.tools.select("tool_id", "tool_name")

    per_tool = (
        seats.join(days.groupBy("tool_id").agg(total("cost").alias("token")), "tool_id")
        .join(produced.groupBy("tool_id").agg(total("accepted").alias("accepted")), "tool_id")
        .join(names, "tool_id")
        .withColumn("cpa", ratio(F.col("licence") + F.col("token"), F.col("accepted")))
        .withColumn("idle_share", ratio("idle", "seats"))
    )
    firm = adoption_plateau(days, lawyers.withColumn("__firm", F.lit("firm")), "__firm")
    cohorts = retention_cohort(days, lawyers, "lawyer_id", "activity_date", ["level"])
    ok = star.sessions.where(F.col("status") == "Success")
    by_tier = (
        days.groupBy("matter_id")
        .agg(total("n").alias("n"))
        .join(star.matters.select("matter_id", "confidentiality_tier"), "matter_id")
        .groupBy("confidentiality_tier")
        .agg(total("n").alias("n"))
    )
    matters = star.matters.groupBy("confidentiality_tier").agg(one.alias("n"))
    session_total = days.agg(total("n")).scalar()
    matter_total = star.matters.agg(one).scalar()
    p95 = exact_percentiles(ok, [], "latency_ms", {"p": 0.95})
    p95_tool = exact_percentiles(ok, ["tool_id"], "latency_ms", {"p": 0.95}).join(names, "tool_id")
    median_area = star.outputs.groupBy("practice_area").agg(
        F.percentile(F.col("edit_distance_pct").cast("double"), 0.5).alias("m")
    )
    rework = (
        produced.groupBy("task_type_id")
        .agg(ratio(total("heavy"), total("accepted")).alias("share"))
        .join(star.tasks.select("task_type_id", "task_name"), "task_type_id")
    )
    monthly = days.groupBy(
        (F.year("activity_date") * 100 + F.month("activity_date")).alias("ym")
    ).agg(ratio(total("n"), F.countDistinct("lawyer_id")).alias("spa"))

    def coverage(key: str) -> DataFrame:
        return (
            produced.groupBy(key)
            .agg(total("mandatory").alias("m"), total("reviewed").alias("r"))
            .where(F.col("m") > 0)
            .withColumn("coverage", ratio("r", "m"))
        )

    sensitive = F.when(is_sensitive(), F.col("n")).otherwise(0)
    accepted = total("accepted")
    parts = [
        _many(lawyers, ("Lawyer Population", "active lawyers", count_where(F.col("is_active")))),
        _many(
            firm,
            ("Active Lawyers", "mean over months", F.max("mean_monthly_active")),
            ("Adoption Rate", "firm-wide", F.max("adoption")),
        ),
        _each(
            adoption_plateau(days, lawyers, "level"), "Adoption Rate", "level", "level", "adoption"
        ),
        _many(
            days,
            ("Token Cost", "all time", total("cost")),
            ("Error Rate", "all time", ratio(total("failed"), total("n"))),
            ("Retry Rate", "all time", ratio(total("retried"), total("n"))),
        ),
        _many(
            produced,
            ("Accepted Outputs", "all time", accepted),
            ("Cost per Accepted Output", "token only, for contrast", ratio(tokens, accepted)),
            ("Cost per Accepted Output", "licence + token", ratio(tokens + licence, accepted)),
            ("Mandatory Review Gap", "all time", total("gap")),
            ("Review Coverage", "mandatory", ratio(total("reviewed"), total("mandatory"))),
        ),
        _many(
            seats,
            ("Licence Cost", "all time", total("licence")),
            ("Idle Licence Cost", "all time", total("idle_licence")),
            ("Idle Seat Share", "all time", ratio(total("idle"), total("seats"))),
            ("Total AI Cost", "licence + token", total("licence") + tokens),
        ),
        _many(
            per_tool,
            ("Cost per Accepted Output", "WRONG: sum of per-tool ratios", total("cpa")),
            ("Cost per Accepted Output", "WRONG: mean of per-tool ratios", F.avg("cpa")),
        ),
        _each(per_tool, "Cost per Accepted Output", "tool", "tool_name", "cpa"),
        _each(per_tool, "Idle Seat Share", "tool", "tool_name", "idle_share"),
        _each(
            coverage("confidentiality_tier"),
            "Review Coverage",
            "tier",
            "confidentiality_tier",
            "coverage",
        ),
        _each(coverage("review_type"), "Review Coverage", "review type", "review_type", "coverage"),
        _many(p95, ("p95 Latency", "successful sessions", F.max("p"))),
        _each(p95_tool, "p95 Latency", "tool", "tool_name", "p"),
        _each(median_area, "Median Edit Distance", "area", "practice_area", "m"),
        _many(by_tier, ("Governance Exposure", "all time", ratio(total(sensitive), total("n")))),
        _each(
            by_tier.withColumn("s", ratio(F.col("n"), session_total)),
            "Share of Sessions",
            "tier",
            "confidentiality_tier",
            "s",
        ),
        _each(
            matters.withColumn("s", ratio(F.col("n"), matter_total)),
            "Share of Matters",
            "tier",
            "confidentiality_tier",
            "s",
        ),
        _each(
            never_adopted(days, lawyers, ["level"]),
            "Never Adopted",
            "level",
            "level",
            "never_adopted_share",
        ),
        _each(
            never_adopted(days, lawyers, ["practice_group"]),
            "Never Adopted",
            "group",
            "practice_group",
            "never_adopted_share",
        ),
        _many(
            never_adopted(days, lawyers),
            ("Lawyers Never Adopted", "all time", F.max("never_adopted")),
        ),
        _many(
            retention_rate(cohorts), ("Week-4 Retention", "complete cohorts", F.max("retention"))
        ),
        _each(rework, "Heavy Rework Share", "task", "task_name", "share"),
        _each(monthly, "Sessions per Active Lawyer", "month", "ym", "spa"),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
