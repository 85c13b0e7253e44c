"""Seats, tokens and what an accepted output costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_where, fiscal_year, ratio, sum_where, year_month


def seat_usage(seats: DataFrame, sessions: DataFrame) -> DataFrame:
    """Seat-months with ``used_in_month``: any session of that lawyer and tool in the month."""
    used = (
        sessions.select("lawyer_id", "tool_id", F.trunc("activity_date", "month").alias("month"))
        .distinct()
        .withColumn("__used", F.lit(True))
    )
    return (
        seats.join(used, ["lawyer_id", "tool_id", "month"], "left")
        .withColumn("used_in_month", F.col("__used").isNotNull())
        .drop("__used")
    )


def session_outputs(sessions: DataFrame, outputs: DataFrame, *columns: str) -> DataFrame:
    """Sessions with their output, if any (at most one per session)."""
    return sessions.join(outputs.select("session_id", *columns), "session_id", "left")


def cost_efficiency(
    seats: DataFrame, sessions: DataFrame, outputs: DataFrame, tools: DataFrame
) -> DataFrame:
    """Month x tool, driven by seats: a tool without seats in a month has no row."""
    idle = ~F.col("used_in_month")
    seat_side = seats.groupBy(
        year_month("month").alias("year_month"), fiscal_year("month").alias("fy_year"), "tool_id"
    ).agg(
        F.sum("seats").alias("seats"),
        count_where(idle).alias("idle_seats"),
        F.sum("licence_cost").alias("licence_cost"),
        sum_where(idle, "licence_cost").alias("idle_licence_cost"),
    )
    usage = (
        session_outputs(sessions, outputs, "accepted")
        .groupBy(year_month("activity_date").alias("year_month"), "tool_id")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.sum("cost").alias("token_cost"),
            count_where(F.col("accepted")).alias("accepted_outputs"),
        )
    )
    joined = (
        seat_side.join(tools.select("tool_id", "tool_name"), "tool_id")
        .join(usage, ["year_month", "tool_id"], "left")
        .withColumn("token_cost", F.coalesce("token_cost", F.lit(0)))
        .fillna(0, ["sessions", "accepted_outputs"])
        .withColumn("total_cost", F.col("licence_cost") + F.col("token_cost"))
    )
    return joined.select(
        "year_month",
        "fy_year",
        "tool_name",
        "seats",
        "idle_seats",
        ratio("idle_seats", "seats").alias("idle_seat_share"),
        "licence_cost",
        "idle_licence_cost",
        "token_cost",
        "total_cost",
        "sessions",
        "accepted_outputs",
        ratio("total_cost", "accepted_outputs").alias("cost_per_accepted_output"),
        ratio("token_cost", "total_cost").alias("token_share_of_cost"),
    )


def billable_impact(
    time: DataFrame,
    sessions: DataFrame,
    matters: DataFrame,
    lawyers: DataFrame,
    estimates: DataFrame,
    min_sessions: int = 3,
) -> DataFrame:
    """Lawyer x matter x month with the hours an estimated effect implies were released.

    With effect e, observed hours are baseline x (1 + e), so the released hours are
    observed x -e / (1 + e). Capacity values all post-adoption hours; the exposure
    of hourly work values only billable ones and is NULL for other arrangements.
    """
    from .adoption import ai_pairs

    post = F.col("is_post_adoption")
    billable = F.col("billable")
    entries = time.groupBy(
        "lawyer_id",
        "matter_id",
        year_month("entry_date").alias("year_month"),
        fiscal_year("entry_date").alias("fy_year"),
    ).agg(
        F.sum("hours").alias("hours"),
        sum_where(billable, "hours").alias("billable_hours"),
        sum_where(post, "hours").alias("post_adoption_hours"),
        sum_where(post & billable, "hours").alias("post_adoption_billable_hours"),
    )
    use = ai_pairs(sessions, min_sessions).select("lawyer_id", "matter_id", "ai_sessions")
    effect = F.col("estimate_pct") / 100.0
    released_share = -effect / (1 + effect)
    return (
        entries.join(use, ["lawyer_id", "matter_id"], "left")
        .join(
            matters.select("matter_id", "fee_arrangement", "practice_area", "confidentiality_tier"),
            "matter_id",
        )
        .join(lawyers.select("lawyer_id", "level", "practice_group", "office", "rate"), "lawyer_id")
        .join(
            estimates.select("fee_arrangement", "estimate_pct", "ci_low_pct", "ci_high_pct"),
            "fee_arrangement",
        )
        .withColumn("is_ai_assisted", F.col("ai_sessions").isNotNull())
        .withColumn("ai_sessions", F.coalesce("ai_sessions", F.lit(0)))
        .withColumn("implied_hours_released", F.col("post_adoption_hours") * released_share)
        .withColumn(
            "notional_capacity_released", F.col("implied_hours_released") * F.col("rate")
        )
        .withColumn(
            "hourly_revenue_exposure",
            F.when(
                F.col("fee_arrangement") == "Hourly",
                F.col("post_adoption_billable_hours") * released_share * F.col("rate"),
            ),
        )
    )


def hours_per_matter(time: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    per_matter = time.groupBy(*by, "matter_id").agg(F.sum("hours").alias("hours"))
    return per_matter.groupBy(*by).agg(
        F.sum("hours").alias("hours"),
        F.count(F.lit(1)).alias("matters"),
        ratio(F.sum("hours"), F.count(F.lit(1))).alias("hours_per_matter"),
    )


def reallocation_ratio(time: DataFrame) -> DataFrame:
    """Per lawyer and fiscal quarter: change of all hours over change of hours on
    assisted matters. The lag runs over one row per quarter."""
    from pyspark.sql.window import Window

    from ..functions.exprs import fiscal_quarter

    quarterly = time.groupBy(
        "lawyer_id",
        fiscal_year("entry_date").alias("fy_year"),
        fiscal_quarter("entry_date").alias("fy_quarter"),
    ).agg(
        F.sum("hours").alias("hours"),
        sum_where(F.col("ai_sessions").isNotNull(), "hours").alias("assisted_hours"),
    )
    order = Window.partitionBy("lawyer_id").orderBy("fy_year", "fy_quarter")
    total_change = F.col("hours") - F.lag("hours").over(order)
    assisted_change = F.col("assisted_hours") - F.lag("assisted_hours").over(order)
    return (
        quarterly.withColumn("hours_change", total_change)
        .withColumn("assisted_hours_change", assisted_change)
        .withColumn("reallocation_ratio", ratio("hours_change", "assisted_hours_change"))
    )


def apply_rate_card(attempts: DataFrame, rates: DataFrame) -> DataFrame:
    """Prices attempts with the card in force for their model at their start.

    Cost stays NULL unless a card matches and all three token counts are known.
    ``rates``: model, effective_from, effective_to (NULL = open), three prices per
    million tokens, currency, rate_version. Cards of one model must not overlap.
    """
    card = rates.select(
        F.col("model").alias("__model"),
        "effective_from",
        "effective_to",
        "input_per_million",
        "cached_input_per_million",
        "output_per_million",
        F.col("currency").alias("__currency"),
        F.col("rate_version").alias("__rate_version"),
    )
    in_force = (
        (F.col("response_model") == F.col("__model"))
        & (F.col("started_at") >= F.col("effective_from"))
        & (F.col("effective_to").isNull() | (F.col("started_at") < F.col("effective_to")))
    )
    known = (
        F.col("__model").isNotNull()
        & F.col("input_tokens").isNotNull()
        & F.col("output_tokens").isNotNull()
        & F.col("cached_input_tokens").isNotNull()
    )
    consistent = F.col("cached_input_tokens").between(F.lit(0), F.col("input_tokens"))
    tokens = "decimal(10,0)"
    price = "decimal(14,6)"
    amount = (
        (F.col("input_tokens") - F.col("cached_input_tokens")).cast(tokens)
        * F.col("input_per_million").cast(price)
        + F.col("cached_input_tokens").cast(tokens) * F.col("cached_input_per_million").cast(price)
        + F.col("output_tokens").cast(tokens) * F.col("output_per_million").cast(price)
    )
    cost = (amount * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(24,12)")
    priced = known & consistent
    return (
        attempts.join(card, in_force, "left")
        .withColumn("is_usage_inconsistent", F.coalesce(known & ~consistent, F.lit(False)))
        .withColumn("estimated_cost", F.when(priced, cost))
        .withColumn("currency", F.when(priced, F.col("__currency")))
        .withColumn("rate_version", F.when(priced, F.col("__rate_version")))
        .drop(*[c for c in card.columns])
    )
