"""Named metrics evaluated at any grouping.

A ratio is always a ratio of sums at the requested grain. A fact that lacks one of
the grouping columns (a population, for example) is joined on the columns it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import count_where, fiscal_year, is_sensitive, join_null_safe, ratio, sum_where
from ..functions.policy import is_mandatory
from .percentiles import exact_percentiles


@dataclass(frozen=True)
class Measure:
    """An aggregate over one fact, or an exact percentile of a column of it."""

    fact: str
    value: Column
    percentile: float | None = None
    where: Column | None = None


@dataclass(frozen=True)
class Metric:
    """``minus``: numerator is num - minus; ``plus``: num + plus; ``den``: divided by it."""

    name: str
    num: Measure
    den: Measure | None = None
    plus: Measure | None = None
    minus: Measure | None = None


def catalogue() -> dict[str, Metric]:
    """The standard metrics. Facts: sessions, outputs, seats, lawyers, matters, time,
    incidents, alerts, cohorts, screen, users (distinct lawyers over all time)."""
    one = F.count(F.lit(1))
    accepted = count_where(F.col("accepted"))
    mandatory = count_where(is_mandatory())
    active = Measure("sessions", F.countDistinct("lawyer_id"))
    sessions = Measure("sessions", one)
    population = Measure("lawyers", count_where(F.col("is_active")))
    token = Measure("sessions", F.sum("cost"))
    licence = Measure("seats", F.sum("licence_cost"))
    outputs = Measure("outputs", one)
    accepted_outputs = Measure("outputs", accepted)
    matters = Measure("matters", one)
    ever = Measure("users", one)
    idle = ~F.col("used_in_month")
    complete = F.col("retained_lawyers").isNotNull()
    post = F.col("is_post_adoption")
    fixed = F.col("fee_arrangement").isin("Fixed Fee", "Capped")
    hourly = (F.col("fee_arrangement") == "Hourly") & F.col("billable")
    heavy = F.col("accepted") & (F.col("edit_distance_pct") > 40)
    metrics = [
        Metric("active_lawyers", active),
        Metric("sessions", sessions),
        Metric("token_cost", token),
        Metric("licence_cost", licence),
        Metric("total_cost", token, plus=licence),
        Metric("accepted_outputs", accepted_outputs),
        Metric("open_incidents", Measure("incidents", count_where(~F.col("resolved")))),
        Metric("breached_rules", Measure("alerts", count_where(F.col("is_breached")))),
        Metric("lawyer_population", population),
        Metric("adoption_rate", active, population),
        Metric("cost_per_accepted_output", token, accepted_outputs, plus=licence),
        Metric("acceptance_rate", accepted_outputs, outputs),
        Metric(
            "review_coverage",
            Measure("outputs", count_where(is_mandatory() & F.col("reviewed"))),
            Measure("outputs", mandatory),
        ),
        Metric("sessions_per_active_lawyer", sessions, active),
        Metric("lawyers_never_adopted", population, minus=ever),
        Metric("never_adopted_share", population, population, minus=ever),
        Metric("cohort_lawyers", Measure("cohorts", F.sum("cohort_lawyers"))),
        Metric(
            "week4_retention",
            Measure("cohorts", F.sum("retained_lawyers")),
            Measure("cohorts", sum_where(complete, "cohort_lawyers")),
        ),
        Metric(
            "p95_latency_ms",
            Measure("sessions", F.col("latency_ms"), 0.95, F.col("status") == "Success"),
        ),
        Metric(
            "error_rate",
            Measure("sessions", count_where(F.col("status") != "Success")),
            sessions,
        ),
        Metric(
            "median_edit_distance_pct",
            Measure("outputs", F.percentile(F.col("edit_distance_pct").cast("double"), 0.5)),
        ),
        Metric("review_gap", Measure("outputs", count_where(F.col("is_review_gap")))),
        Metric("retry_rate", Measure("sessions", count_where(F.col("retry_count") > 0)), sessions),
        Metric("heavy_rework_share", Measure("outputs", count_where(heavy)), accepted_outputs),
        Metric(
            "governance_exposure", Measure("sessions", count_where(is_sensitive())), sessions
        ),
        Metric("matters", matters),
        Metric("screen_mandatory_outputs", Measure("screen", F.sum("mandatory_outputs"))),
        Metric(
            "screen_completion",
            Measure("screen", F.sum("mandatory_reviewed")),
            Measure("screen", F.sum("mandatory_outputs")),
        ),
        Metric(
            "screen_sensitive_rate",
            Measure("screen", F.sum("sensitive_sessions")),
            Measure("screen", F.sum("sessions")),
        ),
        Metric("post_adoption_hours", Measure("time", sum_where(post, "hours"))),
        Metric("notional_capacity", Measure("time", sum_where(post, "capacity"))),
        Metric("hourly_revenue_at_risk", Measure("time", sum_where(post & hourly, "capacity"))),
        Metric("fixed_price_capacity", Measure("time", sum_where(post & fixed, "capacity"))),
        Metric(
            "ai_matters", Measure("time", F.countDistinct(F.when(post, F.col("matter_id"))))
        ),
        Metric("idle_seat_share", Measure("seats", count_where(idle)), Measure("seats", one)),
        Metric("idle_licence_cost", Measure("seats", sum_where(idle, "licence_cost"))),
    ]
    return {m.name: m for m in metrics}


def evaluation_catalogue() -> dict[str, Metric]:
    """Metrics of evaluation rows (fact ``cases``); quality is averaged only when the
    grouping fixes run, configuration and partition."""
    one = F.count(F.lit(1))
    single = (
        (F.countDistinct("run_id") == 1)
        & (F.countDistinct("config_id") == 1)
        & (F.countDistinct("partition") == 1)
    )
    answerable = F.col("is_answerable")

    def quality(value: Column) -> Measure:
        return Measure("cases", F.when(single, F.avg(value)))

    metrics = [
        Metric("documents", Measure("cases", F.countDistinct("document_id"))),
        Metric("questions", Measure("cases", F.countDistinct("case_id"))),
        Metric(
            "answerable_questions",
            Measure("cases", F.countDistinct(F.when(answerable, F.col("case_id")))),
        ),
        Metric(
            "unanswerable_questions",
            Measure("cases", F.countDistinct(F.when(~answerable, F.col("case_id")))),
        ),
        Metric("query_rows", Measure("cases", one)),
        Metric("failed_queries", Measure("cases", count_where(F.col("response_state") == "error"))),
        Metric(
            "missing_queries", Measure("cases", count_where(F.col("response_state") == "missing"))
        ),
        Metric("evidence_recall", quality(F.col("gold_character_recall"))),
        Metric("full_evidence_rate", quality(F.col("all_gold_covered").cast("int"))),
        Metric("mean_context_characters", quality(F.col("retrieved_characters"))),
    ]
    return {m.name: m for m in metrics}


def evaluate(
    metrics: Sequence[Metric], facts: dict[str, DataFrame], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group with one column per metric; each fact is aggregated once."""
    by = list(by)
    parts: dict[str, dict[str, Measure]] = {}
    for m in metrics:
        for role in ("num", "den", "plus", "minus"):
            measure = getattr(m, role)
            if measure is not None:
                parts.setdefault(measure.fact, {})[f"__{m.name}__{role}"] = measure

    full: list[DataFrame] = []
    partial: list[tuple[list[str], DataFrame]] = []
    for fact, measures in parts.items():
        frame = facts[fact]
        keys = [k for k in by if k in frame.columns]
        plain = {n: m for n, m in measures.items() if m.percentile is None}
        frames = []
        if plain:
            frames.append(frame.groupBy(*keys).agg(*[m.value.alias(n) for n, m in plain.items()]))
        for n, m in measures.items():
            if m.percentile is not None:
                rows = frame if m.where is None else frame.where(m.where)
                frames.append(exact_percentiles(rows, keys, m.value, {n: m.percentile}))
        for agg in frames:
            if keys == by and by:
                full.append(agg)
            else:
                partial.append((keys, agg))

    result = full[0] if full else None
    for frame in full[1:]:
        result = join_null_safe(result, frame, by, "full")
    for keys, frame in partial:
        if result is None:
            result = frame
        elif keys:
            result = join_null_safe(result, frame, keys, "left")
        else:
            row = frame.select(F.struct("*")).scalar()
            for name in frame.columns:
                result = result.withColumn(name, row[name])

    columns = []
    for m in metrics:
        value = F.col(f"__{m.name}__num")
        if m.plus is not None:
            plus = F.col(f"__{m.name}__plus")
            value = F.when(
                value.isNotNull() | plus.isNotNull(),
                F.coalesce(value, F.lit(0)) + F.coalesce(plus, F.lit(0)),
            )
        if m.minus is not None:
            value = value - F.coalesce(F.col(f"__{m.name}__minus"), F.lit(0))
        if m.den is not None:
            value = ratio(value, f"__{m.name}__den")
        columns.append(value.alias(m.name))
    return result.select(*by, *columns)


def month_over_month(
    monthly: DataFrame, value: str, month: str = "month", by: Sequence[str] = ()
) -> DataFrame:
    """Adds ``previous`` and ``change`` against the calendar month before. A month
    that is absent gives NULL; no row is skipped over."""
    by = list(by)
    shifted = monthly.select(
        *by, F.add_months(month, 1).cast("date").alias(month), F.col(value).alias("previous")
    )
    return monthly.join(shifted, [*by, month], "left").withColumn(
        "change", F.col(value) - F.col("previous")
    )


def fiscal_year_to_date(
    daily: DataFrame, value: str, day: str = "date", by: Sequence[str] = (), start_month: int = 7
) -> DataFrame:
    """Running sum inside the fiscal year over one row per day."""
    by = list(by)
    year = fiscal_year(day, start_month)
    order = (
        Window.partitionBy(*by, "fy_year")
        .orderBy(day)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.withColumn("fy_year", year).withColumn("to_date", F.sum(value).over(order))


def share_of_total(counts: DataFrame, value: str, over: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of each ``over`` category in the total that ignores it."""
    by = list(by)
    if by:
        total = F.sum(value).over(Window.partitionBy(*by))
    else:
        total = counts.agg(F.sum(value)).scalar()
    return counts.withColumn("share", ratio(F.col(value), total))


def recall_gain(cases: DataFrame, by: Sequence[str] = ("run_id", "partition")) -> DataFrame:
    """Baseline and candidate recall of a run and the gain in percentage points."""
    baseline = F.avg(F.when(F.col("config_role") == "baseline", F.col("gold_character_recall")))
    candidate = F.avg(F.when(F.col("config_role") == "candidate", F.col("gold_character_recall")))
    return cases.groupBy(*by).agg(
        baseline.alias("baseline_recall"),
        candidate.alias("candidate_recall"),
        ((candidate - baseline) * 100).alias("recall_gain_pp"),
    )


def priced_time(time: DataFrame, matters: DataFrame, lawyers: DataFrame, estimates: DataFrame):
    """Time lines with ``capacity``: released hours of the line at the lawyer's rate."""
    effect = F.col("estimate_pct") / 100.0
    estimates = one_per_key(estimates.select("fee_arrangement", "estimate_pct"), "fee_arrangement")
    return (
        time.join(matters.select("matter_id", "fee_arrangement"), "matter_id")
        .join(lawyers.select("lawyer_id", "rate"), "lawyer_id")
        .join(estimates, "fee_arrangement", "left")
        .withColumn(
            "capacity",
            F.coalesce(F.col("hours") * -effect / (1 + effect) * F.col("rate"), F.lit(0.0)),
        )
    )


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """Look-up table that fails the job when a key has two different values."""
    others = [c for c in df.columns if c != key]
    value = F.struct(*others)
    distinct = df.groupBy(key).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    checked = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        F.raise_error(F.lit("more than one value for a look-up key"))
    )
    return distinct.withColumn("a", checked).select(key, *[F.col(f"a.{c}").alias(c) for c in others])
