"""Who uses the tools: adoption by group, retention cohorts, rolling reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import iso_week, join_null_safe, ratio, week_start, year_month

GROUPS = ("level", "practice_group", "office")


def month_spine(facts: DataFrame, day: str):
    """Column with the array of month starts between the first and last fact day.

    The first entry is the first fact day itself, which need not be the 1st.
    """
    bounds = facts.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    months = F.sequence(
        F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month")
    )
    return bounds.select(F.transform(months, lambda m: F.greatest(m, F.col("a")))).scalar()


def active_months(sessions: DataFrame, actor: str, day: str) -> DataFrame:
    """Sessions per actor and month; the map side shrinks a hot actor to its months."""
    return sessions.groupBy(actor, year_month(day).alias("year_month")).agg(
        F.count(F.lit(1)).alias("sessions")
    )


def adoption_by_group(
    sessions: DataFrame,
    lawyers: DataFrame,
    groups: Sequence[str] = GROUPS,
    actor: str = "lawyer_id",
    day: str = "activity_date",
) -> DataFrame:
    """Month x group. The population comes from the dimension, so a group without
    users reports zero. Only the population is limited to active lawyers."""
    groups = list(groups)
    population = (
        lawyers.where(F.col("is_active")).groupBy(*groups).agg(F.count(F.lit(1)).alias("lawyers"))
    )
    cells = population.withColumn("month_start", F.explode(month_spine(sessions, day))).withColumn(
        "year_month", year_month("month_start")
    )
    active = (
        active_months(sessions, actor, day)
        .join(lawyers.select(actor, *groups), actor)
        .groupBy("year_month", *groups)
        .agg(F.count(F.lit(1)).alias("active_lawyers"), F.sum("sessions").alias("sessions"))
    )
    return (
        join_null_safe(cells, active, ["year_month", *groups], "left")
        .fillna(0, ["active_lawyers", "sessions"])
        .withColumn("adoption_rate", ratio("active_lawyers", "lawyers"))
        .withColumn("sessions_per_active_lawyer", ratio("sessions", "active_lawyers"))
    )


def retention_cohort(
    activity: DataFrame,
    actors: DataFrame | None = None,
    actor: str = "actor",
    day: str = "activity_date",
    by: Sequence[str] = (),
    week_offset: int = 4,
    calendar_start: str | None = None,
) -> DataFrame:
    """Cohort of the first active ISO week; retained means active in the single week
    ``week_offset`` weeks later. A cohort whose week is not over is incomplete (NULL)."""
    by = list(by)
    days = activity.select(actor, F.col(day).alias("day")).distinct()
    last_day = activity.agg(F.max(day)).scalar()
    first = F.min("day").over(Window.partitionBy(actor))
    start = week_start(F.col("first_day"))
    if calendar_start is not None:
        start = F.greatest(start, F.lit(calendar_start).cast("date"))
    marked = days.withColumn("first_day", first).withColumn("week_start", start)
    opens, closes = 7 * week_offset, 7 * week_offset + 7
    in_week = (F.col("day") >= F.date_add("week_start", opens)) & (
        F.col("day") < F.date_add("week_start", closes)
    )
    per_actor = marked.groupBy(actor, "first_day", "week_start").agg(
        F.max(in_week.cast("int")).alias("came_back")
    )
    if actors is not None:
        per_actor = per_actor.join(actors.select(actor, *by), actor)
    grouped = per_actor.groupBy(
        iso_week("first_day").alias("cohort_week"), "week_start", *by
    ).agg(F.count(F.lit(1)).alias("cohort_lawyers"), F.sum("came_back").alias("came_back"))
    complete = F.date_add("week_start", closes - 1) <= last_day
    return (
        grouped.withColumn("is_complete", complete)
        .withColumn("retained_lawyers", F.when(complete, F.col("came_back")))
        .withColumn("retention", ratio("retained_lawyers", "cohort_lawyers"))
        .drop("came_back")
    )


def retention_rate(cohorts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Retention over complete cohorts: sum of retained over sum of cohort sizes."""
    done = cohorts.where(F.col("is_complete"))
    return done.groupBy(*by).agg(
        F.sum("cohort_lawyers").alias("cohort_lawyers"),
        F.sum("retained_lawyers").alias("retained_lawyers"),
        ratio(F.sum("retained_lawyers"), F.sum("cohort_lawyers")).alias("retention"),
    )


def rolling_reach(
    sessions: DataFrame,
    lawyers: DataFrame,
    days: int = 84,
    actor: str = "lawyer_id",
    day: str = "activity_date",
) -> DataFrame:
    """Distinct actors in the last ``days`` days for every day, over the population.

    An active day keeps its actor counted until the next active day or until it
    falls out of the window, so each active day adds one +1 and one -1; no actor
    is repeated per day and no set is collected.
    """
    active = sessions.select(actor, F.col(day).alias("date")).distinct()
    following = F.lead("date").over(Window.partitionBy(actor).orderBy("date"))
    until = F.least(F.date_add("date", days), F.coalesce(following, F.date_add("date", days)))
    changes = (
        active.withColumn("until", until)
        .select(
            F.explode(
                F.array(
                    F.struct(F.col("date").alias("date"), F.lit(1).alias("delta")),
                    F.struct(F.col("until").alias("date"), F.lit(-1).alias("delta")),
                )
            ).alias("c")
        )
        .groupBy(F.col("c.date").alias("date"))
        .agg(F.sum("c.delta").alias("delta"))
    )
    bounds = sessions.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    spine = bounds.select(F.explode(F.sequence("a", "b")).alias("date"))
    population = lawyers.where(F.col("is_active")).agg(F.count(F.lit(1))).scalar()
    # one row per calendar day from here on
    order = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spine.join(changes, "date", "left")
        .withColumn("active_lawyers", F.sum(F.coalesce("delta", F.lit(0))).over(order))
        .withColumn("lawyers", population)
        .withColumn("adoption_rate", ratio("active_lawyers", "lawyers"))
        .drop("delta")
    )


def post_adoption_flag(time: DataFrame, sessions: DataFrame, min_sessions: int = 3) -> DataFrame:
    """Time lines with ``ai_sessions`` (NULL below the minimum) and ``is_post_adoption``.

    The count is over the whole window, and the day of the first session counts.
    """
    use = ai_pairs(sessions, min_sessions)
    return (
        time.join(use, ["lawyer_id", "matter_id"], "left")
        .withColumn(
            "is_post_adoption", F.coalesce(F.col("entry_date") >= F.col("first_session"), F.lit(False))
        )
    )


def ai_pairs(sessions: DataFrame, min_sessions: int = 3) -> DataFrame:
    return (
        sessions.groupBy("lawyer_id", "matter_id")
        .agg(F.count(F.lit(1)).alias("ai_sessions"), F.min("activity_date").alias("first_session"))
        .where(F.col("ai_sessions") >= min_sessions)
    )


def adoption_plateau(
    sessions: DataFrame, lawyers: DataFrame, group: str, since: int | None = None
) -> DataFrame:
    """Mean monthly distinct active lawyers over the population of each group."""
    months = active_months(sessions, "lawyer_id", "activity_date")
    if since is not None:
        months = months.where(F.col("year_month") >= since)
    monthly = (
        months.join(lawyers.select("lawyer_id", group), "lawyer_id")
        .groupBy("year_month", group)
        .agg(F.count(F.lit(1)).alias("active"))
    )
    mean = monthly.groupBy(group).agg(F.avg("active").alias("mean_monthly_active"))
    population = (
        lawyers.where(F.col("is_active")).groupBy(group).agg(F.count(F.lit(1)).alias("lawyers"))
    )
    return population.join(mean, group, "left").withColumn(
        "adoption", ratio("mean_monthly_active", "lawyers")
    )


def group_ratio(plateau: DataFrame, group: str, numerator: str, denominator: str) -> DataFrame:
    """Adoption of one group over that of another; NULL if the other has none."""

    def of(name: str) -> Column:
        return F.max(F.when(F.col(group) == name, F.col("adoption")))

    return plateau.agg(
        F.lit(numerator).alias("numerator"), F.lit(denominator).alias("denominator"), ratio(of(numerator), of(denominator)).alias("ratio")
    )


def never_adopted(sessions: DataFrame, lawyers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Active lawyers without any session, whatever the period."""
    users = sessions.select("lawyer_id").distinct().withColumn("__used", F.lit(True))
    flagged = lawyers.where(F.col("is_active")).join(users, "lawyer_id", "left")
    never = F.count(F.when(F.col("__used").isNull(), 1))
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lawyers"),
        never.alias("never_adopted"),
        ratio(never, F.count(F.lit(1))).alias("never_adopted_share"),
    )


def group_independence(lawyers: DataFrame, left: str = "level", right: str = "practice_group"):
    """Pearson chi-square of two lawyer attributes, with its degrees of freedom."""
    cells = lawyers.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(left).agg(F.sum("n").alias("row_total"))
    cols = cells.groupBy(right).agg(F.sum("n").alias("col_total"))
    total = cells.agg(F.sum("n")).scalar()
    # an empty cell adds its expectation; summed over a margin, expectations equal the total
    seen = cells.join(rows, left).join(cols, right)
    expected = F.col("row_total") * F.col("col_total") / total
    stat = seen.agg(
        F.sum((F.col("n") - expected) * (F.col("n") - expected) / expected).alias("seen"),
        F.sum(expected).alias("covered"),
        F.countDistinct(left).alias("rows"),
        F.countDistinct(right).alias("cols"),
    )
    return stat.select(
        (F.col("seen") + (total - F.col("covered"))).alias("chi_square"),
        ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("degrees_of_freedom"),
    )
