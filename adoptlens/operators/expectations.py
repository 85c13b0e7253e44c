"""Expectations of the data: does it hold what the reports rely on?

Sessions, outputs, seats and feed days are each read once into small facts that several
checks share; every check is one number with the range it should lie in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_where, is_sensitive, ratio, sum_where
from ..session import cut_lineage
from .adoption import adoption_plateau, group_independence, group_ratio
from .alerts import Star
from .governance import daily_sessions
from .percentiles import exact_percentiles
from .quality import incidents_by_coverage_quartile, naive_hours_comparison, worst_to_best_ratio
from .regression import fe_effect, pairwise_contrasts

# Check, lowest and highest value, whether the ends count.
RANGES = [
    ("level and practice group are independent", None, 21.0, False),
    ("adoption of one group over another", 2.0, 3.1, True),
    ("outputs of the area compared", 5000.0, None, True),
    ("median edit distance gap of two areas", 12.0, None, False),
    ("largest effect on hours is negative", None, 0.0, False),
    ("every interval of the effect excludes zero", None, 0.0, False),
    ("two arrangements can't be told apart", None, 3.0, False),
    ("treated entries of every arrangement", 5000.0, None, True),
    ("standard matters are used more than their share", 1.0, None, False),
    ("incidents of the worst over the best quartile", 1.8, None, True),
    ("token cost below 5% of all cost", None, 0.05, False),
    ("seats of a tool that were never opened", 20.0, None, True),
    ("idle seat share between 30% and 75%", 0.30, 0.75, False),
    ("p95 latency of a tool over the others on long tasks", 1.2, None, False),
    ("referential failures are chronic", 0.012, 0.03, False),
    ("worst busy day trips no status light", None, 0.10, False),
    ("every session has a known tier", 0.0, 0.0, True),
    ("sensitive use below a quarter of sessions", None, 0.25, False),
    ("error rate below 5%", None, 0.05, False),
    ("assisted pairs have a before period", None, 0.5, False),
]
BUSY = 50


@dataclass
class Compared:
    """What the checks that compare two things compare."""

    groups: tuple[str, str]
    areas: tuple[str, str]
    arrangements: tuple[str, str]
    tool: int
    long_review: str
    source: str


def _values(frame: DataFrame, **checks: Column) -> DataFrame:
    """One aggregate row as (check, value) rows; names are RANGES by position."""
    rows = [F.struct(F.lit(RANGES[int(k[1:])][0]).alias("check"), v.cast("double").alias("value")) for k, v in checks.items()]
    return frame.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def expectation_values(
    star: Star, time: DataFrame, incidents: DataFrame, effect: DataFrame, compared: Compared, effect_names: dict[str, str]
) -> DataFrame:
    """(check, value) of every check in RANGES."""
    total = F.sum
    # sessions once: days by lawyer, matter and tool, and the latencies of long tasks
    days = cut_lineage(daily_sessions(star.sessions))
    tiers = days.join(star.matters.select("matter_id", "confidentiality_tier"), "matter_id", "left")
    tier = F.col("confidentiality_tier")
    standard = tier == "Standard"
    matter_share = star.matters.agg(ratio(count_where(standard), F.count(F.lit(1)))).scalar()
    n, known = total("n"), total(F.when(tier.isNotNull(), F.col("n")))
    long_tasks = star.tasks.where(F.col("review_type") == compared.long_review).select("task_type_id")
    slow = star.sessions.where(F.col("status") == "Success").join(long_tasks, "task_type_id")
    slow = slow.select((F.col("tool_id") == compared.tool).alias("__own"), "latency_ms")
    p95 = exact_percentiles(slow, ["__own"], "latency_ms", {"p": 0.95})
    own = F.max(F.when(F.col("__own"), F.col("p")))
    others = F.max(F.when(~F.col("__own"), F.col("p")))
    # outputs once, by area
    areas = star.outputs.groupBy("practice_area").agg(
        F.count(F.lit(1)).alias("outputs"), F.percentile(F.col("edit_distance_pct").cast("double"), 0.5).alias("median")
    )

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("practice_area") == name, F.col(value)))

    # seats once, by tool and holder
    seats = star.seats.groupBy("tool_id", "lawyer_id").agg(
        F.count(F.lit(1)).alias("seats"), count_where(~F.col("used_in_month")).alias("idle"), total("licence_cost").alias("licence")
    )
    seats = cut_lineage(seats)
    users = days.select("tool_id", "lawyer_id").distinct()
    unopened = seats.where(F.col("tool_id") == compared.tool).join(users, ["tool_id", "lawyer_id"], "left_anti")
    licence = seats.agg(total("licence")).scalar()
    feed = star.health.where(F.col("source") == compared.source)
    loaded = F.col("rows_loaded")
    busiest = F.max(F.when(loaded >= BUSY, ratio("referential_failures", "rows_loaded")))
    shape = fe_effect(effect, **effect_names)
    pair = pairwise_contrasts(effect, **effect_names).where(
        F.array_sort(F.array("group_a", "group_b")) == F.array(*[F.lit(x) for x in sorted(compared.arrangements)])
    )
    plateau = adoption_plateau(star.sessions, star.lawyers, "practice_group")
    quartiles = incidents_by_coverage_quartile(star.outputs, incidents)
    pairs = naive_hours_comparison(time).where(F.col("assisted"))
    first = F.max
    parts = [
        _values(group_independence(star.lawyers), c0=first("chi_square")),
        _values(group_ratio(plateau, "practice_group", *compared.groups), c1=first("ratio")),
        _values(areas, c2=of(compared.areas[0], "outputs"), c3=of(compared.areas[0], "median") - of(compared.areas[1], "median")),
        _values(shape, c4=first("estimate_pct"), c5=first("ci_high_pct"), c7=F.min("treated_entries")),
        _values(pair, c6=first(F.abs("difference_pct"))),
        _values(
            tiers,
            c8=ratio(ratio(sum_where(standard, "n"), known), matter_share),
            c16=F.coalesce(total(F.when(tier.isNull(), F.col("n"))), F.lit(0)),
            c17=ratio(sum_where(is_sensitive(), "n"), known),
            c18=ratio(total("failed"), n),
            c10=ratio(total("cost"), total("cost") + licence),
        ),
        _values(worst_to_best_ratio(quartiles), c9=first("worst_to_best")),
        _values(unopened, c11=F.count(F.lit(1))),
        _values(seats, c12=ratio(total("idle"), total("seats"))),
        _values(p95, c13=ratio(own, others)),
        _values(feed, c14=ratio(total("referential_failures"), total("rows_loaded")), c15=busiest),
        _values(pairs, c19=first("share_without_before")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def judged(values: DataFrame) -> DataFrame:
    """(check, ok, value): whether a value lies in its range; an unknown value does not."""
    spark = values.sparkSession
    ranges = spark.createDataFrame(RANGES, "check string, low double, high double, closed boolean")
    value = F.col("value")
    above = F.col("low").isNull() | (value > F.col("low")) | (F.col("closed") & (value == F.col("low")))
    below = F.col("high").isNull() | (value < F.col("high")) | (F.col("closed") & (value == F.col("high")))
    joined = values.join(ranges, "check")
    return joined.select("check", F.coalesce(value.isNotNull() & above & below, F.lit(False)).alias("ok"), "value")
