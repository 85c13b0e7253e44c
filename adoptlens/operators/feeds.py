"""Feed runs and their health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import business_day, ratio

ZERO_LOAD_GUARD = 20


def feed_runs(loads: DataFrame, rejects: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source and calendar day, days without rows included.

    ``loads``: rows with source, run_date. ``rejects``: rows that failed a key
    check. ``sources``: source, first_day, last_day. A day with failures is a
    Warning; a day with failures and nothing loaded is Failed.
    """
    keys = ["source", "run_date"]
    spine = sources.select(
        "source", F.explode(F.sequence("first_day", "last_day")).alias("run_date")
    )
    arrived = loads.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_arrived"))
    refused = rejects.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_rejected"))
    return (
        spine.join(arrived, keys, "left")
        .join(refused, keys, "left")
        .fillna(0, ["rows_arrived", "rows_rejected"])
        .withColumn("rows_loaded", F.col("rows_arrived") - F.col("rows_rejected"))
        .withColumn("referential_failures", F.col("rows_rejected"))
        .withColumn(
            "run_status",
            F.when((F.col("rows_rejected") > 0) & (F.col("rows_loaded") == 0), "Failed")
            .when(F.col("rows_rejected") > 0, "Warning")
            .otherwise("Success"),
        )
        .drop("rows_arrived")
    )


def feed_health(runs: DataFrame, go_live: DataFrame) -> DataFrame:
    """Runs with the expected-active flag, the mean of the 30 previous runs, the last
    good run and its age, and unexpected zero loads.

    A run table has one row per source and day, so its windows stay small.
    """
    by_day = Window.partitionBy("source").orderBy("run_date")
    as_at = runs.agg(F.max("run_date")).scalar()
    loaded = F.col("rows_loaded") > 0
    return (
        runs.join(go_live.select("source", "live_from"), "source")
        .withColumn(
            "is_expected_active",
            business_day("run_date") & (F.col("run_date") >= F.col("live_from")),
        )
        .withColumn("trailing_mean", F.avg("rows_loaded").over(by_day.rowsBetween(-30, -1)))
        .withColumn(
            "last_good_run",
            F.max(F.when(loaded, F.col("run_date"))).over(
                by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn(
            "referential_failure_rate",
            ratio(F.col("referential_failures"), F.col("rows_loaded") + F.col("rows_rejected")),
        )
        .withColumn("load_vs_trailing_mean", ratio("rows_loaded", "trailing_mean"))
        .withColumn("hours_since_good_run", F.datediff(as_at, F.col("last_good_run")) * 24)
        .withColumn(
            "is_unexpected_zero_load",
            (F.col("rows_loaded") == 0)
            & F.col("is_expected_active")
            & (F.coalesce("trailing_mean", F.lit(0.0)) >= ZERO_LOAD_GUARD),
        )
    )
