"""Date spine with reporting keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exprs import business_day, date_key, fiscal_quarter, fiscal_year, iso_week, year_month


def with_calendar_keys(days: DataFrame, day: str = "date", fy_start_month: int = 7) -> DataFrame:
    d = F.col(day)
    return days.select(
        "*",
        date_key(d).alias("date_id"),
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMM").alias("month_name"),
        year_month(d).alias("year_month"),
        iso_week(d).alias("iso_year_week"),
        (F.weekday(d) + 1).alias("day_of_week"),
        business_day(d).alias("is_business_day"),
        fiscal_year(d, fy_start_month).alias("fy_year"),
        fiscal_quarter(d, fy_start_month).alias("fy_quarter"),
    )


def calendar(spark: SparkSession, start: str, end: str, fy_start_month: int = 7) -> DataFrame:
    """One row per day from start to end, both included."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    )
    return with_calendar_keys(days, "date", fy_start_month)


def calendar_of(facts: DataFrame, day: str, fy_start_month: int = 7) -> DataFrame:
    """The spine between the first and the last day of a fact table."""
    bounds = facts.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("date"))
    return with_calendar_keys(days, "date", fy_start_month)
