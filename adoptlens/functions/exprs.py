"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENSITIVE_TIERS = ("Restricted", "Barrier")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as DOUBLE, NULL when the denominator is NULL or zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def count_where(condition: Column) -> Column:
    """Number of rows for which the condition is true; 0, never NULL."""
    return F.count(F.when(condition, F.lit(1)))


def sum_where(condition: Column, value: Column | str) -> Column:
    """Sum of value over matching rows, 0 when none match."""
    value = col(value)
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


# --- calendar -------------------------------------------------------------


def year_month(day: Column | str) -> Column:
    day = col(day)
    return F.year(day) * 100 + F.month(day)


def date_key(day: Column | str) -> Column:
    return (year_month(day) * 100 + F.dayofmonth(col(day))).cast("int")


def fiscal_year(day: Column | str, start_month: int = 7) -> Column:
    """Fiscal year named after the calendar year in which it ends."""
    day = col(day)
    if start_month == 1:
        return F.year(day)
    return F.year(day) + F.when(F.month(day) >= start_month, 1).otherwise(0)


def fiscal_quarter(day: Column | str, start_month: int = 7) -> Column:
    shifted = F.pmod(F.month(col(day)) - F.lit(start_month), F.lit(12))
    return (F.floor(shifted / 3) + 1).cast("int")


def week_start(day: Column | str) -> Column:
    return F.trunc(col(day), "week")


def iso_week(day: Column | str) -> Column:
    """ISO week label such as 2024-W01, with the ISO (not calendar) year."""
    day = col(day)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def business_day(day: Column | str) -> Column:
    return F.weekday(col(day)) < 5


def is_sensitive(tier: Column | str = "confidentiality_tier") -> Column:
    return col(tier).isin(*SENSITIVE_TIERS)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equality join in which NULL keys meet, with one column for each key."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    joined = left.join(other, same, how)
    if how == "full":
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__right_{k}")) for k in keys})
    return joined.drop(*[f"__right_{k}" for k in keys])
