"""Running sums inside a row, in time linear in the length of the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that are summed together.
GROUP = 256


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column computed once, not once per use.

    The value is a plain column, which Spark compiles; the one-element generator above it
    only keeps later filters and uses from repeating it.
    """
    held = f"{name}__held"
    return df.withColumn(held, value).select("*", F.explode(F.array(held)).alias(name)).drop(held)


def with_running_sums(df: DataFrame, values: Column, first: Column, out: str) -> DataFrame:
    """Adds ``out``: ``first``, then the sum of it and the first 1, 2, ... integers.

    In two levels, groups of GROUP elements and the groups themselves, so that no list
    grows element by element over the whole length. Rows with no values are left out.
    """

    def running(some: Column, start: Column) -> Column:
        return F.aggregate(
            some, F.array(start), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n)
        )

    listed = once(df, "__values", values).where(F.size("__values") > 0)
    last = F.floor((F.size("__values") - 1) / F.lit(GROUP)).cast("int")
    groups = once(
        listed,
        "__groups",
        F.transform(F.sequence(F.lit(0), last), lambda g: F.slice("__values", g * GROUP + 1, F.lit(GROUP))),
    )
    sums = F.transform("__groups", lambda g: F.aggregate(g, F.lit(0), lambda acc, n: acc + n))
    based = once(groups, "__bases", running(sums, first))
    inside = F.transform(
        "__groups", lambda g, i: F.slice(running(g, F.get("__bases", i)), F.lit(1), F.size(g))
    )
    sums = F.concat(F.flatten(inside), F.array(F.element_at("__bases", -1)))
    return once(based, out, sums).drop("__values", "__groups", "__bases")
