"""Exact percentiles that never hold one whole group in one task.

``percentile`` keeps a value -> count map per group, so a group with a third of all rows
and a continuous measure would have to fit in one task. Here copies of a value collapse
first. As long as a group has too many distinct values around a wanted rank, a round cuts
them at quantiles of a sketch and counts each cell: the counts are exact, so they tell the
cell that holds the rank whatever the sketch was worth, and only that cell goes on. What is
left is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import join_null_safe
from ..session import cut_lineage

#: Distinct values that one task orders, and cells per round.
LIMIT, CELLS, ACCURACY = 1 << 20, 128, 10000


def _wanted(sizes: DataFrame, group: list[str], probs: dict[str, float], method: str) -> DataFrame:
    """(group, __name, __low, __high, __weight): the ranks from 0 that each answer takes, and
    how far it lies between their values."""
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()])
    rows = sizes.select(*group, "__n", F.explode(asked).alias("__a"))
    if method == "linear":
        position = F.col("__a.p") * (F.col("__n") - 1)
        low, high, weight = F.floor(position), F.ceil(position), position - F.floor(position)
    elif method == "nearest":
        low = high = F.greatest(F.lit(0), F.ceil(F.col("__a.p") * F.col("__n")) - 1)
        weight = F.lit(0.0)
    else:
        raise ValueError(f"unknown percentile method: {method}")
    return rows.select(
        *group, F.col("__a.name").alias("__name"), low.cast("long").alias("__low"), high.cast("long").alias("__high"), weight.alias("__weight")
    )


def _meets(start: Column, end: Column) -> Column:
    """Whether ranks from ``start`` to before ``end`` hold one that is wanted."""
    return (start <= F.col("__high")) & (end > F.col("__low"))


def _narrowed(values: DataFrame, wanted: DataFrame, by: list[str], group: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: the values of the cells that hold a wanted rank, per (group, __name), and
    the ranks among those."""
    grid = F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)])
    # written, so that the join below can split a hot group
    edges = cut_lineage(values.groupBy(*by).agg(F.percentile_approx("__v", grid, ACCURACY).alias("__edges")))
    cell = F.size(F.filter("__edges", lambda e: e < F.col("__v")))
    counted = (
        join_null_safe(values, edges, by)
        .groupBy(*by, cell.alias("__cell"))
        .agg(F.sum("__c").alias("__c"), F.min("__v").alias("__from"), F.max("__v").alias("__to"))
    )
    order = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("__end", F.sum("__c").over(order)).withColumn("__start", F.col("__end") - F.col("__c"))
    held = join_null_safe(placed, wanted, by).where(_meets(F.col("__start"), F.col("__end")))
    names = [*group, "__name"]
    chosen = held.groupBy(*names, "__low", "__high", "__weight").agg(
        F.min("__start").alias("__skip"), F.min("__from").alias("__from"), F.max("__to").alias("__to")
    )
    chosen = cut_lineage(chosen)
    on = by if "__name" in by else group
    rows = join_null_safe(values, chosen.select(*names, "__from", "__to"), on).where(F.col("__v").between(F.col("__from"), F.col("__to")))
    ranks = chosen.select(
        *names, (F.col("__low") - F.col("__skip")).alias("__low"), (F.col("__high") - F.col("__skip")).alias("__high"), "__weight"
    )
    return cut_lineage(rows.select(*names, "__v", "__c")), ranks


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probs: dict[str, float],
    method: str = "linear",
    limit: int = LIMIT,
) -> DataFrame:
    """One row per group with one column per entry of ``probs``.

    ``method="linear"`` interpolates between the two neighbouring ranks;
    ``method="nearest"`` returns the value at rank ``ceil(p * n)``. NULL values
    are ignored, and a group with no value has no row; NULL keys are a group. No task
    orders more than ``limit`` distinct values of a group.
    """
    keys = list(keys)
    group = keys or ["__all"]
    value = F.col(value) if isinstance(value, str) else value
    source = df.select(
        *[F.col(k) for k in keys],
        *([] if keys else [F.lit(1).alias("__all")]),
        value.cast("double").alias("__v"),
    ).where(F.col("__v").isNotNull())
    values = cut_lineage(source.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__c")))
    sizes = values.groupBy(*group).agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__d"))
    wanted, by = _wanted(sizes, group, probs, method), group
    largest = sizes.agg(F.max("__d")).first()[0]
    while largest and largest > limit:
        values, wanted = _narrowed(values, wanted, by, group)
        by = [*group, "__name"]
        now = values.groupBy(*by).count().agg(F.max("count")).first()[0]
        if now >= largest:
            break  # two ranks at either end of one long gap: cells can't get any smaller
        largest = now
    order = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("__end", F.sum("__c").over(order)).withColumn("__start", F.col("__end") - F.col("__c"))
    held = join_null_safe(placed, wanted, by).where(_meets(F.col("__start"), F.col("__end")))
    at = held.groupBy(*group, "__name", "__weight").agg(F.min("__v").alias("__a"), F.max("__v").alias("__b"))
    answer = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__weight")
    out = at.groupBy(*group).agg(*[F.max(F.when(F.col("__name") == name, answer)).alias(name) for name in probs])
    return out if keys else out.drop("__all")
