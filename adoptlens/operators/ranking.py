"""Row numbers, prefix counts and ranks over a whole table without a one-task window.

A window with no partition key sorts everything in one task. Here a score is cut
into ordered buckets at quantiles of a sketch, so that an outlier or a long tail does
not fill one of them, bucket totals are summed (a table of at most ``BUCKETS`` rows per
group), and the exact order is settled inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import join_null_safe
from ..session import cut_lineage

BUCKETS = 256
ACCURACY = 10 * BUCKETS


def _edges(value: Column) -> Column:
    grid = F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)])
    return F.percentile_approx(value, grid, ACCURACY)


def _bucket(value: Column, edges: Column) -> Column:
    """Equal values share a bucket, and buckets keep their order."""
    return F.coalesce(F.size(F.filter(edges, lambda e: e < value)), F.lit(0))


def global_rank(
    df: DataFrame,
    score: str,
    tie: str,
    by: Sequence[str] = (),
    descending: bool = True,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Adds ``row_number`` (score order, then ``tie`` ascending) and ``average_rank``.

    ``tie`` must be a number that is unique inside a ``by`` group, or ``tie_break``
    columns settle what it leaves open. Rows with equal scores share ``average_rank``,
    the mean of the row numbers they occupy; NULL scores come last and are equal to each
    other. NULL is a ``by`` group of its own. A score held by a third of all rows is
    split by ranges of ``tie``.
    """
    by = list(by)
    own = by or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(1))
    signed = -F.col(score).cast("double") if descending else F.col(score).cast("double")
    # several branches read the rows; a checkpoint makes them read the same values
    rows = cut_lineage(
        rows.withColumn("__z", F.col(score).isNull()).withColumn("__s", F.coalesce(signed, F.lit(0.0)))
    )

    bounds = rows.groupBy(*own).agg(
        _edges(F.when(~F.col("__z"), F.col("__s"))).alias("__se"), _edges(F.col(tie)).alias("__te")
    )
    # scores: counts per distinct score, then a two-level running total
    score_bucket = F.when(F.col("__z"), F.lit(BUCKETS)).otherwise(_bucket(F.col("__s"), F.col("__se")))
    cells = (
        join_null_safe(rows, bounds, own)
        .withColumn("__tb", _bucket(F.col(tie), F.col("__te")))
        .withColumn("__sb", score_bucket)
        .drop("__se", "__te", "__z")
    )
    per_score = cells.groupBy(*own, "__sb", "__s").agg(F.count(F.lit(1)).alias("__n"))
    per_bucket = per_score.groupBy(*own, "__sb").agg(F.sum("__n").alias("__bn"))
    before = Window.partitionBy(*own).orderBy("__sb").rowsBetween(Window.unboundedPreceding, -1)
    bucket_start = per_bucket.select(
        *own, "__sb", F.coalesce(F.sum("__bn").over(before), F.lit(0)).alias("__b0")
    )
    inside = (
        Window.partitionBy(*own, "__sb").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    )
    score_start = join_null_safe(
        per_score.withColumn("__i0", F.coalesce(F.sum("__n").over(inside), F.lit(0))),
        bucket_start,
        [*own, "__sb"],
    ).select(*own, "__sb", "__s", "__n", (F.col("__b0") + F.col("__i0")).alias("__start"))
    # ties: counts per tie range inside one score, at most BUCKETS rows per score
    per_tie = cells.groupBy(*own, "__sb", "__s", "__tb").agg(F.count(F.lit(1)).alias("__tn"))
    tie_before = (
        Window.partitionBy(*own, "__sb", "__s")
        .orderBy("__tb")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = join_null_safe(
        per_tie.withColumn("__t", F.coalesce(F.sum("__tn").over(tie_before), F.lit(0))),
        score_start,
        [*own, "__sb", "__s"],
    ).select(*own, "__sb", "__s", "__tb", "__start", "__n", "__t")
    last = Window.partitionBy(*own, "__sb", "__s", "__tb").orderBy(tie, *tie_break)
    ranked = (
        join_null_safe(cells, starts, [*own, "__sb", "__s", "__tb"])
        .withColumn("row_number", F.col("__start") + F.col("__t") + F.row_number().over(last))
        .withColumn("average_rank", F.col("__start") + (F.col("__n") + 1) / 2.0)
    )
    drops = ["__s", "__sb", "__tb", "__start", "__n", "__t", *([] if by else ["__all"])]
    return ranked.drop(*drops)


def running_total(df: DataFrame, value: str, position: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``running``: sum of ``value`` over rows with ``position`` up to this one.

    ``position`` is the dense row number of ``global_rank``, so blocks of equal
    length are cut by division and only block totals are summed in one window.
    """
    by = list(by)
    own = by or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(1))
    rows = cut_lineage(rows).withColumn("__blk", F.floor((F.col(position) - 1) / F.lit(65536)))
    totals = rows.groupBy(*own, "__blk").agg(F.sum(value).alias("__bt"))
    before = Window.partitionBy(*own).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *own, "__blk", F.coalesce(F.sum("__bt").over(before), F.lit(0)).alias("__b0")
    )
    inside = (
        Window.partitionBy(*own, "__blk")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = (
        join_null_safe(rows.withColumn("__in", F.sum(value).over(inside)), starts, [*own, "__blk"])
        .withColumn("running", F.col("__b0") + F.col("__in"))
    )
    return out.drop("__blk", "__in", "__b0", *([] if by else ["__all"]))
