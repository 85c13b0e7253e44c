"""How well a ranking finds known cases: hits, precision and recall per list length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_where, is_sensitive, ratio
from ..functions.policy import is_mandatory
from .governance import MIN_MANDATORY
from ..session import cut_lineage
from .ranking import global_rank, running_total

LIST_SIZES = (10, 20, 30, 50)


def screen_features(sessions: DataFrame, enriched: DataFrame, matters: DataFrame) -> DataFrame:
    """Per lawyer: review completion and sensitive use over the whole window."""
    coverage = (
        enriched.where(is_mandatory())
        .groupBy("lawyer_id")
        .agg(
            F.count(F.lit(1)).alias("mandatory_outputs"),
            ratio(count_where(F.col("reviewed")), F.count(F.lit(1))).alias("completion"),
        )
    )
    per_matter = sessions.groupBy("lawyer_id", "matter_id").agg(F.count(F.lit(1)).alias("n"))
    use = (
        per_matter.join(matters.select("matter_id", "confidentiality_tier"), "matter_id")
        .groupBy("lawyer_id")
        .agg(
            F.sum("n").alias("sessions"),
            F.sum(F.when(is_sensitive(), F.col("n")).otherwise(0)).alias("sensitive_count"),
        )
        .withColumn("sensitive_rate", ratio("sensitive_count", "sessions"))
    )
    return coverage.join(use, "lawyer_id", "left")


def score_screens(features: DataFrame, min_mandatory: int = MIN_MANDATORY) -> DataFrame:
    """Long table (screen, lawyer_id, score); a higher score comes earlier."""
    eligible = cut_lineage(features.where(F.col("mandatory_outputs") >= min_mandatory))
    plain = eligible.select(
        "lawyer_id",
        F.explode(
            F.create_map(
                F.lit("completion"),
                -F.col("completion"),
                F.lit("sensitive_rate"),
                F.col("sensitive_rate"),
                F.lit("sensitive_count"),
                F.col("sensitive_count").cast("double"),
            )
        ).alias("screen", "score"),
    )
    low_first = global_rank(
        eligible.select("lawyer_id", "completion"), "completion", "lawyer_id", descending=False
    ).select("lawyer_id", F.col("average_rank").alias("r1"))
    high_first = global_rank(
        eligible.select("lawyer_id", "sensitive_rate"), "sensitive_rate", "lawyer_id"
    ).select("lawyer_id", F.col("average_rank").alias("r2"))
    combined = low_first.join(high_first, "lawyer_id").select(
        "lawyer_id",
        F.lit("rank_sum").alias("screen"),
        (1 / (F.col("r1") + F.col("r2"))).alias("score"),
    )
    return plain.select("screen", "lawyer_id", "score").unionByName(
        combined.select("screen", "lawyer_id", "score")
    )


def evaluate_screens(
    scores: DataFrame,
    labels: DataFrame,
    cohort: DataFrame,
    list_sizes: Sequence[int] = LIST_SIZES,
) -> DataFrame:
    """Per screen and list length: true positives, precision, both recalls, average
    precision. ``labels``: ids of the cohort; ``cohort``: the full cohort, screenable
    or not. Ties are ordered by lawyer_id."""
    marked = scores.join(
        labels.select("lawyer_id", F.lit(1).alias("__hit")).distinct(), "lawyer_id", "left"
    ).withColumn("hit", F.coalesce("__hit", F.lit(0)))
    ranked = global_rank(marked.drop("__hit"), "score", "lawyer_id", by=["screen"])
    hits = running_total(ranked, "hit", "row_number", by=["screen"])
    precision_at_hit = F.when(F.col("hit") == 1, F.col("running") / F.col("row_number"))
    cohort_size = cohort.agg(F.countDistinct("lawyer_id")).scalar()
    per_screen = hits.groupBy("screen").agg(
        F.avg(precision_at_hit).alias("average_precision"),
        F.sum("hit").alias("positives"),
        *[
            F.sum(F.when(F.col("row_number") <= k, F.col("hit")).otherwise(0)).alias(f"tp_{k}")
            for k in list_sizes
        ],
    )
    sizes = F.array(
        *[F.struct(F.lit(k).alias("list_size"), F.col(f"tp_{k}").alias("tp")) for k in list_sizes]
    )
    long = per_screen.select("screen", "average_precision", "positives", F.explode(sizes).alias("s"))
    return long.select(
        "screen",
        F.col("s.list_size").alias("list_size"),
        F.col("s.tp").alias("true_positives"),
        ratio(F.col("s.tp"), F.col("s.list_size")).alias("precision"),
        ratio(F.col("s.tp"), F.col("positives")).alias("recall_of_screenable"),
        ratio(F.col("s.tp"), cohort_size).alias("recall_of_cohort"),
        "average_precision",
    )


def top_list(features: DataFrame, score: str, size: int, ascending: bool = True) -> DataFrame:
    """The first ``size`` lawyers by score, ties by id: a report list."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return features.orderBy(order, F.col("lawyer_id")).limit(size)
