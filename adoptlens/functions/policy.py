"""Review policy as an ordered rule over task, matter and output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import is_sensitive

# Verdicts and the label of the clause that decided them.
MANDATORY = "Mandatory"
OPTIONAL = "Optional"
DRIVER_TASK = "Task type"
DRIVER_TIER = "Confidentiality tier"
DRIVER_CLIENT = "Client-facing output"
DRIVER_NONE = "Not required"


def policy_driver() -> Column:
    """First clause that makes review mandatory, in order of precedence."""
    return (
        F.when(F.col("review_policy_base") == MANDATORY, DRIVER_TASK)
        .when(is_sensitive(), DRIVER_TIER)
        .when(F.col("is_client_facing"), DRIVER_CLIENT)
        .otherwise(DRIVER_NONE)
    )


def effective_review_policy(outputs: DataFrame, tasks: DataFrame, matters: DataFrame) -> DataFrame:
    """Outputs with ``effective_review_policy``, ``policy_driver`` and the joined attributes."""
    task_side = tasks.select("task_type_id", "review_policy_base", "review_type")
    matter_side = matters.select(
        "matter_id", "confidentiality_tier", "practice_area", "barrier_group_id"
    )
    joined = outputs.join(task_side, "task_type_id").join(matter_side, "matter_id")
    return joined.withColumn("policy_driver", policy_driver()).withColumn(
        "effective_review_policy",
        F.when(F.col("policy_driver") == DRIVER_NONE, OPTIONAL).otherwise(MANDATORY),
    )


def enrich_outputs(outputs: DataFrame, tasks: DataFrame, matters: DataFrame) -> DataFrame:
    """Outputs with the policy verdict and ``is_review_gap``."""
    policy = effective_review_policy(outputs, tasks, matters)
    return policy.withColumn(
        "is_review_gap",
        (F.col("effective_review_policy") == MANDATORY) & ~F.col("reviewed"),
    )


def is_mandatory() -> Column:
    return F.col("effective_review_policy") == MANDATORY
