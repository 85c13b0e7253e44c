"""Data-quality checks: violation rows and named pass/fail expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, ratio


def row_violations(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per broken rule and row; each predicate must hold, NULL counts as broken."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def in_set(name: str, values: Sequence) -> Column:
    return F.col(name).isin(*values)


def in_range(name: str, low, high) -> Column:
    return F.col(name).between(low, high)


def present_iff(name: str, condition: Column) -> Column:
    """NULL exactly when the condition does not hold."""
    return F.col(name).isNotNull() == condition


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def missing_references(
    facts: DataFrame, dimension: DataFrame, key: str, dimension_key: str | None = None
) -> DataFrame:
    """Fact keys without a dimension row, with how many rows each has. Keys are counted
    before the join, so a hot key is one row."""
    used = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    known = dimension.select(F.col(dimension_key or key).alias(key)).distinct()
    return used.join(known, key, "left_anti")


def reference_failure_rate(
    facts: DataFrame, dimension: DataFrame, key: str, by: Sequence[str], dimension_key: str | None = None
) -> DataFrame:
    """Share of fact rows per group (source and day, say) without a dimension row."""
    used = facts.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    known = dimension.select(F.col(dimension_key or key).alias(key), F.lit(True).alias("__ok")).distinct()
    joined = used.join(known, key, "left")
    lost = F.sum(F.when(F.col("__ok").isNull(), F.col("n")).otherwise(0))
    return joined.groupBy(*by).agg(
        F.sum("n").alias("rows"), lost.alias("failures"), ratio(lost, F.sum("n")).alias("failure_rate")
    )


# Domains and conditions of the operations tables.
def session_rules() -> dict[str, Column]:
    return {
        "status_domain": in_set("status", ["Success", "Timeout", "Error"]),
        "retry_range": in_range("retry_count", 0, 255),
        "latency_not_negative": F.col("latency_ms") >= 0,
        "error_type_iff_not_success": present_iff("error_type", F.col("status") != "Success"),
    }


def matter_rules() -> dict[str, Column]:
    return {
        "tier_domain": in_set("confidentiality_tier", ["Standard", "Restricted", "Barrier"]),
        "fee_domain": in_set("fee_arrangement", ["Hourly", "Fixed Fee", "Capped"]),
        "barrier_group_iff_barrier": present_iff(
            "barrier_group_id", F.col("confidentiality_tier") == "Barrier"
        ),
    }


def incident_rules() -> dict[str, Column]:
    return {
        "severity_range": in_range("severity", 1, 4),
        "days_iff_resolved": present_iff("days_to_resolve", F.col("resolved")),
    }


def output_rules() -> dict[str, Column]:
    return {"edit_distance_range": in_range("edit_distance_pct", 0, 100)}


def task_rules() -> dict[str, Column]:
    return {
        "policy_domain": in_set("review_policy_base", ["Mandatory", "Optional", "None"]),
    }


def evaluation_rules() -> dict[str, Column]:
    """Row constraints of evaluation results."""
    gold = ["gold_character_recall", "any_gold_hit", "all_gold_covered", "context_precision"]
    answerable = F.col("is_answerable")
    none_set = F.lit(True)
    all_set = F.lit(True)
    for name in gold:
        none_set = none_set & F.col(name).isNull()
        all_set = all_set & F.col(name).isNotNull()
    zero = (
        (F.col("gold_character_recall") == 0)
        & (F.col("any_gold_hit") == F.lit(False))
        & (F.col("all_gold_covered") == F.lit(False))
        & (F.col("context_precision") == 0)
    )
    state_ok = F.col("response_state") == "ok"
    flags = (F.col("any_gold_hit") == (F.col("gold_character_recall") > 0)) & (
        F.col("all_gold_covered") == (F.col("gold_character_recall") == 1)
    )
    ranges = in_range("gold_character_recall", 0, 1) & in_range("context_precision", 0, 1)
    return {
        "partition_domain": in_set("partition", ["development", "evaluation"]),
        "quartile_range": in_range("length_quartile", 1, 4),
        "state_domain": in_set("response_state", ["ok", "error", "missing"]),
        "gold_nullness": F.when(answerable, all_set & ranges).otherwise(none_set),
        "flags_match_recall": F.when(answerable, flags).otherwise(F.lit(True)),
        "failure_scores_zero": state_ok
        | ((F.col("retrieved_characters") == 0) & (~answerable | zero)),
        "context_within_document": in_range("retrieved_characters", 0, F.col("document_characters")),
        "timing_of_ok_rows": ~state_ok | F.coalesce(F.col("retrieval_latency_ms") >= 0, F.lit(False)),
    }


def packet_violations(run: DataFrame, configs: DataFrame, cases: DataFrame) -> DataFrame:
    """Problems of one or more evaluation runs: (run_id, rule, case_id). Row constraints,
    duplicate and unknown keys, row count, pairing, budget and case identity."""
    key = ["run_id", "case_id"]
    rows = row_violations(cases, evaluation_rules(), key).select("run_id", "rule", "case_id")
    by_key = duplicate_keys(cases, ["run_id", "case_id", "config_id"]).select(
        "run_id", F.lit("duplicate_case").alias("rule"), "case_id"
    )
    unknown = cases.join(configs, ["run_id", "config_id"], "left_anti").select(
        "run_id", F.lit("unknown_configuration").alias("rule"), "case_id"
    )
    none = F.lit(None).cast("string")
    counts = cases.groupBy("run_id").agg(F.count(F.lit(1)).alias("__rows"))
    wrong_count = (
        run.join(counts, "run_id", "left")
        .where(~F.col("expected_rows").eqNullSafe(F.col("__rows")))
        .select("run_id", F.lit("row_count").alias("rule"), none.alias("case_id"))
    )
    wanted = configs.groupBy("run_id").agg(F.count(F.lit(1)).alias("__configs"))
    unpaired = (
        cases.groupBy(*key)
        .agg(F.countDistinct("config_id").alias("__n"))
        .join(wanted, "run_id")
        .where(F.col("__n") != F.col("__configs"))
        .select("run_id", F.lit("unpaired").alias("rule"), "case_id")
    )
    budget = run.select("run_id", "character_budget", "phase")
    # the run side has one row per run
    with_run = cases.join(budget, "run_id")
    size = F.least("character_budget", "document_characters")
    over = with_run.where(
        F.col("character_budget").isNotNull()
        & (F.col("response_state") == "ok")
        & (F.col("retrieved_characters") != size)
    ).select("run_id", F.lit("budget").alias("rule"), "case_id")
    phase = with_run.where(
        ((F.col("phase") == "development") & (F.col("partition") != "development"))
        | ((F.col("phase") == "fresh_evaluation") & (F.col("partition") != "evaluation"))
    ).select("run_id", F.lit("phase_partition").alias("rule"), "case_id")
    identity = (
        cases.groupBy(*key)
        .agg(
            F.countDistinct(
                F.struct(
                    "document_id",
                    "partition",
                    "category",
                    "length_quartile",
                    "document_characters",
                    "is_answerable",
                )
            ).alias("__n")
        )
        .where(F.col("__n") > 1)
        .select("run_id", F.lit("identity_changed").alias("rule"), "case_id")
    )
    out = rows
    for part in (by_key, unknown, wrong_count, unpaired, over, phase, identity):
        out = out.unionByName(part)
    return out


def prediction_violations(
    predictions: DataFrame,
    contexts: DataFrame,
    tasks: DataFrame,
    configs: DataFrame,
    docs: DataFrame,
) -> DataFrame:
    """Predictions that do not belong to the grid: unknown, duplicate, wrong document,
    chunks with an error, too many chunks, offsets outside the text."""
    key = ["case_id", "config_id"]
    unknown_case = predictions.join(tasks.select("case_id"), "case_id", "left_anti")
    unknown_config = predictions.join(configs.select("config_id"), "config_id", "left_anti")
    doubled = duplicate_keys(predictions, key)
    wrong = predictions.join(
        tasks.select("case_id", F.col("document_id").alias("__doc")), "case_id"
    ).where(F.col("document_id") != F.col("__doc"))
    with_error = contexts.join(
        predictions.where(F.col("status") == "error").select(*key), key, "left_semi"
    )
    many = (
        contexts.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("__n"))
        .join(configs.select("config_id", "top_k"), "config_id")
        .where(F.col("__n") > F.col("top_k"))
    )
    sizes = docs.select("document_id", F.length("text").alias("__len"))
    outside = (
        contexts.join(predictions.select(*key, "document_id"), key)
        .join(sizes, "document_id")
        .where((F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.col("__len")))
    )
    out = None
    for rule, frame in (
        ("unknown_case", unknown_case),
        ("unknown_configuration", unknown_config),
        ("duplicate_prediction", doubled),
        ("wrong_document", wrong),
        ("error_with_chunks", with_error),
        ("too_many_chunks", many),
        ("invalid_offsets", outside),
    ):
        part = frame.select(*key, F.lit(rule).alias("rule")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def reconcile(
    left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 1e-10
) -> DataFrame:
    """One row per difference: keys, field, left and right value as text.

    Floats agree within a relative or absolute tolerance; other fields must be equal,
    NULL equal to NULL. Rows on one side only report the field ``(row)``.
    """
    keys = list(keys)
    fields = [c for c in left.columns if c not in keys]
    floats = {f.name for f in left.schema if f.dataType.typeName() in ("double", "float")}
    a = left.select(*keys, F.struct(*fields).alias("__l"))
    b = right.select(*keys, F.struct(*fields).alias("__r"))
    joined = a.join(b, keys, "full")

    def differs(name: str) -> Column:
        x, y = F.col(f"__l.{name}"), F.col(f"__r.{name}")
        if name in floats:
            scale = F.greatest(F.abs(x), F.abs(y))
            close = F.abs(x - y) <= F.greatest(F.lit(tolerance), scale * tolerance)
            both = x.isNotNull() & y.isNotNull()
            return F.when(both, ~close).otherwise(~x.eqNullSafe(y))
        return ~x.eqNullSafe(y)

    def entry(name: str, condition: Column, x: Column, y: Column) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(name).alias("field"), x.alias("left_value"), y.alias("right_value")
            ),
        )

    one_side = F.col("__l").isNull() | F.col("__r").isNull()
    entries = [
        entry(
            "(row)",
            one_side,
            F.when(F.col("__l").isNotNull(), "present"),
            F.when(F.col("__r").isNotNull(), "present"),
        )
    ]
    for name in fields:
        entries.append(
            entry(
                name,
                ~one_side & differs(name),
                F.col(f"__l.{name}").cast("string"),
                F.col(f"__r.{name}").cast("string"),
            )
        )
    return joined.select(*keys, F.inline(F.array_compact(F.array(*entries))))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, frame in tables.items():
        part = frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
