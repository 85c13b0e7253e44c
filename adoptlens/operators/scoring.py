"""Scores of retrieved contexts and of quoted evidence against gold spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_where, ratio
from ..functions.text import NONSPACE, TOKEN
from .intervals import interval_overlap, interval_union
from .percentiles import exact_percentiles

MAX_SPANS = 128


def gold_spans(references: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per answer span: case_id, document_id, start, end."""
    return (
        references.select("case_id", "document_id", F.explode("answers").alias("a"))
        .select(
            "case_id",
            "document_id",
            F.col("a.answer_start").cast("long").alias("start"),
            (F.col("a.answer_start") + F.length("a.text")).cast("long").alias("end"),
        )
    )


def gold_mismatches(references: DataFrame, docs: DataFrame) -> DataFrame:
    """References that cannot be trusted, with a reason. Nothing is repaired."""
    spans = (
        references.select("case_id", "document_id", F.explode("answers").alias("a"))
        .join(docs.select("document_id", "text"), "document_id", "left")
        .select(
            "case_id",
            F.col("a.answer_start").alias("start"),
            (F.col("a.answer_start") + F.length("a.text")).alias("end"),
            F.col("a.text").alias("quote"),
            "text",
        )
    )
    out_of_range = (
        (F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") >= F.col("end"))
    )
    quoted = F.expr("substring(text, cast(start as int) + 1, cast(end - start as int))")
    reason = (
        F.when(F.col("text").isNull(), "unknown_document")
        .when(out_of_range, "invalid_offsets")
        .when(~F.col("quote").rlike(f"(?U){NONSPACE}") | (quoted != F.col("quote")), "quote_mismatch")
    )
    bad_spans = spans.select("case_id", "start", reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )
    bad_rows = references.where(
        (F.col("is_impossible") != (F.size("answers") == 0)) | (F.size("answers") > MAX_SPANS)
    ).select(
        "case_id",
        F.lit(None).cast("int").alias("start"),
        F.lit("invalid_reference").alias("reason"),
    )
    return bad_spans.unionByName(bad_rows)


def _size(spans: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return spans.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))


def retrieval_states(tasks: DataFrame, docs: DataFrame) -> DataFrame:
    """(case_id, document_id, status, error_type) of every task, failures as rows: a
    document that is missing, without words or without a token, or a query without one,
    is an error and retrieves nothing."""
    known = docs.select("document_id", "text")
    text, query = F.col("text"), F.col("query")
    error = (
        F.when(text.isNull(), "unknown_document")
        .when(~text.rlike(f"(?U){NONSPACE}"), "empty_document")
        .when(~text.rlike(TOKEN), "empty_vocabulary")
        .when(~F.coalesce(query.rlike(TOKEN), F.lit(False)), "invalid_query")
    )
    states = tasks.select("case_id", "document_id", "query").join(known, "document_id", "left")
    return states.select(
        "case_id", "document_id", F.when(error.isNull(), "ok").otherwise("error").alias("status"), error.alias("error_type")
    )


def score_retrieval(
    expected: DataFrame, predictions: DataFrame, contexts: DataFrame, gold: DataFrame
) -> DataFrame:
    """One row per expected (case_id, config_id), whatever was returned.

    ``expected``: the task x configuration grid with ``is_impossible`` and any case
    columns. ``predictions``: case_id, config_id, status (ok or error). ``contexts``:
    case_id, config_id, start, end. Unanswerable cases have NULL quality; a missing
    or failed answerable case scores 0.
    """
    keys = ["case_id", "config_id"]
    ok = predictions.where(F.col("status") == "ok").select(*keys)
    used = contexts.select(*keys, "start", "end").join(ok, keys, "left_semi")
    merged = interval_union(used, keys)
    unique = _size(merged, keys, "retrieved_characters")
    raw = _size(used, keys, "retrieved_characters_with_overlap")
    gold_size = _size(interval_union(gold.select("case_id", "start", "end"), ["case_id"]), ["case_id"], "gold_characters")
    shared = interval_overlap(gold.select("case_id", "start", "end"), merged, ["case_id"])
    answerable = ~F.col("is_impossible")
    hit = F.coalesce("overlap", F.lit(0))
    return (
        expected.join(predictions.select(*keys, "status"), keys, "left")
        .withColumn("response_state", F.coalesce("status", F.lit("missing")))
        .drop("status")
        .join(unique, keys, "left")
        .join(raw, keys, "left")
        .join(shared, keys, "left")
        .join(gold_size, "case_id", "left")
        .fillna(0, ["retrieved_characters", "retrieved_characters_with_overlap"])
        .withColumn(
            "gold_character_recall", F.when(answerable, ratio(hit, F.col("gold_characters")))
        )
        .withColumn("any_gold_hit", F.when(answerable, hit > 0))
        .withColumn("all_gold_covered", F.when(answerable, hit == F.col("gold_characters")))
        .withColumn(
            "context_precision",
            F.when(
                answerable,
                F.coalesce(ratio(hit, F.col("retrieved_characters")), F.lit(0.0)),
            ),
        )
        .drop("overlap", "gold_characters")
    )


def eval_summary(
    scores: DataFrame,
    sets: Sequence[Sequence[str]] = (
        ("config_id",),
        ("config_id", "category"),
        ("config_id", "length_quartile"),
    ),
    latency: str | None = None,
) -> DataFrame:
    """Macro means overall, per category and per length band in one pass.

    ``grouping`` names the set; columns outside it are NULL. With ``latency`` the
    nearest-rank p50 and p95 over ok rows are added.
    """
    columns: list[str] = []
    for s in sets:
        columns.extend(c for c in s if c not in columns)
    answerable = ~F.col("is_impossible")

    def mean(value: Column) -> Column:
        return F.avg(F.when(answerable, value.cast("double")))

    state = F.col("response_state")
    label = F.lit(None).cast("string")
    for s in sets:
        present = F.lit(True)
        for c in columns:
            present = present & (F.grouping(c) == (0 if c in s else 1))
        label = F.when(present, F.lit("+".join(s))).otherwise(label)
    summary = scores.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        label.alias("grouping"),
        F.countDistinct("document_id").alias("documents"),
        F.count(F.lit(1)).alias("tasks"),
        count_where(answerable).alias("answerable"),
        count_where(~answerable).alias("unanswerable"),
        count_where(state == "ok").alias("successful_queries"),
        count_where(state == "error").alias("failed_queries"),
        count_where(state == "missing").alias("missing_queries"),
        mean(F.col("gold_character_recall")).alias("macro_gold_character_recall"),
        mean(F.col("any_gold_hit").cast("int")).alias("any_gold_hit_rate"),
        mean(F.col("all_gold_covered").cast("int")).alias("all_gold_covered_rate"),
        mean(F.col("context_precision")).alias("macro_context_precision"),
        F.avg("retrieved_characters").alias("mean_retrieved_characters"),
        F.avg("retrieved_characters_with_overlap").alias("mean_retrieved_characters_with_overlap"),
        F.avg(F.when(~answerable, F.col("retrieved_characters"))).alias(
            "unanswerable_mean_retrieved_characters"
        ),
    )
    if latency is None:
        return summary
    per_set = []
    for s in sets:
        p = exact_percentiles(
            scores.where(state == "ok"),
            list(s),
            latency,
            {"latency_p50": 0.5, "latency_p95": 0.95},
            method="nearest",
        ).withColumn("grouping", F.lit("+".join(s)))
        for c in columns:
            if c not in s:
                p = p.withColumn(c, F.lit(None).cast(scores.schema[c].dataType))
        per_set.append(p.select("grouping", *columns, "latency_p50", "latency_p95"))
    latencies = per_set[0]
    for p in per_set[1:]:
        latencies = latencies.unionByName(p)
    renamed = latencies.withColumnsRenamed({c: f"__{c}" for c in ["grouping", *columns]})
    match = F.lit(True)
    for c in ["grouping", *columns]:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return summary.join(renamed, match, "left").drop(*[f"__{c}" for c in ["grouping", *columns]])


def paired_changes(scores: DataFrame, left: str, right: str) -> DataFrame:
    """Per answerable case: recall before and after, gain, full coverage won or lost."""
    def of(config: str, name: str) -> Column:
        return F.max(F.when(F.col("config_id") == config, F.col(name)))

    pairs = (
        scores.where(~F.col("is_impossible") & F.col("config_id").isin(left, right))
        .groupBy("case_id", "category")
        .agg(
            of(left, "gold_character_recall").alias("before"),
            of(right, "gold_character_recall").alias("after"),
            of(left, "all_gold_covered").alias("full_before"),
            of(right, "all_gold_covered").alias("full_after"),
        )
    )
    return (
        pairs.withColumn("recall_delta", F.col("after") - F.col("before"))
        .withColumn("full_gained", ~F.col("full_before") & F.col("full_after"))
        .withColumn("full_lost", F.col("full_before") & ~F.col("full_after"))
        .withColumn(
            "change",
            F.when(F.col("recall_delta") > 0, "improved")
            .when(F.col("recall_delta") < 0, "regressed")
            .otherwise("unchanged"),
        )
    )


def summarize_changes(changes: DataFrame) -> DataFrame:
    return changes.agg(
        F.count(F.lit(1)).alias("positive_tasks"),
        count_where(F.col("change") == "improved").alias("improved"),
        count_where(F.col("change") == "regressed").alias("regressed"),
        count_where(F.col("change") == "unchanged").alias("unchanged"),
        count_where(F.col("full_gained")).alias("fully_covered_gained"),
        count_where(F.col("full_lost")).alias("fully_covered_lost"),
        (F.avg("recall_delta") * 100).alias("mean_recall_gain_pp"),
    )


def acceptance_decision(scores: DataFrame, left: str, right: str) -> DataFrame:
    """One row: full coverage strictly up, recall not lower, nothing lost, all arms complete."""
    overall = eval_summary(scores, sets=(("config_id",),))

    def of(config: str, name: str) -> Column:
        return F.max(F.when(F.col("config_id") == config, F.col(name)))

    full, recall = "all_gold_covered_rate", "macro_gold_character_recall"
    lost = summarize_changes(paired_changes(scores, left, right)).select(
        "fully_covered_lost"
    ).scalar()
    checks = overall.agg(
        F.coalesce(of(right, full) > of(left, full), F.lit(False)).alias(
            "full_coverage_strictly_improves"
        ),
        F.coalesce(of(right, recall) >= of(left, recall), F.lit(False)).alias(
            "mean_recall_not_lower"
        ),
        (F.sum(F.col("failed_queries") + F.col("missing_queries")) == 0).alias("all_arms_complete"),
    ).withColumn("no_complete_task_lost", lost == 0)
    return checks.withColumn(
        "qualifies",
        F.col("full_coverage_strictly_improves")
        & F.col("mean_recall_not_lower")
        & F.col("all_arms_complete")
        & F.col("no_complete_task_lost"),
    )


def choose_candidate(scores: DataFrame, baseline: str) -> DataFrame:
    """Best configuration but the baseline: recall, then full coverage, then id. An
    incomplete run, or one without answerable cases, chooses nothing."""
    overall = eval_summary(scores, sets=(("config_id",),))
    usable = (F.col("failed_queries") + F.col("missing_queries") == 0) & F.col(
        "macro_gold_character_recall"
    ).isNotNull()
    complete = overall.agg(F.min(usable)).scalar()
    return (
        overall.where((F.col("config_id") != baseline) & complete)
        .orderBy(
            F.col("macro_gold_character_recall").desc(),
            F.col("all_gold_covered_rate").desc(),
            F.col("config_id"),
        )
        .limit(1)
    )


def grade_evidence(cases: DataFrame, responses: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per case with state, outcome and evidence metrics.

    ``cases``: case_id, document_id, category, is_impossible, answers. ``responses``:
    case_id, document_id, status, abstain, spans array<struct<start,end,quote>>. One
    bad span makes the whole response invalid; metrics of unanswerable cases are NULL.
    """
    spans = F.col("spans")
    answered = responses.select(
        "case_id", F.col("document_id").alias("__doc"), "status", "abstain", "spans"
    ).join(cases.select("case_id", F.col("document_id")), "case_id")
    text = answered.join(docs.select("document_id", "text"), "document_id")

    def good(s: Column) -> Column:
        size = F.length("text")
        inside = (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= size)
        quote = F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.coalesce(inside & s["quote"].rlike(f"(?U){NONSPACE}") & (quote == s["quote"]), F.lit(False))

    consistent = (
        (F.col("status") == "ok")
        & F.col("abstain").isNotNull()
        & spans.isNotNull()
        & (F.size(spans) <= MAX_SPANS)
        & (F.col("abstain") == (F.size(spans) == 0))
    )
    error_ok = F.col("abstain").isNull() & (F.size(spans) == 0)
    envelope = F.col("__doc") == F.col("document_id")
    state = (
        F.when(~envelope, "invalid")
        .when(F.col("status") == "error", F.when(error_ok, "error").otherwise("invalid"))
        .when(F.coalesce(consistent, F.lit(False)) & F.forall(spans, good), "valid")
        .otherwise("invalid")
    )
    checked = text.select("case_id", state.alias("response_state"), "abstain", "spans")
    valid = checked.where(F.col("response_state") == "valid")
    predicted = valid.select("case_id", F.inline("spans")).select(
        "case_id", F.col("start").cast("long"), F.col("end").cast("long")
    )
    merged_prediction = interval_union(predicted, ["case_id"])
    gold = interval_union(gold_spans(cases, docs).select("case_id", "start", "end"), ["case_id"])
    sizes = _size(merged_prediction, ["case_id"], "predicted_size")
    gold_sizes = _size(gold, ["case_id"], "gold_size")
    shared = interval_overlap(gold, merged_prediction, ["case_id"])
    # equal unions have equal sizes and share all of them
    rows = (
        cases.select("case_id", "document_id", "category", "is_impossible")
        .join(checked.drop("spans"), "case_id", "left")
        .join(sizes, "case_id", "left")
        .join(gold_sizes, "case_id", "left")
        .join(shared, "case_id", "left")
        .withColumn("response_state", F.coalesce("response_state", F.lit("missing")))
    )
    is_valid = F.col("response_state") == "valid"
    answerable = ~F.col("is_impossible")
    abstained = is_valid & F.coalesce("abstain", F.lit(False))
    hit = F.coalesce("overlap", F.lit(0))
    exact = (hit > 0) & (hit == F.col("predicted_size")) & (hit == F.col("gold_size"))
    outcome = (
        F.when(~is_valid, F.col("response_state"))
        .when(F.col("is_impossible"), F.when(abstained, "correct_abstention").otherwise("false_answer"))
        .when(abstained, "incorrect_abstention")
        .when(exact, "exact_evidence")
        .when(hit > 0, "partial_evidence")
        .otherwise("off_target_evidence")
    )
    precision = F.coalesce(ratio(hit, F.col("predicted_size")), F.lit(0.0))
    recall = F.coalesce(ratio(hit, F.col("gold_size")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return rows.select(
        "case_id",
        "document_id",
        "category",
        "is_impossible",
        "response_state",
        outcome.alias("outcome"),
        (F.col("is_impossible") & abstained).alias("correct_abstention"),
        (answerable & abstained).alias("incorrect_abstention"),
        (F.col("is_impossible") & is_valid & ~abstained).alias("false_answer"),
        F.when(answerable, precision).alias("evidence_precision"),
        F.when(answerable, recall).alias("evidence_recall"),
        F.when(answerable, f1).alias("evidence_f1"),
        F.when(answerable, F.coalesce(hit == F.col("gold_size"), F.lit(False))).alias(
            "all_gold_covered"
        ),
        F.when(answerable, F.coalesce(exact, F.lit(False))).alias("exact_evidence_union"),
    )


def summarize_evidence(graded: DataFrame) -> DataFrame:
    """Overall (category NULL, ``is_overall``) and per category, in one pass."""
    answerable = ~F.col("is_impossible")

    def mean(value: Column, rows: Column) -> Column:
        return F.avg(F.when(rows, value.cast("double")))

    state = F.col("response_state")
    one = F.count(F.lit(1))
    return graded.groupingSets([[], [F.col("category")]], "category").agg(
        (F.grouping("category") == 1).alias("is_overall"),
        one.alias("expected"),
        count_where(state == "valid").alias("valid"),
        count_where(state == "missing").alias("missing"),
        count_where(state == "invalid").alias("invalid"),
        count_where(state == "error").alias("error"),
        ratio(count_where(state == "valid"), one).alias("valid_response_rate"),
        count_where(answerable).alias("answerable"),
        mean(F.col("evidence_precision"), answerable).alias("evidence_precision_macro"),
        mean(F.col("evidence_recall"), answerable).alias("evidence_recall_macro"),
        mean(F.col("evidence_f1"), answerable).alias("evidence_f1_macro"),
        mean(F.col("all_gold_covered").cast("int"), answerable).alias("all_gold_covered_rate"),
        mean(F.col("exact_evidence_union").cast("int"), answerable).alias(
            "exact_evidence_union_rate"
        ),
        count_where(F.col("incorrect_abstention")).alias("incorrect_abstention_count"),
        mean(F.col("incorrect_abstention").cast("int"), answerable).alias(
            "incorrect_abstention_rate"
        ),
        count_where(~answerable).alias("unanswerable"),
        count_where(F.col("correct_abstention")).alias("correct_abstention_count"),
        mean(F.col("correct_abstention").cast("int"), ~answerable).alias("correct_abstention_rate"),
        count_where(F.col("false_answer")).alias("false_answer_count"),
        mean(F.col("false_answer").cast("int"), ~answerable).alias("false_answer_rate"),
    )


def config_summary(cases: DataFrame) -> DataFrame:
    """Run x partition x configuration; averages skip NULL quality of unanswerable cases."""
    state = F.col("response_state")
    return cases.groupBy("run_id", "partition", "config_id", "config_role").agg(
        F.count(F.lit(1)).alias("query_rows"),
        F.countDistinct("case_id").alias("questions"),
        F.countDistinct("document_id").alias("documents"),
        count_where(F.col("is_answerable")).alias("answerable"),
        count_where(~F.col("is_answerable")).alias("unanswerable"),
        count_where(state == "error").alias("failed_queries"),
        count_where(state == "missing").alias("missing_queries"),
        F.avg("gold_character_recall").alias("macro_gold_character_recall"),
        F.avg(F.col("all_gold_covered").cast("double")).alias("all_gold_covered_rate"),
        F.avg(F.col("any_gold_hit").cast("double")).alias("any_gold_hit_rate"),
        F.avg("context_precision").alias("macro_context_precision"),
        F.avg("retrieved_characters").alias("mean_retrieved_characters"),
    )
