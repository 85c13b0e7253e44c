"""Latest state of requests, their attempts, and configuration comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.events import REQUEST, REVIEW, instant
from ..functions.exprs import count_where, ratio
from ..functions.text import normalized
from .percentiles import exact_percentiles

# What makes two requests comparable.
COMPARISON_KEYS = (
    "source_id",
    "data_origin",
    "run_kind",
    "experiment_id",
    "case_version",
    "config_id",
    "prompt_version",
    "run_config_version",
    "provider",
    "requested_model",
)
READINESS_KEYS = (
    "source_id",
    "data_origin",
    "run_kind",
    "experiment_id",
    "case_version",
    "provider",
    "requested_model",
    "run_config_version",
)


def _latest(events: DataFrame, event_type: str) -> DataFrame:
    """The highest revision per request, by event id among equal ones, once.

    The winner is found on three narrow columns, which combine on the map side. Payloads
    move once, by request, and stay there for what is joined to a request next.
    """
    rows = events.where(F.col("event_type") == event_type)
    best = F.max(F.struct("revision", "event_id")).alias("__best")
    winners = rows.groupBy("request_id").agg(best).where(F.col("request_id").isNotNull())
    keep = [c for c in rows.columns if c not in ("request_id", "event_json")]
    return (
        rows.select("request_id", *keep)
        .join(winners, "request_id")
        .where((F.col("event_id") == F.col("__best.event_id")) & (F.col("revision") == F.col("__best.revision")))
        .drop("__best")
        .dropDuplicates(["request_id"])
    )


def _fold(attempts: Column, field: str, start: Column, step) -> Column:
    return F.aggregate(F.transform(attempts, lambda a: a[field]), start, step)


def attempt_rollup_columns(attempts: Column) -> dict[str, Column]:
    """Counts and totals over the attempts in the row; a total is NULL unless every
    attempt is known, and money needs one currency."""
    count = F.size(attempts)

    def known(field: str) -> Column:
        return F.size(F.filter(attempts, lambda a: a[field].isNotNull()))

    def total(field: str) -> Column:
        zero = F.lit(0).cast("bigint")
        summed = _fold(attempts, field, zero, lambda acc, x: acc + F.coalesce(x, F.lit(0)))
        return F.when(known(field) == count, summed)

    currencies = F.array_distinct(
        F.array_compact(F.transform(attempts, lambda a: a["currency"]))
    )
    money = _fold(
        attempts,
        "estimated_cost",
        F.lit(0).cast("decimal(24,12)"),
        lambda acc, x: (acc + F.coalesce(x, F.lit(0).cast("decimal(24,12)"))).cast("decimal(24,12)"),
    )
    priced = known("estimated_cost")
    one_currency = F.size(currencies) == 1
    return {
        "attempt_count": count,
        "retry_count": count - 1,
        "unknown_usage_attempts": F.size(
            F.filter(attempts, lambda a: a["input_tokens"].isNull() | a["output_tokens"].isNull())
        ),
        "input_tokens": total("input_tokens"),
        "output_tokens": total("output_tokens"),
        "cached_input_tokens": total("cached_input_tokens"),
        "estimated_cost": F.when((priced == count) & one_currency, money),
        "known_estimated_cost": F.when((F.size(currencies) <= 1) & (priced > 0), money),
        "currency": F.when(one_currency, F.get(currencies, 0)),
        "cost_known_attempts": priced,
    }


def attempt_rollup(requests: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    columns = attempt_rollup_columns(F.col("payload.attempts"))
    return requests.select(*keys, *[c.alias(n) for n, c in columns.items()])


def latest_requests(events: DataFrame) -> DataFrame:
    """Current revision of every request, flattened, with its review if that review
    names this revision and answer of a successful request. Order of arrival does
    not matter."""
    current = _latest(events, REQUEST)
    reviews = _latest(events, REVIEW).select(
        F.col("request_id").alias("__request"),
        F.col("payload").alias("review"),
        F.col("occurred_at").alias("reviewed_at"),
        F.col("revision").alias("review_revision"),
    )
    p = F.col("payload")
    attached = (
        (F.col("request_id") == F.col("__request"))
        & (F.col("review.request_revision") == F.col("revision"))
        & (F.col("review.answer_sha256") == p["answer_sha256"])
        & (p["status"] == "success")
    )
    joined = current.join(reviews, attached, "left")
    rollup = attempt_rollup_columns(p["attempts"])
    plain = [
        "experiment_id",
        "case_id",
        "case_version",
        "case_origin",
        "config_id",
        "prompt_version",
        "run_config_version",
        "provider",
        "requested_model",
        "response_model",
    ]
    return joined.select(
        "request_id",
        "event_id",
        "trace_id",
        "revision",
        "source_id",
        "data_origin",
        "run_kind",
        "occurred_at",
        *[p[f].alias(f) for f in plain],
        instant(p["started_at"]).alias("started_at"),
        instant(p["finished_at"]).alias("finished_at"),
        p["duration_ms"].alias("duration_ms"),
        p["status"].alias("status"),
        p["error_type"].alias("error_type"),
        p["auto_pass"].alias("auto_pass"),
        p["answer_sha256"].alias("answer_sha256"),
        p["attempts"].alias("attempts"),
        *[c.alias(n) for n, c in rollup.items()],
        F.col("review.review_method").alias("review_method"),
        F.col("review.reviewer_id").alias("reviewer_id"),
        "reviewed_at",
        "review_revision",
        F.col("review.task_pass").alias("human_task_pass"),
        F.col("review.citations_correct").alias("citations_correct"),
        F.col("review.major_rework").alias("major_rework"),
        F.col("review.edit_distance_ratio").alias("edit_distance_ratio"),
        F.col("review.reason_code").alias("review_reason_code"),
    )


def attempts(requests: DataFrame) -> DataFrame:
    """One row per attempt of the current revision."""
    return requests.select(
        "request_id",
        "trace_id",
        "source_id",
        "data_origin",
        "run_kind",
        "experiment_id",
        "case_id",
        "config_id",
        "revision",
        "started_at",
        F.inline("attempts"),
    )


def request_metrics(requests: DataFrame, by: Sequence[str] = COMPARISON_KEYS) -> DataFrame:
    """Reliability, quality and cost at any grouping.

    Human metrics cover human-reviewed requests only; cost is NULL unless every
    request is priced in one currency; cost per human pass needs every success reviewed.
    """
    by = list(by)
    one = F.count(F.lit(1))
    success = count_where(F.col("status") == "success")
    failed = count_where(F.col("status") == "failed")
    human = F.col("review_method") == "human"
    reviewed = human & F.col("human_task_pass").isNotNull()
    passed = count_where(F.col("auto_pass"))
    human_passed = count_where(human & F.col("human_task_pass"))
    priced = F.count("estimated_cost")
    currencies = F.countDistinct("currency")
    complete = (priced == one) & (currencies == 1)
    cost = F.sum("estimated_cost")
    all_reviewed = count_where((F.col("status") == "success") & reviewed) == success

    def human_mean(name: str) -> Column:
        return F.avg(F.when(human, F.col(name).cast("double")))

    base = requests.groupBy(*by).agg(
        one.alias("request_count"),
        F.countDistinct("case_id").alias("case_count"),
        success.alias("successful_requests"),
        failed.alias("failed_requests"),
        ratio(failed, one).alias("failure_rate"),
        F.sum("attempt_count").alias("attempt_count"),
        F.sum("retry_count").alias("retry_count"),
        (F.sum("attempt_count") - success).alias("failed_attempts"),
        F.sum("unknown_usage_attempts").alias("unknown_usage_attempts"),
        F.avg("duration_ms").alias("mean_request_ms"),
        passed.alias("auto_passed"),
        ratio(passed, one).alias("auto_pass_rate"),
        count_where(reviewed).alias("human_reviewed"),
        human_passed.alias("human_passed"),
        human_mean("human_task_pass").alias("human_pass_rate"),
        ratio(count_where(reviewed), success).alias("human_review_coverage"),
        human_mean("citations_correct").alias("citation_accuracy"),
        human_mean("major_rework").alias("major_rework_rate"),
        human_mean("edit_distance_ratio").alias("mean_edit_distance_ratio"),
        priced.alias("cost_known_requests"),
        ratio(priced, one).alias("cost_coverage"),
        F.when(currencies == 1, F.max("currency")).alias("currency"),
        F.when(currencies <= 1, F.sum("known_estimated_cost")).alias("known_estimated_cost"),
        F.when(complete, cost).alias("estimated_cost"),
        F.when(complete, ratio(cost, passed)).alias("cost_per_auto_pass"),
        F.when(complete & all_reviewed, ratio(cost, human_passed)).alias("cost_per_human_pass"),
    )
    p95 = exact_percentiles(requests, by, "duration_ms", {"p95_request_ms": 0.95})
    if not by:
        return base.withColumn("p95_request_ms", p95.select("p95_request_ms").scalar())
    renamed = p95.withColumnsRenamed({c: f"__{c}" for c in by})
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return base.join(renamed, match, "left").drop(*[f"__{c}" for c in by])


def config_comparison(requests: DataFrame) -> DataFrame:
    return request_metrics(requests, COMPARISON_KEYS)


def comparison_readiness(requests: DataFrame) -> DataFrame:
    """Per experiment scope: two configurations with the same cases as often, one
    prompt version each and one resolved model.

    Case counts are compared by their difference per case, so no case list is built.
    """
    keys = list(READINESS_KEYS)
    ends = requests.groupBy(*keys).agg(
        F.countDistinct("config_id").alias("configs"),
        F.min("config_id").alias("first_config"),
        F.max("config_id").alias("last_config"),
        F.countDistinct("response_model").alias("resolved_models"),
    )
    per_config = requests.groupBy(*keys, "config_id").agg(
        F.countDistinct("prompt_version").alias("prompts")
    )
    prompts = per_config.groupBy(*keys).agg(F.max("prompts").alias("max_prompts"))
    per_case = requests.groupBy(*keys, "case_id", "config_id").agg(F.count(F.lit(1)).alias("n"))
    balance = (
        per_case.join(ends.select(*keys, "first_config", "last_config"), keys)
        .withColumn(
            "signed",
            F.when(F.col("config_id") == F.col("first_config"), F.col("n"))
            .when(F.col("config_id") == F.col("last_config"), -F.col("n"))
            .otherwise(0),
        )
        .groupBy(*keys, "case_id")
        .agg(F.sum("signed").alias("difference"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("cases"),
            count_where(F.col("difference") != 0).alias("unbalanced_cases"),
        )
    )
    return (
        ends.join(prompts, keys)
        .join(balance, keys)
        .withColumn(
            "matched_case_repetitions", (F.col("configs") == 2) & (F.col("unbalanced_cases") == 0)
        )
        .withColumn("stable_prompt_versions", F.col("max_prompts") == 1)
        .withColumn(
            "comparison_ready",
            F.col("matched_case_repetitions")
            & F.col("stable_prompt_versions")
            & (F.col("resolved_models") == 1),
        )
        .withColumn("is_live", F.col("data_origin") == "observed")
        .drop("first_config", "last_config", "max_prompts")
    )


def grade_answers(answers: DataFrame, cases: DataFrame, clauses: DataFrame) -> DataFrame:
    """``auto_pass`` per answer.

    ``answers``: case_id, answer, clause_id, quote, abstain. ``cases``: case_id,
    document_id, answer, clause_id (NULL = the fact is absent). ``clauses``:
    document_id, clause_id, clause_text.
    """
    expected = cases.select(
        "case_id",
        "document_id",
        F.col("answer").alias("__answer"),
        F.col("clause_id").alias("__clause"),
    )
    text = clauses.select(
        F.col("document_id").alias("__doc"), F.col("clause_id").alias("__id"), "clause_text"
    )
    joined = answers.join(expected, "case_id").join(
        text,
        (F.col("document_id") == F.col("__doc")) & (F.col("__clause") == F.col("__id")),
        "left",
    )
    empty = F.lit("")
    present = (
        ~F.col("abstain")
        & (normalized(F.coalesce("answer", empty)) == normalized(F.coalesce("__answer", empty)))
        & (F.col("clause_id") == F.col("__clause"))
        & (F.coalesce("quote", empty) != "")
        & F.contains(F.col("clause_text"), F.col("quote"))
    )
    absent = (
        F.col("abstain")
        & F.col("answer").isNull()
        & F.col("clause_id").isNull()
        & F.col("quote").isNull()
    )
    verdict = F.when(F.col("__answer").isNull(), absent).otherwise(present)
    return joined.withColumn("auto_pass", F.coalesce(verdict, F.lit(False))).drop(
        "__answer", "__clause", "__doc", "__id", "clause_text"
    )


def review_revisions(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """New reviews turned into the next review revision of their request.

    ``reviews``: request_id, answer_sha256, decided_at and the decision columns. Rows
    that do not meet a successful request with the same answer get ``problem``.
    """
    from pyspark.sql.window import Window

    current = _latest(events, REQUEST).select(
        "request_id",
        "source_id",
        "data_origin",
        "run_kind",
        "trace_id",
        F.col("revision").alias("request_revision"),
        F.col("payload.status").alias("__status"),
        F.col("payload.answer_sha256").alias("__answer"),
    )
    stored = (
        events.where(F.col("event_type") == REVIEW)
        .groupBy("request_id")
        .agg(F.max("revision").alias("__last"))
    )
    order = Window.partitionBy("request_id").orderBy("decided_at", "reviewer_id")
    matched = reviews.withColumn("request_id", F.lower("request_id")).join(
        current, "request_id", "left"
    )
    problem = (
        F.when(F.col("__status").isNull(), "unknown_request")
        .when(F.col("__status") != "success", "request_not_successful")
        .when(F.col("answer_sha256") != F.col("__answer"), "answer_changed")
    )
    checked = matched.withColumn("problem", problem).join(stored, "request_id", "left")
    good = F.col("problem").isNull()
    position = F.sum(F.when(good, 1).otherwise(0)).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return checked.withColumn(
        "revision", F.when(good, F.coalesce("__last", F.lit(0)) + position)
    ).drop("__status", "__answer", "__last")
