"""Registered queries over request telemetry, in batch and as streams.

Events become JSON lines first and are read back by the parser, so every query runs
the same path a file of events would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import parse_events, validate_events
from ..operators import cost, ingestion, monitor, requests
from ..session import cut_lineage, shared_dir
from ..streaming import ingest, windows
from ..streaming import monitor as stream_monitor
from . import bindings as b
from .bindings import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CHECK_MINUTES = 60
STALE_MINUTES = 120


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _uuid(digest: Column) -> Column:
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, at, size) for at, size in parts])


def _stamp(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def event_lines(
    events: DataFrame, source: Column | None = None, faults: bool = True
) -> DataFrame:
    """Rows of ``events`` as JSON lines: views are heartbeats, sign-ups are reviews, the
    rest are completed requests. Two neighbouring events share a request."""
    number = F.floor(F.col("event_id") / 2).cast("long")

    def digest(letter: str, of: Column) -> Column:
        return F.sha2(F.concat(F.lit(letter), of.cast("string")), 256)

    # what is used more than once, inside lists in particular, is computed once a row
    events = events.withColumns(
        {
            "__k": b.props_k(),
            "__number": number,
            "__odd": (F.col("event_id") % 2).cast("int"),
            "__stamp": _stamp(F.col("ts").cast("timestamp")),
            "__event": digest("e", F.col("event_id")),
            "__request": digest("r", number),
            "__trace": digest("t", number),
            "__source": number if source is None else source,
        }
    )
    k, number, odd, stamp = F.col("__k"), F.col("__number"), F.col("__odd"), F.col("__stamp")
    kind = F.col("event_type")
    failed = kind == "error"

    def sha(revision: Column) -> Column:
        return F.sha2(F.concat_ws("/", number.cast("string"), revision.cast("string")), 256)

    def attempt(i: Column) -> Column:
        last = i == k % 3 + 1
        lost = failed | ~last
        known = ~(last & (k % 10 == 0))
        given, cached = 100 + k + i * 10, k % 7 * 10
        # a few rows claim more cached than given tokens
        if faults:
            cached = F.when(k >= 98, given + 1).otherwise(cached)
        price = (given * 2 + (20 + i) * 5).cast("decimal(24,12)") * F.lit("0.001").cast("decimal(4,3)")
        none = F.lit(None)
        return F.struct(
            i.alias("attempt_number"),
            (F.col("value") * 10 + i).alias("duration_ms"),
            F.when(lost, "failed").otherwise("success").alias("status"),
            F.when(lost, "Timeout").otherwise(none).alias("error_type"),
            none.cast("string").alias("provider_request_id"),
            F.when(known, given).alias("input_tokens"),
            F.when(known, 20 + i).alias("output_tokens"),
            F.when(known, cached).alias("cached_input_tokens"),
            F.when(known, price.cast("decimal(24,12)")).alias("estimated_cost"),
            F.when(known, F.when(k == 50, "USD").otherwise("AUD")).alias("currency"),
            F.when(known, "rates-1").alias("rate_version"),
        )

    attempts = F.transform(F.sequence(F.lit(1), k % 3 + 1), attempt)
    request = F.struct(
        F.concat(F.lit("exp"), (number % 2).cast("string")).alias("experiment_id"),
        F.concat(F.lit("case"), F.floor(number / 4 % 25).cast("string")).alias("case_id"),
        F.lit("v1").alias("case_version"),
        F.lit("self_authored_synthetic").alias("case_origin"),
        F.concat(F.lit("cfg"), F.floor(number / 2 % 2).cast("string")).alias("config_id"),
        F.lit("p1").alias("prompt_version"),
        F.lit("r1").alias("run_config_version"),
        F.lit("replay").alias("provider"),
        F.lit("m1").alias("requested_model"),
        F.lit("m1").alias("response_model"),
        stamp.alias("started_at"),
        stamp.alias("finished_at"),
        (F.col("value") * 10).alias("duration_ms"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed, "Timeout").alias("error_type"),
        attempts.alias("attempts"),
        F.when(~failed, k % 4 != 0).alias("auto_pass"),
        F.when(~failed, sha(odd + 1)).alias("answer_sha256"),
    )
    review = F.struct(
        F.concat(F.lit("rev"), (k % 5).cast("string")).alias("reviewer_id"),
        F.when(k % 3 == 0, "scripted_fixture").otherwise("human").alias("review_method"),
        F.when(k % 11 != 0, k % 2 == 0).alias("task_pass"),
        (k % 5 != 0).alias("citations_correct"),
        (k % 6 == 0).alias("major_rework"),
        (k / 100.0).alias("edit_distance_ratio"),
        F.lit("checked").alias("reason_code"),
        (2 - odd).alias("request_revision"),
        sha(2 - odd).alias("answer_sha256"),
    )
    beat = F.struct(F.when(k >= 90, "failed").otherwise("ok").alias("status"))
    options = {"ignoreNullFields": "false"}
    payload = (
        F.when(kind == "view", F.to_json(beat, options))
        .when(kind == "signup", F.to_json(review, options))
        .otherwise(F.to_json(request, options))
    )
    heartbeat = kind == "view"
    request_id = _uuid(F.col("__request"))
    head = F.struct(
        F.lit(1).alias("schema_version"),
        _uuid(F.col("__event")).alias("event_id"),
        F.when(heartbeat, "source.heartbeat")
        .when(kind == "signup", "review.recorded")
        .otherwise("request.completed")
        .alias("event_type"),
        F.concat(F.lit("src"), (F.col("__source") % 3).cast("string")).alias("source_id"),
        F.lit("simulated").alias("data_origin"),
        F.lit("pilot").alias("run_kind"),
        F.when(~heartbeat, request_id).alias("request_id"),
        F.substring("__trace", 1, 32).alias("trace_id"),
        (odd + 1).alias("revision"),
        stamp.alias("occurred_at"),
    )
    # the brace that closes the envelope makes room for the payload
    line = F.concat(F.rtrim(F.to_json(head, options), F.lit("}")), F.lit(',"payload":'), payload, F.lit("}"))
    return events.select(line.alias("value"))


def parsed(spark: SparkSession, d: str, source: Column | None = None) -> DataFrame:
    """Events as lines, parsed. Rows go to the tasks of their requests while they are small."""
    events = b.table(spark, d, "events").repartition(F.floor(F.col("event_id") / 2))
    return parse_events(event_lines(events, source))


def valid(spark: SparkSession, d: str) -> DataFrame:
    checked = validate_events(parsed(spark, d)).where(F.size("violations") == 0)
    return cut_lineage(checked.drop("violations", "event_json", "payload_hash", "schema_version"))


BASE_SQL = """WITH base AS (
  SELECT event_id AS eid, event_id // 2 AS num, CAST(event_id % 2 AS INT) AS odd, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k,
    event_type AS kind, ts AS tm, user_id, value FROM events),
ids AS (SELECT *, sha256(concat('e', eid)) AS eh, sha256(concat('r', num)) AS rh,
  concat('src', num % 3) AS source_id, odd + 1 AS revision,
  CASE kind WHEN 'view' THEN 'source.heartbeat' WHEN 'signup' THEN 'review.recorded' ELSE 'request.completed' END AS event_type FROM base),
ev AS (SELECT *, concat_ws('-', substr(eh, 1, 8), substr(eh, 9, 4), substr(eh, 13, 4), substr(eh, 17, 4), substr(eh, 21, 12)) AS event_id,
  CASE WHEN kind <> 'view' THEN concat_ws('-', substr(rh, 1, 8), substr(rh, 9, 4), substr(rh, 13, 4), substr(rh, 17, 4), substr(rh, 21, 12)) END AS request_id,
  kind NOT IN ('view', 'signup') AND k >= 98 AND NOT (k % 10 = 0 AND k % 3 = 0) AS bad_usage FROM ids)
"""


@query(
    BASE_SQL
    + """SELECT event_type, CASE WHEN bad_usage THEN 'attempt_usage' ELSE 'valid' END AS rule, count(*) AS events
FROM ev GROUP BY 1, 2"""
)
def event_validation(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and broken rule; a few lines report impossible token counts."""
    checked = validate_events(parsed(spark, d))
    rule = F.explode(
        F.when(F.size("violations") == 0, F.array(F.lit("valid"))).otherwise(F.col("violations"))
    )
    return (
        checked.select("event_type", rule.alias("rule"))
        .groupBy("event_type", "rule")
        .agg(F.count(F.lit(1)).alias("events"))
    )


REQUESTS_SQL = (
    BASE_SQL.rstrip()
    + """, req AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY num ORDER BY revision DESC) AS rn
  FROM ev WHERE event_type = 'request.completed' AND NOT bad_usage) WHERE rn = 1),
att AS (SELECT num, i, n, last, known, CASE WHEN known THEN 100 + k + i * 10 END AS inp, CASE WHEN known THEN 20 + i END AS outp,
    CASE WHEN known THEN k % 7 * 10 END AS cch,
    CASE WHEN known THEN CAST(((100 + k + i * 10) * 2 + (20 + i) * 5) AS DECIMAL(24,12)) * CAST('0.001' AS DECIMAL(4,3)) END AS cost,
    CASE WHEN known THEN CASE WHEN k = 50 THEN 'USD' ELSE 'AUD' END END AS cur, value * 10 + i AS dur, kind
  FROM (SELECT *, i = n AS last, NOT (i = n AND k % 10 = 0) AS known FROM (
    SELECT *, k % 3 + 1 AS n, unnest(range(1, k % 3 + 2)) AS i FROM req))),
roll AS (SELECT num, count(*) AS attempt_count, count(*) FILTER (WHERE inp IS NULL OR outp IS NULL) AS unknown_usage_attempts,
    CASE WHEN count(inp) = count(*) THEN CAST(sum(inp) AS BIGINT) END AS input_tokens,
    CASE WHEN count(outp) = count(*) THEN CAST(sum(outp) AS BIGINT) END AS output_tokens,
    CASE WHEN count(cch) = count(*) THEN CAST(sum(cch) AS BIGINT) END AS cached_input_tokens,
    CASE WHEN count(cost) = count(*) AND count(DISTINCT cur) = 1 THEN sum(cost) END AS estimated_cost,
    CASE WHEN count(DISTINCT cur) <= 1 THEN sum(cost) END AS known_estimated_cost,
    CASE WHEN count(DISTINCT cur) = 1 THEN max(cur) END AS currency, count(cost) AS cost_known_attempts FROM att GROUP BY 1),
rev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY num ORDER BY revision DESC) AS rn
  FROM ev WHERE event_type = 'review.recorded') WHERE rn = 1),
latest AS (SELECT r.num, r.request_id, r.event_id, r.revision, r.source_id, r.tm, r.k, substr(sha256(concat('t', r.num)), 1, 32) AS trace_id,
    CASE WHEN r.kind = 'error' THEN 'Timeout' END AS error_type, CASE WHEN r.kind <> 'error' THEN sha256(concat(r.num, '/', r.odd + 1)) END AS answer_sha256,
    concat('rev', v.k % 5) AS reviewer, v.tm AS reviewed_at, concat('exp', r.num % 2) AS experiment_id,
    concat('case', r.num // 4 % 25) AS case_id, concat('cfg', r.num // 2 % 2) AS config_id, r.value * 10 AS duration_ms,
    CASE WHEN r.kind = 'error' THEN 'failed' ELSE 'success' END AS status, CASE WHEN r.kind <> 'error' THEN r.k % 4 <> 0 END AS auto_pass,
    roll.*, CASE WHEN v.num IS NOT NULL THEN CASE WHEN v.k % 3 = 0 THEN 'scripted_fixture' ELSE 'human' END END AS review_method,
    v.revision AS review_revision, CASE WHEN v.k % 11 <> 0 THEN v.k % 2 = 0 END AS human_task_pass,
    v.k % 5 <> 0 AS citations_correct, v.k % 6 = 0 AS major_rework, v.k / 100.0 AS edit_distance_ratio
  FROM req r JOIN roll USING (num) LEFT JOIN rev v ON v.num = r.num AND 2 - v.odd = r.revision AND r.kind <> 'error')
"""
)


@query(
    REQUESTS_SQL
    + """SELECT request_id, event_id, revision, source_id, strftime(tm, '%Y-%m-%d %H:%M:%S.%f') AS occurred_at, experiment_id, case_id, config_id,
  round(duration_ms, 6) AS duration_ms, status, auto_pass, attempt_count, review_method, review_revision, human_task_pass,
  citations_correct, major_rework, round(CAST(edit_distance_ratio AS DOUBLE), 6) AS edit_distance_ratio, trace_id, error_type, answer_sha256,
  'simulated' AS data_origin, 'pilot' AS run_kind, 'v1' AS case_version, 'self_authored_synthetic' AS case_origin, 'p1' AS prompt_version,
  'r1' AS run_config_version, 'replay' AS provider, 'm1' AS requested_model, 'm1' AS response_model,
  strftime(tm, '%Y-%m-%d %H:%M:%S.%f') AS started_at, strftime(tm, '%Y-%m-%d %H:%M:%S.%f') AS finished_at,
  CASE WHEN review_method IS NOT NULL THEN reviewer END AS reviewer_id, strftime(reviewed_at, '%Y-%m-%d %H:%M:%S.%f') AS reviewed_at,
  CASE WHEN review_method IS NOT NULL THEN 'checked' END AS review_reason_code FROM latest"""
)
def latest_requests(spark: SparkSession, d: str) -> DataFrame:
    df = requests.latest_requests(valid(spark, d))
    rolled = [c for c in requests.attempt_rollup_columns(F.array()) if c != "attempt_count"]
    out = df.drop("attempts", *rolled).withColumn("attempt_count", F.col("attempt_count").cast("long"))
    for name in ("occurred_at", "started_at", "finished_at", "reviewed_at"):
        out = out.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return rounded(out, "duration_ms", "edit_distance_ratio")


@query(
    REQUESTS_SQL
    + """SELECT request_id, attempt_count, attempt_count - 1 AS retry_count, unknown_usage_attempts, input_tokens, output_tokens,
  cached_input_tokens, round(CAST(estimated_cost AS DOUBLE), 6) AS estimated_cost,
  round(CAST(known_estimated_cost AS DOUBLE), 6) AS known_estimated_cost, currency, cost_known_attempts FROM latest"""
)
def attempt_rollup(spark: SparkSession, d: str) -> DataFrame:
    df = requests.latest_requests(valid(spark, d)).select(
        "request_id",
        *[
            F.col(c).cast("long").alias(c)
            for c in (
                "attempt_count",
                "retry_count",
                "unknown_usage_attempts",
                "input_tokens",
                "output_tokens",
                "cached_input_tokens",
                "cost_known_attempts",
            )
        ],
        "estimated_cost",
        "known_estimated_cost",
        "currency",
    )
    return rounded(df, "estimated_cost", "known_estimated_cost")


@query(
    REQUESTS_SQL
    + """SELECT request_id, CAST(i AS INT) AS attempt_number, round(dur, 6) AS duration_ms,
  CASE WHEN a.kind = 'error' OR NOT last THEN 'failed' ELSE 'success' END AS status, CAST(inp AS INT) AS input_tokens, cur AS currency
FROM att a JOIN latest USING (num)"""
)
def attempts(spark: SparkSession, d: str) -> DataFrame:
    df = requests.attempts(requests.latest_requests(valid(spark, d)))
    return rounded(
        df.select("request_id", "attempt_number", "duration_ms", "status", "input_tokens", "currency"),
        "duration_ms",
    )


COMPARISON_SQL = """count(*) AS request_count, count(DISTINCT case_id) AS case_count,
  count(*) FILTER (WHERE status = 'success') AS successful_requests, count(*) FILTER (WHERE status = 'failed') AS failed_requests,
  round(count(*) FILTER (WHERE status = 'failed') / count(*), 6) AS failure_rate, CAST(sum(attempt_count) AS BIGINT) AS attempt_count,
  CAST(sum(attempt_count - 1) AS BIGINT) AS retry_count,
  CAST(sum(attempt_count) - count(*) FILTER (WHERE status = 'success') AS BIGINT) AS failed_attempts,
  CAST(sum(unknown_usage_attempts) AS BIGINT) AS unknown_usage_attempts, round(avg(duration_ms), 6) AS mean_request_ms,
  count(*) FILTER (WHERE auto_pass) AS auto_passed, round(count(*) FILTER (WHERE auto_pass) / count(*), 6) AS auto_pass_rate,
  count(*) FILTER (WHERE review_method = 'human' AND human_task_pass IS NOT NULL) AS human_reviewed,
  count(*) FILTER (WHERE review_method = 'human' AND human_task_pass) AS human_passed,
  round(avg(CAST(human_task_pass AS INT)) FILTER (WHERE review_method = 'human'), 6) AS human_pass_rate,
  round(count(*) FILTER (WHERE review_method = 'human' AND human_task_pass IS NOT NULL)
    / nullif(count(*) FILTER (WHERE status = 'success'), 0), 6) AS human_review_coverage,
  round(avg(CAST(citations_correct AS INT)) FILTER (WHERE review_method = 'human'), 6) AS citation_accuracy,
  round(avg(CAST(major_rework AS INT)) FILTER (WHERE review_method = 'human'), 6) AS major_rework_rate,
  round(avg(CAST(edit_distance_ratio AS DOUBLE)) FILTER (WHERE review_method = 'human'), 6) AS mean_edit_distance_ratio,
  count(estimated_cost) AS cost_known_requests, round(count(estimated_cost) / count(*), 6) AS cost_coverage,
  CASE WHEN count(DISTINCT currency) = 1 THEN max(currency) END AS currency,
  CASE WHEN count(DISTINCT currency) <= 1 THEN round(CAST(sum(known_estimated_cost) AS DOUBLE), 6) END AS known_estimated_cost,
  CASE WHEN count(estimated_cost) = count(*) AND count(DISTINCT currency) = 1 THEN round(CAST(sum(estimated_cost) AS DOUBLE), 6) END AS estimated_cost,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95_request_ms,
  CASE WHEN count(estimated_cost) = count(*) AND count(DISTINCT currency) = 1
    THEN round(CAST(sum(estimated_cost) AS DOUBLE) / nullif(count(*) FILTER (WHERE auto_pass), 0), 6) END AS cost_per_auto_pass,
  CASE WHEN count(estimated_cost) = count(*) AND count(DISTINCT currency) = 1
    AND count(*) FILTER (WHERE status = 'success' AND review_method = 'human' AND human_task_pass IS NOT NULL) = count(*) FILTER (WHERE status = 'success')
    THEN round(CAST(sum(estimated_cost) AS DOUBLE) / nullif(count(*) FILTER (WHERE review_method = 'human' AND human_task_pass), 0), 6) END
    AS cost_per_human_pass"""


def _comparison(df: DataFrame) -> DataFrame:
    out = rounded(
        df,
        "failure_rate",
        "auto_pass_rate",
        "human_pass_rate",
        "human_review_coverage",
        "citation_accuracy",
        "major_rework_rate",
        "mean_edit_distance_ratio",
        "cost_coverage",
        "known_estimated_cost",
        "estimated_cost",
        "p95_request_ms",
        "cost_per_auto_pass",
        "cost_per_human_pass",
    )
    return rounded(out, "mean_request_ms")


@query(
    REQUESTS_SQL
    + f"""SELECT source_id, 'simulated' AS data_origin, 'pilot' AS run_kind, experiment_id, 'v1' AS case_version, config_id,
  'p1' AS prompt_version, 'r1' AS run_config_version, 'replay' AS provider, 'm1' AS requested_model, {COMPARISON_SQL}
FROM latest GROUP BY source_id, experiment_id, config_id"""
)
def config_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(
        requests.config_comparison(cut_lineage(requests.latest_requests(valid(spark, d))))
    )


# Requests with a price in one currency, successes reviewed by a person.
PRICED = "estimated_cost IS NOT NULL AND currency = 'AUD' AND (status = 'failed' OR (review_method = 'human' AND human_task_pass IS NOT NULL))"


@query(
    REQUESTS_SQL
    + f"SELECT experiment_id, config_id, {COMPARISON_SQL} FROM latest WHERE {PRICED} GROUP BY experiment_id, config_id"
)
def priced_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The comparison where every cost is known: cost per automatic and per human pass."""
    known = cut_lineage(requests.latest_requests(valid(spark, d)).where(PRICED))
    return _comparison(requests.request_metrics(known, ["experiment_id", "config_id"]))


@query(REQUESTS_SQL + f"SELECT case_id, {COMPARISON_SQL} FROM latest GROUP BY case_id")
def request_kpis_by_case(spark: SparkSession, d: str) -> DataFrame:
    latest = cut_lineage(requests.latest_requests(valid(spark, d)))
    return _comparison(requests.request_metrics(latest, ["case_id"]))


@query(
    REQUESTS_SQL.rstrip()
    + """, cc AS (SELECT source_id, experiment_id, case_id, count(*) FILTER (WHERE config_id = 'cfg0') AS a,
  count(*) FILTER (WHERE config_id = 'cfg1') AS b FROM latest GROUP BY 1, 2, 3),
g AS (SELECT source_id, experiment_id, count(DISTINCT config_id) AS configs FROM latest GROUP BY 1, 2)
SELECT source_id, 'simulated' AS data_origin, 'pilot' AS run_kind, experiment_id, 'v1' AS case_version, 'replay' AS provider,
  'm1' AS requested_model, 'r1' AS run_config_version, any_value(configs) AS configs, 1 AS resolved_models, count(*) AS cases,
  count(*) FILTER (WHERE CASE WHEN configs = 2 THEN a <> b ELSE a + b <> 0 END) AS unbalanced_cases,
  any_value(configs) = 2 AND count(*) FILTER (WHERE a <> b) = 0 AS matched_case_repetitions, true AS stable_prompt_versions,
  any_value(configs) = 2 AND count(*) FILTER (WHERE a <> b) = 0 AS comparison_ready, false AS is_live
FROM cc JOIN g USING (source_id, experiment_id) GROUP BY source_id, experiment_id"""
)
def comparison_readiness(spark: SparkSession, d: str) -> DataFrame:
    return requests.comparison_readiness(cut_lineage(requests.latest_requests(valid(spark, d))))


# --- ingestion ---------------------------------------------------------------


@query(
    BASE_SQL
    + """SELECT 'event_id' AS kind, event_id AS key, 2 AS versions FROM ev WHERE k >= 90"""
)
def ingest_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The log sent a second time, with some lines changed on the way."""
    first = parsed(spark, d)
    events = b.table(spark, d, "events")
    k = b.props_k()
    changed = events.withColumn(
        "ts", F.when(k >= 90, F.col("ts") + F.expr("interval 1 second")).otherwise(F.col("ts"))
    )
    again = parse_events(event_lines(changed))
    # each line is parsed once, into the few columns that both checks read
    first, again = (
        cut_lineage(x.select("event_id", "payload_hash", "request_id", "event_type", "revision")) for x in (first, again)
    )
    return ingestion.ingest_conflicts(again, first)


@query(
    BASE_SQL
    + """SELECT request_id, count(DISTINCT user_id % 3) AS identities FROM ev WHERE request_id IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT user_id % 3) > 1"""
)
def provenance_violations(spark: SparkSession, d: str) -> DataFrame:
    """Sources taken from the user: two events of one request may then disagree."""
    return ingestion.provenance_violations(parsed(spark, d, F.col("user_id")))


@query(
    BASE_SQL + "SELECT event_id, event_type, CAST(revision AS INT) AS revision FROM ev WHERE kind IN ('error', 'view')"
)
def new_events(spark: SparkSession, d: str) -> DataFrame:
    """A replayed batch against a store that already holds everything but errors and views."""
    events = b.table(spark, d, "events")
    batch = parse_events(event_lines(events.unionByName(events)))
    stored = parse_events(event_lines(events.where(~F.col("event_type").isin("error", "view"))))
    return ingestion.dedupe_events(batch, stored).select("event_id", "event_type", "revision")


@query(
    """WITH t AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1),
l AS (SELECT date_diff('day', DATE '2024-01-01', day) AS sequence, day AS finished_at, n,
  CASE WHEN bad / n > 0.22 THEN 'failed' ELSE 'success' END AS status FROM t),
f AS (SELECT max(sequence) FILTER (WHERE status = 'failed') AS s FROM l)
SELECT max(sequence) AS sequence, arg_max(status, sequence) AS status, max(finished_at) AS finished_at, arg_max(n, sequence) AS event_count, arg_max(n, sequence) AS inserted_count,
  arg_max(status, sequence) = 'failed' AS is_open, max(finished_at) FILTER (WHERE status = 'failed') AS last_failure_at,
  CASE WHEN arg_max(status, sequence) = 'success' THEN min(finished_at) FILTER (WHERE status = 'success' AND sequence > f.s) END AS recovered_at
FROM l, f"""
)
def ingestion_health(spark: SparkSession, d: str) -> DataFrame:
    """A ledger with one batch per day; a day with many errors counts as failed."""
    day = F.col("ts").cast("date")
    bad = F.count(F.when(F.col("event_type") == "error", 1))
    daily = (
        b.table(spark, d, "events")
        .groupBy(day.alias("finished_at"))
        .agg(F.count(F.lit(1)).alias("event_count"), bad.alias("bad"))
    )
    ledger = daily.select(
        F.datediff("finished_at", F.lit("2024-01-01").cast("date")).cast("long").alias("sequence"),
        F.when(F.col("bad") / F.col("event_count") > 0.22, "failed").otherwise("success").alias("status"),
        "finished_at",
        "event_count",
        F.col("event_count").alias("inserted_count"),
    )
    return ingestion.ingestion_health(ledger)


@query(
    BASE_SQL
    + """, r AS (SELECT num, arg_max(kind, revision) AS kind, max(revision) AS revision FROM ev WHERE event_type = 'request.completed' GROUP BY 1),
s AS (SELECT num, max(revision) AS last FROM ev WHERE event_type = 'review.recorded' GROUP BY 1),
n AS (SELECT e.request_id, e.num, e.k, e.eid, r.kind AS rk, r.revision AS rr, s.last, e.odd,
  CASE WHEN r.num IS NULL THEN 'unknown_request' WHEN r.kind = 'error' THEN 'request_not_successful'
    WHEN 2 - e.odd <> r.revision THEN 'answer_changed' END AS problem
  FROM ev e LEFT JOIN r USING (num) LEFT JOIN s USING (num) WHERE e.event_type = 'review.recorded')
SELECT request_id, concat('rev', k % 5) AS reviewer_id, problem, CAST(CASE WHEN problem IS NULL THEN last + 1 END AS BIGINT) AS revision FROM n"""
)
def review_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Every stored review decided once more, as the next revision of its request."""
    # each line is parsed once, into the columns that the four readers below need
    p = F.col("payload")
    slim = F.struct(*[p[f].alias(f) for f in ("status", "answer_sha256", "reviewer_id")]).alias("payload")
    events = parsed(spark, d).select(
        "event_type", "event_id", "request_id", "revision", *monitor.SCOPE, "trace_id", "occurred_at", slim
    )
    events = cut_lineage(events)
    again = events.where(F.col("event_type") == "review.recorded").select(
        "request_id",
        F.col("payload.answer_sha256").alias("answer_sha256"),
        F.col("payload.reviewer_id").alias("reviewer_id"),
        F.col("occurred_at").alias("decided_at"),
    )
    # two reviews of one request share its number; the first keeps the next revision
    return requests.review_revisions(again, events).select(
        "request_id", "reviewer_id", "problem", "revision"
    )


# --- monitoring --------------------------------------------------------------


MONITOR_SQL = (
    BASE_SQL.rstrip()
    + f""", hb AS (SELECT source_id, tm, k >= 90 AS failed FROM ev WHERE kind = 'view'),
rq AS (SELECT source_id, tm, kind = 'error' AS failed, request_id FROM (
  SELECT *, row_number() OVER (PARTITION BY num ORDER BY revision DESC) AS rn FROM ev
  WHERE event_type = 'request.completed' AND NOT bad_usage) WHERE rn = 1),
ok AS (SELECT source_id, tm FROM ev WHERE NOT bad_usage),
pts AS (SELECT source_id, unnest(range(CAST(ceil(epoch(min(tm)) / {CHECK_MINUTES * 60}) AS BIGINT),
    CAST(ceil(epoch(max(tm)) / {CHECK_MINUTES * 60}) AS BIGINT) + 2)) * {CHECK_MINUTES * 60} AS t FROM ok GROUP BY 1),
chk AS (SELECT source_id, make_timestamp(CAST(t AS BIGINT) * 1000000) AS as_at FROM pts),
st AS (SELECT c.source_id, c.as_at, h.tm AS hat, coalesce(h.failed, false) AS hf, coalesce(r.failed, false) AS rf FROM chk c
  ASOF LEFT JOIN hb h ON h.source_id = c.source_id AND h.tm <= c.as_at
  ASOF LEFT JOIN rq r ON r.source_id = c.source_id AND r.tm <= c.as_at),
states AS (SELECT source_id, as_at, 'heartbeat_stale' AS rule_key,
    hat IS NULL OR hat < as_at - INTERVAL {STALE_MINUTES} MINUTE OR hf AS is_open FROM st
  UNION ALL SELECT source_id, as_at, 'latest_request_failed', rf FROM st),
chg AS (SELECT *, lag(is_open) OVER (PARTITION BY source_id, rule_key ORDER BY as_at) AS was FROM states)
"""
)


@query(
    MONITOR_SQL
    + """SELECT source_id, 'simulated' AS data_origin, 'pilot' AS run_kind, rule_key, CASE WHEN is_open THEN 'open' ELSE 'resolved' END AS state,
  strftime(as_at, '%Y-%m-%d %H:%M:%S') AS changed_at FROM chg WHERE CASE WHEN was IS NULL THEN is_open ELSE is_open <> was END"""
)
def source_monitor(spark: SparkSession, d: str) -> DataFrame:
    states = _states(spark, d)
    return monitor.transitions(states).withColumn(
        "changed_at", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss")
    )


@query(
    MONITOR_SQL
    + """SELECT source_id, 'simulated' AS data_origin, 'pilot' AS run_kind, rule_key, arg_max(is_open, as_at) AS is_open,
  strftime(max(as_at), '%Y-%m-%d %H:%M:%S') AS last_checked_at FROM states GROUP BY source_id, rule_key"""
)
def source_state(spark: SparkSession, d: str) -> DataFrame:
    return monitor.current_state(_states(spark, d)).withColumn(
        "last_checked_at", F.date_format("last_checked_at", "yyyy-MM-dd HH:mm:ss")
    )


def _states(spark: SparkSession, d: str) -> DataFrame:
    events = valid(spark, d)
    slim = events.select(*monitor.SCOPE, "event_type", "event_id", "occurred_at", "payload")
    return monitor.monitor_states(
        slim, requests.latest_requests(events), CHECK_MINUTES, STALE_MINUTES
    )


@query(
    """WITH p(model, price_from, price_to, pin, pca, pout) AS (VALUES
  ('AUTOMOBILE', TIMESTAMP '1995-01-01', TIMESTAMP '1998-01-01', 2.5, 1.25, 10.0), ('AUTOMOBILE', TIMESTAMP '1998-01-01', NULL, 2.0, 1.0, 8.0),
  ('BUILDING', TIMESTAMP '1996-01-01', NULL, 0.15, 0.075, 0.6))
SELECT c_mktsegment AS model, CAST(year(o_orderdate) AS INT) AS year, count(*) AS attempts, count(pin) AS priced,
  round(CAST(sum(CAST(((o_orderkey % 900 + 100) - o_orderkey % 100) * pin + (o_orderkey % 100) * pca + (o_custkey % 500) * pout AS DECIMAL(24,6))) AS DOUBLE) / 1000000, 6) AS cost
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN p ON p.model = c_mktsegment AND o_orderdate >= price_from
  AND (price_to IS NULL OR o_orderdate < price_to) GROUP BY 1, 2"""
)
def rate_card_cost(spark: SparkSession, d: str) -> DataFrame:
    """Orders as priced calls: a card per segment and period."""
    calls = (
        b.table(spark, d, "orders")
        .join(b.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_mktsegment").alias("response_model"),
            F.col("o_orderdate").cast("timestamp").alias("started_at"),
            (F.col("o_orderkey") % 900 + 100).alias("input_tokens"),
            (F.col("o_orderkey") % 100).alias("cached_input_tokens"),
            (F.col("o_custkey") % 500).alias("output_tokens"),
        )
    )
    cards = spark.createDataFrame(
        [
            ("AUTOMOBILE", "1995-01-01", "1998-01-01", 2.5, 1.25, 10.0, "AUD", "a1"),
            ("AUTOMOBILE", "1998-01-01", None, 2.0, 1.0, 8.0, "AUD", "a2"),
            ("BUILDING", "1996-01-01", None, 0.15, 0.075, 0.6, "AUD", "b1"),
        ],
        "model string, f string, t string, input_per_million double, cached_input_per_million double, "
        "output_per_million double, currency string, rate_version string",
    )
    cards = cards.withColumn("effective_from", F.col("f").cast("timestamp")).withColumn(
        "effective_to", F.col("t").cast("timestamp")
    )
    priced = cost.apply_rate_card(calls, cards)
    out = priced.groupBy(
        F.col("response_model").alias("model"), F.year("started_at").alias("year")
    ).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count("estimated_cost").alias("priced"),
        F.sum("estimated_cost").alias("cost"),
    )
    return rounded(out, "cost")


# --- streams -----------------------------------------------------------------


def session_stream(spark: SparkSession, d: str) -> DataFrame:
    events = b.table(spark, d, "events")
    n_matters = F.lit(1)
    # the last letter is a pattern, so that a file and a folder of files both match
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")
    return b.session_columns(stream, n_matters, b.props_k())


WINDOW_SQL = """WITH s AS (SELECT *, {extra} FROM events), w AS (
  SELECT unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS window_start, * FROM s),
g AS (SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, {columns} FROM w GROUP BY 1, 2)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, {out}
FROM g WHERE window_end <= (SELECT date_trunc('millisecond', max(ts)) FROM events{where}) - INTERVAL 1 HOUR"""


@query(
    WINDOW_SQL.format(
        extra="event_type = 'error' AS failed",
        columns="count(*) AS sessions, count(*) FILTER (WHERE failed) AS failed",
        out="sessions, failed, round(failed / sessions, 6) AS error_rate",
        where="",
    )
)
def stream_windowed_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Windows the watermark has closed, from a stream over the events."""
    stream = windows.windowed_error_rate(session_stream(spark, d))
    return _clock(rounded(windows.run_available(stream, "error-rate"), "error_rate"))


@query(
    WINDOW_SQL.format(
        extra="CAST(event_id % 5 AS INT) AS tool_id, CAST(round(value * 100) AS BIGINT) AS latency",
        columns="tool_id, count(*) AS sessions, quantile_disc(latency, 0.95) AS p95_latency_ms",
        out="tool_id, sessions, p95_latency_ms",
        where=" WHERE event_type <> 'error'",
    ).replace("FROM events), w AS", "FROM events WHERE event_type <> 'error'), w AS").replace("GROUP BY 1, 2)", "GROUP BY 1, 2, tool_id)")
)
def stream_windowed_p95(spark: SparkSession, d: str) -> DataFrame:
    stream = windows.windowed_percentile(session_stream(spark, d), by=["tool_id"])
    return _clock(windows.run_available(stream, "p95"))


def _clock(df: DataFrame) -> DataFrame:
    for name in ("window_start", "window_end"):
        df = df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))
    return df


def line_stream(spark: SparkSession, d: str, faults: bool = True) -> DataFrame:
    schema = b.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    return event_lines(events, faults=faults)


# The state of a source as checks at full hours: the last value by event time is carried from
# check to check, and only changes count. The watermark, an hour behind, closes the last check.
STREAM_MONITOR_SQL = (
    BASE_SQL.rstrip()
    + f""", ok AS (SELECT * FROM ev WHERE NOT bad_usage),
hb AS (SELECT source_id, tm, arg_max(k >= 90, event_id) AS failed FROM ok WHERE kind = 'view' GROUP BY 1, 2),
rq AS (SELECT source_id, tm, arg_max(kind = 'error', event_id) AS failed FROM ok WHERE event_type = 'request.completed' GROUP BY 1, 2),
lim AS (SELECT CAST(floor((epoch(date_trunc('millisecond', max(tm) - INTERVAL 1 MICROSECOND)) - 3600) / {CHECK_MINUTES * 60}) AS BIGINT) AS last FROM ok),
pts AS (SELECT source_id, unnest(range(CAST(ceil(epoch(min(tm)) / {CHECK_MINUTES * 60}) AS BIGINT), (SELECT last FROM lim) + 1)) * {CHECK_MINUTES * 60} AS t
  FROM ok GROUP BY 1),
chk AS (SELECT source_id, make_timestamp(CAST(t AS BIGINT) * 1000000) AS as_at FROM pts),
st AS (SELECT c.source_id, c.as_at, h.tm AS hat, coalesce(h.failed, false) AS hf, coalesce(r.failed, false) AS rf FROM chk c
  ASOF LEFT JOIN hb h ON h.source_id = c.source_id AND h.tm <= c.as_at
  ASOF LEFT JOIN rq r ON r.source_id = c.source_id AND r.tm <= c.as_at),
states AS (SELECT source_id, as_at, 'heartbeat_stale' AS rule_key,
    hat IS NULL OR hat < as_at - INTERVAL {STALE_MINUTES} MINUTE OR hf AS is_open FROM st
  UNION ALL SELECT source_id, as_at, 'latest_request_failed', rf FROM st),
chg AS (SELECT *, lag(is_open) OVER (PARTITION BY source_id, rule_key ORDER BY as_at) AS was FROM states)
SELECT source_id, 'simulated' AS data_origin, 'pilot' AS run_kind, rule_key, CASE WHEN is_open THEN 'open' ELSE 'resolved' END AS state,
  strftime(as_at, '%Y-%m-%d %H:%M:%S') AS changed_at FROM chg WHERE CASE WHEN was IS NULL THEN is_open ELSE is_open <> was END"""
)


@query(STREAM_MONITOR_SQL)
def stream_monitor_transitions(spark: SparkSession, d: str) -> DataFrame:
    stream_monitor.use_rocksdb(spark)
    checked = validate_events(parse_events(line_stream(spark, d)))
    good = checked.where(F.size("violations") == 0)
    stream = stream_monitor.monitor_stream(good, CHECK_MINUTES, STALE_MINUTES)
    out = windows.run_available(stream, "monitor")
    return out.withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    BASE_SQL + "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS ids FROM ev GROUP BY 1"
)
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    stream_monitor.use_rocksdb(spark)
    events = parse_events(line_stream(spark, d)).select("event_id", "event_type", "occurred_at")
    out = windows.run_available(ingest.dedupe_stream(events), "dedupe")
    return out.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids")
    )


def _ingested(spark: SparkSession, d: str, faults: bool) -> ingest.EventStore:
    root = shared_dir(spark, "store")
    store = ingest.EventStore(f"{root}/store")
    lines = line_stream(spark, d, faults)
    ingest.ingest_stream(lines, store, f"{root}/checkpoint").awaitTermination()
    return store


@query(
    BASE_SQL
    + """SELECT 'failed' AS status, 'invalid_event' AS error_code, count(*) AS event_count, 0 AS inserted_count FROM ev"""
)
def stream_ingest_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The whole log as one batch into a new store: invalid lines refuse the batch."""
    store = _ingested(spark, d, True)
    return store.ledger(spark).select("status", "error_code", "event_count", "inserted_count")


@query(
    BASE_SQL + "SELECT event_type, source_id, count(*) AS events, count(DISTINCT request_id) AS requests FROM ev GROUP BY 1, 2"
)
def stream_event_log(spark: SparkSession, d: str) -> DataFrame:
    """The same log without the invalid lines, as it is stored."""
    log = _ingested(spark, d, False).log(spark)
    return log.groupBy("event_type", "source_id").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("request_id").alias("requests")
    )
