"""Telemetry event envelope: schema, parsing and validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import once

# The envelope, the three payloads and an attempt.
ENVELOPE_FIELDS = [
    "schema_version",
    "event_id",
    "event_type",
    "source_id",
    "data_origin",
    "run_kind",
    "request_id",
    "trace_id",
    "revision",
    "occurred_at",
    "payload",
]
REQUEST_FIELDS = [
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
    "started_at",
    "finished_at",
    "duration_ms",
    "status",
    "error_type",
    "attempts",
    "auto_pass",
    "answer_sha256",
]
REVIEW_FIELDS = [
    "reviewer_id",
    "review_method",
    "task_pass",
    "citations_correct",
    "major_rework",
    "edit_distance_ratio",
    "reason_code",
    "request_revision",
    "answer_sha256",
]
HEARTBEAT_FIELDS = ["status"]
ATTEMPT_FIELDS = [
    "attempt_number",
    "duration_ms",
    "status",
    "error_type",
    "provider_request_id",
    "input_tokens",
    "output_tokens",
    "cached_input_tokens",
    "estimated_cost",
    "currency",
    "rate_version",
]
EVENT_TYPES = ["request.completed", "review.recorded", "source.heartbeat"]
ORIGINS = ["observed", "simulated"]
KINDS = ["benchmark", "pilot", "fault_drill"]
MAX_ATTEMPTS = 5
MAX_BYTES = 32000
MAX_NUMBER = 2_000_000_000
ID_PATTERN = r"[A-Za-z0-9_.:/-]"
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

REQUEST, REVIEW, HEARTBEAT = EVENT_TYPES

ATTEMPT_TYPE = (
    "struct<attempt_number:int,duration_ms:double,status:string,error_type:string,"
    "provider_request_id:string,input_tokens:int,output_tokens:int,cached_input_tokens:int,"
    "estimated_cost:decimal(24,12),currency:string,rate_version:string>"
)
PAYLOAD_TYPE = (
    "struct<experiment_id:string,case_id:string,case_version:string,case_origin:string,"
    "config_id:string,prompt_version:string,run_config_version:string,provider:string,"
    "requested_model:string,response_model:string,started_at:string,finished_at:string,"
    f"duration_ms:double,status:string,error_type:string,attempts:array<{ATTEMPT_TYPE}>,"
    "auto_pass:boolean,answer_sha256:string,reviewer_id:string,review_method:string,"
    "task_pass:boolean,citations_correct:boolean,major_rework:boolean,"
    "edit_distance_ratio:double,reason_code:string,request_revision:int>"
)
EVENT_TYPE = (
    "struct<schema_version:int,event_id:string,event_type:string,source_id:string,"
    "data_origin:string,run_kind:string,request_id:string,trace_id:string,revision:int,"
    f"occurred_at:string,payload:{PAYLOAD_TYPE}>"
)


def instant(value: Column) -> Column:
    """Timestamp of an ISO string that carries an offset; NULL otherwise."""
    return F.when(value.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(value))


def parse_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines -> typed columns, the raw line and its hash. Works on batches and streams.

    Each step is computed once: later filters stay above the parser, where each field
    they mention would otherwise parse the line again.
    """
    parsed = lines.select(F.explode(F.array(F.col(line))).alias("event_json"))
    parsed = once(parsed, "__e", F.from_json("event_json", EVENT_TYPE))
    return parsed.select(
        "event_json",
        F.sha2("event_json", 256).alias("payload_hash"),
        *[F.col(f"__e.{f}").alias(f) for f in ENVELOPE_FIELDS if f not in ("payload", "occurred_at")],
        instant(F.col("__e.occurred_at")).alias("occurred_at"),
        F.col("__e.payload").alias("payload"),
    )


def _has_exactly(keys: Column, fields: list[str]) -> Column:
    # in the usual order nothing is sorted
    usual = keys == F.array(*[F.lit(f) for f in fields])
    return usual | (F.sort_array(keys) == F.array(*[F.lit(f) for f in sorted(fields)]))


def _id(value: Column, limit: int = 100) -> Column:
    return F.coalesce(value.rlike(f"^{ID_PATTERN}{{1,{limit}}}$"), F.lit(False))


def _optional_id(value: Column, limit: int = 100) -> Column:
    return value.isNull() | _id(value, limit)


def _amount(value: Column) -> Column:
    return F.coalesce(value.between(0, MAX_NUMBER), F.lit(False))


def _optional_amount(value: Column) -> Column:
    return value.isNull() | value.between(0, MAX_NUMBER)


def _sha(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def attempt_rules() -> list[tuple[str, Column]]:
    """(name, predicate that must hold) over the attempts of a request."""
    attempts = F.col("payload.attempts")

    def every(check) -> Column:
        return F.coalesce(F.forall(attempts, check), F.lit(False))

    def usage(a: Column) -> Column:
        cached, given = a["cached_input_tokens"], a["input_tokens"]
        fits = cached.isNull() | F.coalesce(cached <= given, F.lit(False))
        return (
            fits
            & _optional_amount(given)
            & _optional_amount(cached)
            & _optional_amount(a["output_tokens"])
        )

    def price(a: Column) -> Column:
        complete = (
            a["input_tokens"].isNotNull()
            & a["output_tokens"].isNotNull()
            & a["cached_input_tokens"].isNotNull()
            & F.coalesce(a["currency"].rlike("^[A-Z]{3}$"), F.lit(False))
            & _id(a["rate_version"])
            & _amount(a["estimated_cost"].cast("double"))
        )
        unknown = a["currency"].isNull() & a["rate_version"].isNull()
        return F.when(a["estimated_cost"].isNotNull(), complete).otherwise(unknown)

    def outcome(a: Column) -> Column:
        known = F.coalesce(a["status"].isin("success", "failed"), F.lit(False))
        matches = (a["status"] == "success") == a["error_type"].isNull()
        return known & matches & _optional_id(a["error_type"], 64)

    numbers = F.transform(attempts, lambda a: a["attempt_number"])
    earlier = F.slice(attempts, 1, F.greatest(F.lit(0), F.size(attempts) - 1))
    final = F.element_at(attempts, -1)
    status = F.col("payload.status")
    quality = F.col("payload.auto_pass"), F.col("payload.answer_sha256")
    return [
        (
            "attempt_count",
            F.coalesce(F.size(attempts).between(1, MAX_ATTEMPTS), F.lit(False)),
        ),
        (
            "attempt_numbers",
            F.coalesce(numbers == F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(attempts))), F.lit(False)),
        ),
        ("attempt_duration", every(lambda a: _amount(a["duration_ms"]))),
        ("attempt_usage", every(usage)),
        ("attempt_price", every(price)),
        ("attempt_outcome", every(outcome)),
        ("attempt_provider_id", every(lambda a: _optional_id(a["provider_request_id"], 200))),
        (
            "retried_success",
            F.coalesce(F.forall(earlier, lambda a: a["status"] == "failed"), F.lit(False)),
        ),
        (
            "request_outcome",
            F.coalesce(
                (status == final["status"])
                & F.col("payload.error_type").eqNullSafe(final["error_type"]),
                F.lit(False),
            ),
        ),
        (
            "answer_grade",
            F.when(status == "failed", quality[0].isNull() & quality[1].isNull())
            .when(status == "success", quality[0].isNotNull() & quality[1].isNotNull())
            .otherwise(F.lit(False)),
        ),
    ]


def request_rules() -> list[tuple[str, Column]]:
    p = F.col("payload")
    ids = F.lit(True)
    for name in (
        "experiment_id",
        "case_id",
        "case_version",
        "config_id",
        "prompt_version",
        "run_config_version",
        "provider",
        "requested_model",
    ):
        ids = ids & _id(p[name])
    start, end = instant(p["started_at"]), instant(p["finished_at"])
    provider = p["provider"]
    origin = F.col("data_origin")
    return [
        ("request_ids", ids & _optional_id(p["response_model"])),
        ("case_origin", F.coalesce(p["case_origin"] == "self_authored_synthetic", F.lit(False))),
        (
            "provider_origin",
            ~F.coalesce(
                ((provider == "replay") & (origin != "simulated"))
                | ((provider == "openai") & (origin != "observed")),
                F.lit(False),
            ),
        ),
        (
            "request_times",
            F.coalesce((start <= end) & (end <= F.col("occurred_at")), F.lit(False)),
        ),
        ("request_duration", _amount(p["duration_ms"])),
        ("answer_hash", p["answer_sha256"].isNull() | _sha(p["answer_sha256"])),
        *attempt_rules(),
    ]


def review_rules() -> list[tuple[str, Column]]:
    p = F.col("payload")
    return [
        ("review_ids", _id(p["reviewer_id"], 64) & _id(p["reason_code"], 64)),
        (
            "review_target",
            F.coalesce(p["request_revision"] >= 1, F.lit(False)) & _sha(p["answer_sha256"]),
        ),
        (
            "review_method",
            F.coalesce(
                (p["review_method"] == "human")
                | ((p["review_method"] == "scripted_fixture") & (F.col("data_origin") == "simulated")),
                F.lit(False),
            ),
        ),
        (
            "edit_ratio",
            p["edit_distance_ratio"].isNull() | p["edit_distance_ratio"].between(0.0, 1.0),
        ),
    ]


def envelope_rules() -> list[tuple[str, Column]]:
    kind = F.col("event_type")
    request_id = F.col("request_id")
    line, payload_keys = F.col("event_json"), F.col("__payload_keys")
    fields = (
        F.when(kind == REQUEST, _has_exactly(payload_keys, REQUEST_FIELDS))
        .when(kind == REVIEW, _has_exactly(payload_keys, REVIEW_FIELDS))
        .when(kind == HEARTBEAT, _has_exactly(payload_keys, HEARTBEAT_FIELDS))
    )
    known = kind.isin(*EVENT_TYPES) & F.col("data_origin").isin(*ORIGINS) & F.col("run_kind").isin(*KINDS)
    return [
        ("fields", F.coalesce(_has_exactly(F.col("__keys"), ENVELOPE_FIELDS), F.lit(False))),
        ("payload_fields", F.coalesce(fields, F.lit(False))),
        (
            "attempt_fields",
            (kind != REQUEST)
            | F.coalesce(
                F.forall("__attempts", lambda m: _has_exactly(F.map_keys(m), ATTEMPT_FIELDS)),
                F.lit(False),
            ),
        ),
        ("schema_version", F.coalesce(F.col("schema_version") == 1, F.lit(False))),
        ("provenance", F.coalesce(known, F.lit(False))),
        ("source_id", _id(F.col("source_id"), 64)),
        ("event_id", F.coalesce(F.col("event_id").rlike(UUID_PATTERN), F.lit(False))),
        (
            "request_id",
            F.when(kind == HEARTBEAT, request_id.isNull()).otherwise(
                F.coalesce(request_id.rlike(UUID_PATTERN), F.lit(False))
            ),
        ),
        ("trace_id", F.coalesce(F.col("trace_id").rlike("^[0-9a-f]{32}$"), F.lit(False))),
        ("revision", F.coalesce(F.col("revision").between(1, MAX_NUMBER), F.lit(False))),
        ("occurred_at", F.col("occurred_at").isNotNull()),
        ("size", F.octet_length(line) <= MAX_BYTES),
    ]


def validate_events(parsed: DataFrame) -> DataFrame:
    """Parsed events with ``violations``: names of the broken rules, empty when valid.

    A line that is no JSON object only reports ``malformed``.
    """
    kind = F.col("event_type")
    checks: list[Column] = []
    for name, rule in envelope_rules():
        checks.append(F.when(~rule, name))
    for name, rule in request_rules():
        checks.append(F.when((kind == REQUEST) & ~rule, name))
    for name, rule in review_rules():
        checks.append(F.when((kind == REVIEW) & ~rule, name))
    checks.append(
        F.when(
            (kind == HEARTBEAT)
            & ~F.coalesce(F.col("payload.status").isin("ok", "failed"), F.lit(False)),
            "heartbeat_status",
        )
    )
    found = F.when(F.col("__keys").isNull(), F.array(F.lit("malformed"))).otherwise(
        F.array_compact("__checks")
    )
    # each step once per line: the keys of the line, and those inside the payload alone
    line, payload = F.col("event_json"), F.col("__payload")
    keyed = once(parsed, "__l", F.struct(F.json_object_keys(line).alias("keys"), F.get_json_object(line, "$.payload").alias("payload")))
    keyed = keyed.select(*parsed.columns, F.col("__l.keys").alias("__keys"), F.col("__l.payload").alias("__payload"))
    maps = F.when(kind == REQUEST, F.from_json(F.get_json_object(payload, "$.attempts"), "array<map<string,string>>"))
    keyed = once(keyed, "__p", F.struct(F.json_object_keys(payload).alias("keys"), maps.alias("attempts")))
    keyed = keyed.select(
        *parsed.columns, "__keys", F.col("__p.keys").alias("__payload_keys"), F.col("__p.attempts").alias("__attempts")
    )
    # a column of their own: below array_compact, Spark would not compile the checks; and a
    # filter on the violations must not repeat them either
    checked = once(keyed, "__checks", F.array(*checks))
    return once(checked, "violations", found).select(*parsed.columns, "violations")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    clean = F.size("violations") == 0
    return validated.where(clean), validated.where(~clean)
