"""Registered queries over evaluation packets, reviews, graded answers, reports and logs."""

from __future__ import annotations

import contextlib
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adoption, alerts, checks, corpus, quality, regression, requests
from ..session import cut_lineage, shared_dir
from ..sources import store, telemetry
from . import bindings as b
from . import evidence, operations
from . import telemetry as events
from .bindings import LAWYERS_SQL, MATTERS_SQL, SESSIONS_SQL, TIME_SQL, rounded, with_sql
from .evidence import BUDGET, FAULTS_SQL, SPACE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return register


# --- evaluation packets ------------------------------------------------------

_STARTED = dt.datetime(2024, 3, 1)


def packet(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run with failures as a packet: run, configurations, case results."""
    scores = cut_lineage(evidence.scored(spark, d, faults=True))
    ok = F.col("response_state") == "ok"
    cases = scores.select(
        F.lit("run-1").alias("run_id"),
        F.lit("development").alias("partition"),
        (~F.col("is_impossible")).alias("is_answerable"),
        F.when(ok, F.col("document_characters") % 97).alias("retrieval_latency_ms"),
        "*",
    ).select(*store.CASE_FIELDS)
    run = cases.groupBy("run_id").agg(F.count(F.lit(1)).alias("expected_rows")).select(
        F.lit("first").alias("run_label"),
        F.lit("development").alias("phase"),
        F.lit("0" * 64).alias("protocol_sha256"),
        F.lit(_STARTED).alias("started_at"),
        F.lit("real").alias("case_origin"),
        F.lit("local").alias("execution_origin"),
        F.lit(BUDGET).alias("character_budget"),
        "expected_rows",
        "run_id",
    )
    roles = [("run-1", "baseline", "baseline"), ("run-1", "candidate", "candidate")]
    return run, spark.createDataFrame(roles, "run_id string, config_id string, config_role string"), cases


@query(
    FAULTS_SQL
    + """SELECT 'stored' AS step, config_id, count(*) AS rows, count(*) FILTER (WHERE state <> 'ok') AS failures, round(avg(recall), 6) AS recall
FROM scores GROUP BY config_id
UNION ALL SELECT 'imported', NULL, count(*), NULL, NULL FROM scores
UNION ALL SELECT * FROM (VALUES ('imported again', NULL, 0, NULL, NULL), ('run identity conflicts with stored content', NULL, NULL, NULL, NULL),
  ('row_count in case None', NULL, NULL, NULL, NULL), ('a packet holds exactly one run', NULL, NULL, NULL, NULL))"""
)
def packet_imports(spark: SparkSession, d: str) -> DataFrame:
    """A packet imported, sent again, sent with other content, and two that can't be."""
    path = shared_dir(spark, "packets")
    run, configs, cases = packet(spark, d)
    other = F.lit("run-2").alias("run_id")

    def renamed(df: DataFrame) -> DataFrame:
        return df.select(other, *[c for c in df.columns if c != "run_id"])

    changed = cases.withColumn("retrieved_characters", F.col("retrieved_characters") + 1)
    fewer = renamed(run).withColumn("expected_rows", F.col("expected_rows") + 1)
    steps = [
        ("imported", (run, configs, cases)),
        ("imported again", (run, configs, cases)),
        ("changed", (run, configs, changed)),
        ("fewer", (fewer, renamed(configs), renamed(cases))),
        ("two runs", (run.unionByName(fewer), configs, cases)),
    ]
    told = []
    for name, parts in steps:
        try:
            told.append((name, store.ingest_packet(*parts, path)))
        except store.PacketRejected as error:
            told.append((str(error), None))
    told = spark.createDataFrame(told, "step string, rows long")
    stored = store.stored_cases(spark, path).groupBy("config_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("response_state") != "ok", 1)).alias("failures"),
        F.avg("gold_character_recall").alias("recall"),
    )
    out = stored.withColumn("step", F.lit("stored")).unionByName(told, allowMissingColumns=True)
    return rounded(out.select("step", "config_id", "rows", "failures", "recall"), "recall")


def _item(case: str = "case_id") -> Column:
    return F.split(case, "-")[0].cast("int")


@query(
    FAULTS_SQL.rstrip()
    + f""", x AS (SELECT *, CAST(split_part(case_id, '-', 1) AS INT) % 5 AS r FROM scores),
y AS (SELECT * FROM x WHERE NOT (r = 3 AND config_id = 'candidate') UNION ALL SELECT * FROM x WHERE r = 4 AND config_id = 'baseline'),
z AS (SELECT *, CASE WHEN r = 2 AND state = 'ok' THEN document_characters + 1 ELSE retrieved_characters END AS got FROM y),
v(rule, violations) AS (
  SELECT 'quartile_range', count(*) FROM z WHERE r = 0
  UNION ALL SELECT 'partition_domain', count(*) FROM z WHERE r = 1
  UNION ALL SELECT 'phase_partition', count(*) FROM z WHERE r = 1
  UNION ALL SELECT 'context_within_document', count(*) FROM z WHERE got > document_characters
  UNION ALL SELECT 'budget', count(*) FROM z WHERE state = 'ok' AND got <> least({BUDGET}, document_characters)
  UNION ALL SELECT 'unpaired', count(*) FROM (SELECT case_id FROM z GROUP BY 1 HAVING count(DISTINCT config_id) <> 2)
  UNION ALL SELECT 'duplicate_case', count(*) FROM (SELECT 1 FROM z GROUP BY case_id, config_id HAVING count(*) > 1)
  UNION ALL SELECT 'row_count', CASE WHEN (SELECT count(*) FROM z) <> (SELECT count(*) FROM scores) THEN 1 ELSE 0 END)
SELECT rule, violations FROM v WHERE violations > 0"""
)
def packet_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth item of a packet is broken in one way: band, partition, size, pairing,
    repetition."""
    run, configs, cases = packet(spark, d)
    kind = _item() % 5
    kept = cases.where(~((kind == 3) & (F.col("config_id") == "candidate")))
    again = cases.where((kind == 4) & (F.col("config_id") == "baseline"))
    too_long = (kind == 2) & (F.col("response_state") == "ok")
    broken = kept.unionByName(again).withColumns(
        {
            "length_quartile": F.when(kind == 0, 9).otherwise(F.col("length_quartile")),
            "partition": F.when(kind == 1, "training").otherwise(F.col("partition")),
            "retrieved_characters": F.when(too_long, F.col("document_characters") + 1).otherwise(F.col("retrieved_characters")),
        }
    )
    found = checks.packet_violations(run, configs, cut_lineage(broken))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query(
    "WITH "
    + evidence.QUESTIONS_SQL
    + """, g AS (SELECT case_id, config_id, document_id, CAST(split_part(case_id, '-', 1) AS INT) % 6 AS r,
  unnest(['a', 'b']) AS config_id FROM (SELECT case_id, document_id, NULL AS config_id FROM questions)),
base AS (SELECT case_id, config_id_1 AS config_id, document_id, r FROM g),
p AS (SELECT CASE WHEN r = 0 THEN concat('x', case_id) ELSE case_id END AS case_id, CASE WHEN r = 1 AND config_id = 'b' THEN 'zz' ELSE config_id END AS config_id,
    CASE WHEN r = 3 THEN document_id + 1 ELSE document_id END AS document_id, r = 4 AND config_id = 'a' AS failed FROM base
  UNION ALL SELECT case_id, config_id, document_id, false FROM base WHERE r = 2 AND config_id = 'a'),
c AS (SELECT case_id, config_id, k * 10 AS s, k * 10 + 10 AS e FROM base, (SELECT unnest(range(4)) AS k) WHERE k < 3 OR r = 5),
v(case_id, config_id, rule) AS (
  SELECT case_id, config_id, 'unknown_case' FROM p WHERE case_id NOT IN (SELECT case_id FROM questions)
  UNION SELECT case_id, config_id, 'unknown_configuration' FROM p WHERE config_id NOT IN ('a', 'b')
  UNION SELECT case_id, config_id, 'duplicate_prediction' FROM p GROUP BY 1, 2 HAVING count(*) > 1
  UNION SELECT case_id, config_id, 'wrong_document' FROM p JOIN questions q USING (case_id) WHERE p.document_id <> q.document_id
  UNION SELECT case_id, config_id, 'error_with_chunks' FROM c JOIN p USING (case_id, config_id) WHERE failed
  UNION SELECT case_id, config_id, 'too_many_chunks' FROM c GROUP BY 1, 2 HAVING count(*) > 3
  UNION SELECT case_id, config_id, 'invalid_offsets' FROM c JOIN p USING (case_id, config_id) JOIN docs USING (document_id) WHERE e > length(text))
SELECT rule, count(*) AS predictions FROM v GROUP BY 1"""
)
def prediction_violations(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of two configurations, every sixth item wrong in one way."""
    asked, docs = evidence.questions(spark, d)
    tasks = cut_lineage(asked.select("case_id", "document_id"))
    kind = _item() % 6
    configs = spark.createDataFrame([("a", 3), ("b", 3)], "config_id string, top_k int")
    base = tasks.withColumn("config_id", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("kind", kind)
    first = F.col("config_id") == "a"
    wrong = base.select(
        F.when(F.col("kind") == 0, F.concat(F.lit("x"), "case_id")).otherwise(F.col("case_id")).alias("case_id"),
        F.when((F.col("kind") == 1) & ~first, "zz").otherwise(F.col("config_id")).alias("config_id"),
        F.when(F.col("kind") == 3, F.col("document_id") + 1).otherwise(F.col("document_id")).alias("document_id"),
        F.when((F.col("kind") == 4) & first, "error").otherwise("ok").alias("status"),
    )
    again = base.where((F.col("kind") == 2) & first).select("case_id", "config_id", "document_id", F.lit("ok").alias("status"))
    pieces = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 5, 3).otherwise(2))).alias("k")
    chunks = base.select("case_id", "config_id", pieces)
    chunks = chunks.select("case_id", "config_id", (F.col("k") * 10).alias("start"), (F.col("k") * 10 + 10).alias("end"))
    found = checks.prediction_violations(wrong.unionByName(again), chunks, tasks, configs, docs)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("predictions"))


@query(
    "WITH "
    + evidence.QUESTIONS_SQL
    + """, t AS (SELECT case_id, document_id FROM questions WHERE item_id % 7 <> 2),
r AS (SELECT case_id, CASE WHEN item_id % 7 = 4 THEN document_id + 1 ELSE document_id END AS document_id FROM questions WHERE item_id % 7 <> 5)
SELECT case_id, t.document_id AS task_document, r.document_id AS reference_document FROM t FULL JOIN r USING (case_id)
WHERE t.document_id IS DISTINCT FROM r.document_id"""
)
def membership_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Tasks and references that no longer name the same cases and documents."""
    tasks, references = corpus.split_gold(cut_lineage(evidence.questions(spark, d)[0]))
    kind = _item() % 7
    moved = F.when(kind == 4, F.col("document_id") + 1).otherwise(F.col("document_id"))
    references = references.where(kind != 5).withColumn("document_id", moved)
    return corpus.membership_mismatch(tasks.where(kind != 2), references)


# --- answers and reviews -----------------------------------------------------


@query(
    """WITH c AS (SELECT item_id, text, CASE WHEN item_id % 5 <> 4 THEN substr(text, 1, 20) END AS expected, concat('k', item_id) AS clause FROM benchmark),
a AS (SELECT *, (item_id % 5 = 3 OR (item_id % 5 = 4 AND item_id % 2 = 0)) AS abstain FROM c),
g AS (SELECT *, CASE WHEN NOT abstain THEN concat('  ', substr(text, 1, 20), ' ') END AS answer,
  CASE WHEN NOT abstain THEN CASE WHEN item_id % 5 = 1 THEN 'wrong' ELSE clause END END AS given,
  CASE WHEN NOT abstain THEN CASE WHEN item_id % 5 = 2 THEN 'not there' ELSE substr(text, 5, 15) END END AS quote FROM a)
SELECT item_id AS case_id, coalesce(CASE WHEN expected IS NULL THEN abstain AND answer IS NULL AND given IS NULL AND quote IS NULL
  ELSE NOT abstain AND lower(trim(answer)) = lower(trim(expected)) AND given = clause AND quote <> '' AND contains(text, quote) END, false) AS auto_pass
FROM g"""
)
def graded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Scripted answers about passages: right, from another clause, misquoted, withheld,
    and about facts that are not there."""
    items = b.table(spark, d, "benchmark")
    kind = F.col("item_id") % 5
    clause = F.concat(F.lit("k"), F.col("item_id").cast("string"))
    head = F.substring("text", 1, 20)
    document = F.concat(F.lit("d"), (F.col("item_id") % 7).cast("string"))
    cases = items.select(
        F.col("item_id").alias("case_id"), document.alias("document_id"), F.when(kind != 4, head).alias("answer"), clause.alias("clause_id")
    )
    clauses = items.select(document.alias("document_id"), clause.alias("clause_id"), F.col("text").alias("clause_text"))
    abstain = (kind == 3) | ((kind == 4) & (F.col("item_id") % 2 == 0))
    answers = items.select(
        F.col("item_id").alias("case_id"),
        F.when(~abstain, F.concat(F.lit("  "), head, F.lit(" "))).alias("answer"),
        F.when(~abstain, F.when(kind == 1, F.lit("wrong")).otherwise(clause)).alias("clause_id"),
        F.when(~abstain, F.when(kind == 2, "not there").otherwise(F.substring("text", 5, 15))).alias("quote"),
        abstain.alias("abstain"),
    )
    return requests.grade_answers(answers, cases, clauses).select("case_id", "auto_pass")


@query(
    "WITH "
    + evidence.QUESTIONS_SQL
    + f""", d0 AS (SELECT * FROM docs WHERE document_id IN (SELECT document_id FROM questions) AND document_id % 5 <> 3 AND length(text) >= 20),
gold AS (SELECT document_id, case_id, questions.answer_start AS s, answer_end AS e, passage FROM questions JOIN d0 USING (document_id)
  JOIN found USING (item_id, document_id) WHERE NOT is_impossible),
m1 AS (SELECT document_id, length(text) - 10 AS s, length(text) AS e, document_id % 5 = 1 AS changed FROM d0),
m2 AS (SELECT document_id, min(s) AS s, min(s) + 5 AS e, false AS changed FROM gold JOIN d0 USING (document_id) WHERE document_id % 5 = 2 GROUP BY document_id
  HAVING min(s) + 5 <= any_value(length(text)) - 10),
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2),
ch AS (SELECT document_id, unnest(range(length(text))) AS pos, text FROM d0),
x AS (SELECT ch.document_id, pos, substr(text, pos + 1, 1) AS c, m.s IS NOT NULL AS gone FROM ch LEFT JOIN m ON m.document_id = ch.document_id AND pos >= m.s AND pos < m.e),
masked AS (SELECT document_id, string_agg(CASE WHEN gone AND NOT regexp_matches(c, '[{SPACE}]') THEN 'X' ELSE c END, '' ORDER BY pos) AS text FROM x GROUP BY 1),
problems AS (
  SELECT DISTINCT document_id, 'mask_meets_gold' AS problem FROM gold g JOIN m USING (document_id) WHERE g.s < m.e AND m.s < g.e
  UNION SELECT document_id, 'text_changed' FROM m WHERE changed
  UNION SELECT document_id, 'quote_mismatch' FROM gold g JOIN masked k USING (document_id) WHERE substr(k.text, CAST(g.s AS BIGINT) + 1, length(passage)) <> passage)
SELECT document_id, problem, sha256(text) AS masked_hash FROM masked LEFT JOIN problems USING (document_id)"""
)
def review_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Documents prepared for review: the end of each masked, some masks on gold, some of a
    text that has changed, some documents held back."""
    asked, docs = evidence.questions(spark, d)
    asked = cut_lineage(asked)
    docs = docs.join(asked.select("document_id").distinct(), "document_id", "left_semi")
    docs = cut_lineage(docs.where(F.length("text") >= 20))
    _, references = corpus.split_gold(asked.join(docs.select("document_id"), "document_id", "left_semi"))
    n = F.length("text")
    kind = F.col("document_id") % 5
    end = docs.select("document_id", (n - 10).alias("start"), n.alias("end"), "text", (kind == 1).alias("changed"))
    gold = references.select("document_id", F.explode("answers").alias("a"))
    first = gold.where(kind == 2).groupBy("document_id").agg(F.min("a.answer_start").alias("start"))
    on_gold = first.join(docs, "document_id").where(F.col("start") + 5 <= n - 10)
    on_gold = on_gold.select("document_id", "start", (F.col("start") + 5).alias("end"), "text", F.lit(False).alias("changed"))
    segment = F.expr("substring(text, start + 1, end - start)")
    masks = end.unionByName(on_gold).select(
        "document_id", "start", "end", F.sha2(F.when(F.col("changed"), "another text").otherwise(segment), 256).alias("segment_sha256")
    )
    held = docs.where(kind == 3)
    prepared, problems = corpus.prepare_review_bundle(docs, cut_lineage(masks), references, held)
    return prepared.join(problems, "document_id", "left").select(
        "document_id", "problem", F.sha2("text", 256).alias("masked_hash")
    )


# --- effects and capacity ----------------------------------------------------

CONTROL_MAX = 64
_MODEL = b.EFFECT_SQL[b.EFFECT_SQL.index("d AS (") :]


def _arms_sql(control: str, arm: str) -> str:
    raw = f"""n AS (SELECT lawyer_id, count(*) AS c FROM sessions GROUP BY 1),
raw AS (SELECT CAST(hours AS DOUBLE) AS y, {arm} AS arm, fee_arrangement AS grp, concat_ws('/', fee_arrangement, practice_area) AS cell, lawyer_id AS cluster
  FROM time LEFT JOIN n USING (lawyer_id) JOIN matters USING (matter_id)),
kept AS (SELECT * FROM raw WHERE arm >= 0),
"""
    body = with_sql(SESSIONS_SQL, TIME_SQL, MATTERS_SQL, raw + _MODEL.replace("FROM raw", "FROM kept").strip())
    return f"""({body}SELECT '{control}' AS control, grp AS fee_arrangement, round((exp(b) - 1) * 100, 6) AS estimate_pct,
  round((exp(b - 1.96 * sqrt(v)) - 1) * 100, 6) AS ci_low_pct, round((exp(b + 1.96 * sqrt(v)) - 1) * 100, 6) AS ci_high_pct,
  treated AS treated_entries, control AS control_entries FROM beta JOIN cov ON ga = grp AND gb = grp)"""


@query(
    "SELECT * FROM "
    + _arms_sql("never adopted", f"CASE WHEN is_post_adoption THEN 1 WHEN ai_sessions IS NULL AND coalesce(c, 0) < {CONTROL_MAX} THEN 0 ELSE -1 END")
    + " UNION ALL SELECT * FROM "
    + _arms_sql("same lawyers", "CASE WHEN is_post_adoption THEN 1 WHEN ai_sessions IS NULL THEN 0 ELSE -1 END")
)
def control_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """The effect on hours with a clean and with a contaminated control."""
    matters = b.matters(spark, d).select("matter_id", "fee_arrangement", "practice_area")
    time = b.time_entries(spark, d).join(matters, "matter_id")
    time = cut_lineage(time.withColumn("cell", F.concat_ws("/", "fee_arrangement", "practice_area")))
    df = regression.control_sensitivity(time, b.sessions(spark, d), CONTROL_MAX)
    names = ["estimate_pct", "ci_low_pct", "ci_high_pct"]
    return rounded(df.select("control", "fee_arrangement", *names, "treated_entries", "control_entries"), *names)


@query(
    """WITH c AS (SELECT c_mktsegment AS level, c_custkey, count(*) FILTER (WHERE o_orderstatus <> 'O') AS freed, count(*) FILTER (WHERE o_orderstatus = 'F') AS returned
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT level, count(*) AS lawyers, CAST(sum(freed) AS BIGINT) AS freed, CAST(sum(returned) AS BIGINT) AS returned,
  round(sum(returned) / nullif(sum(freed), 0), 6) AS returned_share, round(sum(freed - returned) / count(*), 6) AS net_hours_lost_per_lawyer FROM c GROUP BY 1"""
)
def freed_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Closed orders as hours set free, finished ones as hours that came back."""
    status = F.col("o_orderstatus")
    per = b.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("lawyer_id")).agg(
        F.count(F.when(status != "O", 1)).alias("freed"), F.count(F.when(status == "F", 1)).alias("returned")
    )
    levels = b.lawyers(spark, d).select("lawyer_id", "level")
    df = quality.freed_capacity_summary(per.join(levels, "lawyer_id"), "level")
    return rounded(df, "returned_share", "net_hours_lost_per_lawyer")


@query(
    with_sql(SESSIONS_SQL, LAWYERS_SQL)
    + """, m AS (SELECT year(activity_date) * 100 + month(activity_date) AS ym, practice_group, count(DISTINCT lawyer_id) AS a
  FROM sessions JOIN lawyers USING (lawyer_id) GROUP BY 1, 2),
p AS (SELECT practice_group, count(*) AS lawyers FROM lawyers WHERE is_active GROUP BY 1),
t AS (SELECT practice_group, avg(a) / any_value(lawyers) AS adoption FROM p LEFT JOIN m USING (practice_group) GROUP BY 1)
SELECT x.practice_group AS numerator, y.practice_group AS denominator, round(x.adoption / nullif(y.adoption, 0), 6) AS ratio
FROM t x, t y WHERE x.practice_group = 'g1' AND y.practice_group = 'g3'"""
)
def adoption_ratio(spark: SparkSession, d: str) -> DataFrame:
    plateau = adoption.adoption_plateau(b.sessions(spark, d), b.lawyers(spark, d), "practice_group")
    return rounded(adoption.group_ratio(plateau, "practice_group", "g1", "g3"), "ratio")


@query(b.over_months_sql(operations.ALERT_SQL))
def alert_status_by_month(spark: SparkSession, d: str) -> DataFrame:
    """The rules where sessions span several months and a quarter of the matters is
    sensitive, so that every rule has a value."""
    status = alerts.alert_status(b.star(spark, d, over_months=True), alerts.rule_catalogue(spark))
    return rounded(status, "current_value")


# --- logs and exports --------------------------------------------------------


@query(
    f"""SELECT 'refresh' AS job, 'all months' AS parameters, (SELECT count(*) FROM ({operations.ORACLES["adoption_by_group_month"]})) AS rows_written,
  'Success' AS status, NULL AS message
UNION ALL SELECT 'broken', '{{}}', 0, 'Failed', 'no source'
UNION ALL SELECT 'refresh', 'all months', 0, 'Success', NULL"""
)
def run_log(spark: SparkSession, d: str) -> DataFrame:
    """A refresh, a job that fails, and the refresh again, as their log tells."""
    log, path = shared_dir(spark, "run-log"), shared_dir(spark, "logged-snapshot")
    cells = cut_lineage(adoption.adoption_by_group(b.sessions(spark, d), b.lawyers(spark, d)))

    def refresh() -> int:
        return store.merge_snapshot(cells, path, _STARTED)

    def broken() -> int:
        raise ValueError("no source")

    for job, parameters, work in (("refresh", "all months", refresh), ("broken", "{}", broken), ("refresh", "all months", refresh)):
        with contextlib.suppress(ValueError):
            store.run_logged(spark, log, job, parameters, work)
    told = spark.read.schema(store.RUN_LOG_SCHEMA).parquet(log)
    return told.select("job", "parameters", "rows_written", "status", "message")


@query(
    events.REQUESTS_SQL
    + """, r AS (SELECT status, count(*) AS requests, CAST(sum(attempt_count) AS BIGINT) AS attempts, count(review_method) AS reviewed,
  round(sum(round(duration_ms, 6)), 3) AS duration_ms FROM latest GROUP BY 1)
SELECT 'csv' AS format, * FROM r UNION ALL SELECT 'json', * FROM r"""
)
def exported_views(spark: SparkSession, d: str) -> DataFrame:
    """Requests exported as CSV, where lists are JSON text, and as JSON, read back."""
    root = shared_dir(spark, "export")
    latest = cut_lineage(requests.latest_requests(events.valid(spark, d)))
    telemetry.export_views({"requests": latest}, root)
    attempts = latest.schema["attempts"].dataType
    names = "status string, review_method string, duration_ms double, attempts string"
    csv = spark.read.option("header", True).option("escape", '"').csv(f"{root}/requests.csv")
    csv = csv.select("status", "review_method", F.col("duration_ms").cast("double"), F.from_json("attempts", attempts).alias("attempts"))
    json = spark.read.schema(names).json(f"{root}/requests.json").withColumn("attempts", F.from_json("attempts", attempts))

    def told(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.lit(name).alias("format"), "status").agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum(F.size("attempts")).alias("attempts"),
            F.count("review_method").alias("reviewed"),
            F.round(F.sum(F.round("duration_ms", 6)), 3).alias("duration_ms"),
        )

    return told(csv, "csv").unionByName(told(json, "json"))
