"""Queries that go through files and stores: written, read back, refreshed, restarted."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import parse_events, validate_events
from ..operators import adoption
from ..session import shared_dir
from ..sources import corpus, star, store, telemetry
from ..streaming import ingest
from . import bindings as b
from . import operations
from . import telemetry as events
from .bindings import LAWYERS_SQL, SESSIONS_SQL, with_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return register


@query(
    with_sql(SESSIONS_SQL)
    + """SELECT CAST(year(activity_date) * 100 + month(activity_date) AS INT) AS activity_month, status,
  count(*) AS rows, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM sessions WHERE session_id % 50 <> 7 GROUP BY 1, 2
UNION ALL SELECT NULL, 'corrupt', count(*), NULL FROM sessions WHERE session_id % 50 = 7"""
)
def star_csv(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as a CSV of the star, some lines broken, read, quarantined, stored by month."""
    root, out = shared_dir(spark, "star-csv"), shared_dir(spark, "star")
    rows = b.sessions(spark, d)
    lawyer = F.col("lawyer_id").cast("string")
    broken = F.when(F.col("session_id") % 50 == 7, F.concat(F.lit("x"), lawyer)).otherwise(lawyer)
    named = {
        "session_id": F.col("session_id"),
        "lawyer_id": broken,
        "date_id": F.date_format("activity_date", "yyyyMMdd"),
        "tokens_in": F.lit(None),
        "tokens_out": F.lit(None),
        "cost_aud": F.col("cost").cast("decimal(10,4)"),
        "source_system": F.lit('feed, "one"'),
    }
    schema = star.STAR_SCHEMAS["fact_ai_session"]
    names = [c.split()[0] for c in schema.split(", ")]
    lines = rows.select(*[named.get(n, F.col(n) if n in rows.columns else F.lit(None)).cast("string").alias(n) for n in names])
    lines.write.option("header", True).option("escape", '"').csv(f"{root}/fact_ai_session.csv")
    read = star.read_star(spark, root, tables={"fact_ai_session": schema})
    good, bad = star.quarantine(read["fact_ai_session"])
    star.write_star({"fact_ai_session": good}, out)
    stored = star.read_months(spark, out, "fact_ai_session", 202312, 202402)
    counted = stored.groupBy("activity_month", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("latency_ms").alias("latency_ms")
    )
    nothing = F.lit(None)
    corrupt = bad.agg(F.count(F.lit(1)).alias("rows")).select(
        nothing.cast("int").alias("activity_month"), F.lit("corrupt").alias("status"), "rows", nothing.cast("long").alias("latency_ms")
    )
    return counted.unionByName(corrupt)


@query(events.ORACLES["event_validation"])
def event_files(spark: SparkSession, d: str) -> DataFrame:
    """Events as files of JSON lines, read back; per type what is accepted and which rule
    the rejected ones break."""
    root = shared_dir(spark, "event-files")
    events.event_lines(b.table(spark, d, "events")).write.text(root)
    good, bad = telemetry.accepted_and_rejected(telemetry.read_events(spark, root))
    kept = good.select("event_type", F.lit("valid").alias("rule"))
    out = kept.unionByName(bad.select("event_type", F.explode("violations").alias("rule")))
    return out.groupBy("event_type", "rule").agg(F.count(F.lit(1)).alias("events"))


_CELLS_SQL = operations.ORACLES["adoption_by_group_month"]
_AT = dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 2)


@query(
    f"""WITH half AS ({_CELLS_SQL.replace("FROM sessions JOIN", "FROM (SELECT * FROM sessions WHERE session_id % 2 = 0) JOIN")}),
whole AS ({_CELLS_SQL})
SELECT w.year_month, w.level, w.practice_group, w.office, w.lawyers, w.active_lawyers, w.sessions, w.adoption_rate,
  CASE WHEN h.lawyers = w.lawyers AND h.active_lawyers = w.active_lawyers AND h.sessions = w.sessions
    THEN '{_AT[0]}' ELSE '{_AT[1]}' END AS refreshed_at
FROM whole w LEFT JOIN half h ON h.year_month = w.year_month AND h.level = w.level AND h.practice_group = w.practice_group AND h.office = w.office"""
)
def snapshot_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The adoption snapshot of half the sessions and of months that have none later on,
    refreshed with all: cells that stay the same keep their time, months that lost every
    session go."""
    path = shared_dir(spark, "snapshot")
    sessions, lawyers = b.sessions(spark, d), b.lawyers(spark, d)
    half = sessions.where("session_id % 2 = 0")
    later = half.withColumn("activity_date", F.date_add("activity_date", 70))
    for rows, at in ((half.unionByName(later), _AT[0]), (sessions, _AT[1])):
        store.merge_snapshot(adoption.adoption_by_group(rows, lawyers), path, at)
    stored = store.read_snapshot(spark, path)
    return stored.withColumns(
        {
            "adoption_rate": F.col("adoption_rate").cast("double"),
            "refreshed_at": F.date_format("refreshed_at", "yyyy-MM-dd HH:mm:ss"),
        }
    )


@query(events.ORACLES["stream_event_log"])
def event_store_restarts(spark: SparkSession, d: str) -> DataFrame:
    """The event log in batches that all have number 0, as after lost checkpoints, with
    a replay in between: nothing is lost and nothing is stored twice."""
    kept = ingest.EventStore(f"{shared_dir(spark, 'restarts')}/store")
    rows = b.table(spark, d, "events")
    first, second = rows.where("event_id % 4 < 2"), rows.where("event_id % 4 >= 2")
    for part in (first, first.unionByName(second.where("event_id % 8 = 2")), rows):
        kept.ingest(validate_events(parse_events(events.event_lines(part, faults=False))), 0)
    return kept.log(spark).groupBy("event_type", "source_id").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("request_id").alias("requests")
    )


@query(
    """SELECT concat('c', doc_id % 3) AS category, doc_id % 2 = 1 AS is_impossible, count(*) AS questions, count(DISTINCT doc_id) AS documents,
  CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN length(substr(text, 1, 10)) ELSE 0 END) AS BIGINT) AS answer_characters
FROM documents GROUP BY 1, 2"""
)
def qa_corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as nested question-answer files, read back as documents and questions."""
    root = shared_dir(spark, "qa-corpus")
    docs = b.table(spark, d, "documents")
    none = F.array().cast("array<struct<answer_start:int,text:string>>")
    answer = F.struct(F.lit(0).alias("answer_start"), F.substring("text", 1, 10).alias("text"))
    asked = F.struct(
        F.format_string("%d__c%d", "doc_id", F.col("doc_id") % 3).alias("id"),
        F.lit("How does it begin?").alias("question"),
        (F.col("doc_id") % 2 == 1).alias("is_impossible"),
        F.when(F.col("doc_id") % 2 == 0, F.array(answer)).otherwise(none).alias("answers"),
    )
    paragraph = F.struct(F.col("text").alias("context"), F.array(asked).alias("qas"))
    entry = F.struct(F.col("doc_id").cast("string").alias("title"), F.array(paragraph).alias("paragraphs"))
    # one object per file, as such corpora come; a file holds a hundred documents
    files = docs.groupBy(F.floor(F.col("doc_id") / 100).alias("file")).agg(F.collect_list(entry).alias("data"))
    files.repartition("file").write.partitionBy("file").json(root)
    documents, questions = corpus.read_qa_corpus(spark, root)
    return (
        questions.join(documents.select("document_id", "text"), "document_id")
        .groupBy("category", "is_impossible")
        .agg(
            F.count(F.lit(1)).alias("questions"),
            F.countDistinct("document_id").alias("documents"),
            F.sum(F.length("text")).alias("characters"),
            F.sum(F.coalesce(F.length(F.get("answers", 0)["text"]), F.lit(0))).alias("answer_characters"),
        )
    )
