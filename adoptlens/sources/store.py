"""Tables kept by jobs: adoption snapshot, run log, evaluation runs.

Writers are idempotent: a retried job finds its own result and writes the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..functions.exprs import join_null_safe
from ..operators.checks import packet_violations
from ..session import cut_lineage
from .published import NO_PART, Published

SNAPSHOT_KEYS = ("year_month", "level", "practice_group", "office")
SNAPSHOT_SCHEMA = (
    "level string, practice_group string, office string, lawyers bigint, active_lawyers bigint, "
    "sessions bigint, adoption_rate decimal(9,6), refreshed_at timestamp, year_month int"
)
SNAPSHOT_COLUMNS = [c.split()[0] for c in SNAPSHOT_SCHEMA.split(", ")]
RUN_LOG_SCHEMA = (
    "job string, parameters string, started_at timestamp, finished_at timestamp, "
    "rows_written bigint, status string, message string"
)


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored rows; none only if nothing is stored at the path. Any other error, a
    store of another shape for example, is the caller's."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def merged_snapshot(source: DataFrame, stored: DataFrame, refreshed_at) -> DataFrame:
    """Source cells, keeping the stored row (and its ``refreshed_at``) when no count
    changed. ``action``: insert, update, keep or delete."""
    keys = list(SNAPSHOT_KEYS)
    counts = ["lawyers", "active_lawyers", "sessions"]
    new = source.select(
        *[F.col(k) for k in keys],
        F.struct(
            *[F.col(c).cast("long").alias(c) for c in counts],
            F.coalesce("adoption_rate", F.lit(0)).cast("decimal(9,6)").alias("adoption_rate"),
        ).alias("__new"),
    )
    old = stored.select(
        *keys, F.struct(*counts, "adoption_rate", "refreshed_at").alias("__old")
    )
    same = F.lit(True)
    for c in counts:
        same = same & (F.col(f"__new.{c}") == F.col(f"__old.{c}"))
    action = (
        F.when(F.col("__new").isNull(), "delete")
        .when(F.col("__old").isNull(), "insert")
        .when(same, "keep")
        .otherwise("update")
    )
    joined = join_null_safe(new, old, keys, "full").withColumn("action", action)
    keep = F.col("action") == "keep"
    return joined.select(
        *keys,
        *[
            F.when(keep, F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}")).alias(c)
            for c in [*counts, "adoption_rate"]
        ],
        F.when(keep, F.col("__old.refreshed_at"))
        .otherwise(F.lit(refreshed_at).cast("timestamp"))
        .alias("refreshed_at"),
        "action",
    )


def merge_snapshot(
    source: DataFrame, path: str, refreshed_at, year_month: int | None = None
) -> int:
    """Refreshes the snapshot of one month or of all months; returns changed cells.

    Months with a changed cell are written anew beside the old ones, months that lost every
    cell leave the manifest, and one publication switches to all of that. Until then, and
    if the job fails before, readers see the old snapshot.
    """
    spark = source.sparkSession
    snapshot = Published(path)
    state = snapshot.state(spark)
    months = None if year_month is None else [str(year_month)]
    stored = snapshot.read(spark, "snapshot", SNAPSHOT_SCHEMA, months, state)
    if year_month is not None:
        source = source.where(F.col("year_month") == year_month)
    merged = cut_lineage(merged_snapshot(source, stored, refreshed_at))
    is_kept = F.col("action") != "delete"
    # one row per month; a group without a month has the part that Spark names so
    touched = merged.groupBy("year_month").agg(
        F.count(F.when(F.col("action") != "keep", 1)).alias("changed"), F.count(F.when(is_kept, 1)).alias("left")
    )
    touched = touched.where("changed > 0").collect()
    if not touched:
        return 0
    rows = merged.where(is_kept).join(
        merged.where(F.col("action") != "keep").select(F.col("year_month").alias("__month")).distinct(),
        F.col("year_month").eqNullSafe(F.col("__month")), "left_semi",
    )
    new = snapshot.stage(rows.select(*SNAPSHOT_COLUMNS), "snapshot", F.col("year_month"))
    gone = [NO_PART if r["year_month"] is None else str(r["year_month"]) for r in touched if not r["left"]]
    snapshot.publish(spark, state.changed("snapshot", new, gone))
    return sum(r["changed"] for r in touched)


def read_snapshot(spark: SparkSession, path: str, year_month: int | None = None) -> DataFrame:
    """The published snapshot; of one month only its files are listed."""
    months = None if year_month is None else [str(year_month)]
    return Published(path).read(spark, "snapshot", SNAPSHOT_SCHEMA, months)


def run_logged(
    spark: SparkSession, log_path: str, job: str, parameters: str, work: Callable[[], int]
) -> int:
    """Runs a job and appends one log row, also when it fails."""
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows, status, message = 0, "Success", None
    try:
        rows = work()
        return rows
    except Exception as exc:
        status, message = "Failed", str(exc)
        raise
    finally:
        finished = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        spark.createDataFrame(
            [(job, parameters, started, finished, rows, status, message)], RUN_LOG_SCHEMA
        ).coalesce(1).write.mode("append").parquet(log_path)


# --- evaluation runs -------------------------------------------------------

CASE_FIELDS = [
    "run_id",
    "case_id",
    "config_id",
    "document_id",
    "partition",
    "category",
    "length_quartile",
    "document_characters",
    "response_state",
    "is_answerable",
    "gold_character_recall",
    "any_gold_hit",
    "all_gold_covered",
    "context_precision",
    "retrieved_characters",
    "retrieval_latency_ms",
]
RUN_SCHEMA = (
    "run_label string, phase string, protocol_sha256 string, started_at timestamp, "
    "case_origin string, execution_origin string, character_budget int, expected_rows bigint, "
    "packet_hash string, run_id string"
)


class PacketRejected(ValueError):
    pass


def packet_hash(run: DataFrame, configs: DataFrame, cases: DataFrame):
    """Content hash that does not depend on row order: row hashes are added as decimals,
    so copies of a row still count."""
    def rows(df: DataFrame, names: list[str]) -> DataFrame:
        text = F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})
        h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
        return df.agg(F.sum(h).alias("h"), F.count(F.lit(1)).alias("n"))

    parts = [
        rows(run.drop("packet_hash"), [c for c in run.columns if c != "packet_hash"]),
        rows(configs, configs.columns),
        rows(cases, CASE_FIELDS),
    ]
    text = F.concat_ws(
        "|", *[p.select(F.concat_ws(":", F.col("h").cast("string"), F.col("n").cast("string"))).scalar() for p in parts]
    )
    return F.sha2(text, 256)


def ingest_packet(run: DataFrame, configs: DataFrame, cases: DataFrame, store: str) -> int:
    """Imports one evaluation run or nothing.

    The same run with the same content adds 0 rows; with other content it is
    rejected. Cases are written first and the run row last, so a run row means that
    all its cases are there.
    """
    spark = run.sparkSession
    head = run.withColumn("packet_hash", packet_hash(run, configs, cases)).select(
        "run_id", "packet_hash", "expected_rows"
    ).head(2)
    if len(head) != 1:
        raise PacketRejected("a packet holds exactly one run")
    run_id, digest, expected = head[0]
    stored = read_if_exists(spark, f"{store}/experiment_run", RUN_SCHEMA)
    known = stored.where(F.col("run_id") == run_id).select("packet_hash").head(1)
    if known:
        if known[0][0] != digest:
            raise PacketRejected("run identity conflicts with stored content")
        return 0
    problems = packet_violations(run, configs, cases).limit(1).collect()
    if problems:
        raise PacketRejected(f"{problems[0]['rule']} in case {problems[0]['case_id']}")

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "run_id"
        ).parquet(f"{store}/{name}")

    write(cases.select(*CASE_FIELDS), "case_result")
    write(configs.select("config_id", "config_role", "run_id"), "configuration")
    write(
        run.withColumn("packet_hash", F.lit(digest)).select(
            *[c.split()[0] for c in RUN_SCHEMA.split(", ")]
        ),
        "experiment_run",
    )
    return int(expected)


def stored_cases(spark: SparkSession, store: str) -> DataFrame:
    """Case results with run and configuration columns, of finished imports only."""
    runs = spark.read.schema(RUN_SCHEMA).parquet(f"{store}/experiment_run")
    configs = spark.read.parquet(f"{store}/configuration")
    cases = spark.read.parquet(f"{store}/case_result")
    return cases.join(configs, ["run_id", "config_id"]).join(
        runs.select("run_id", "run_label", "phase", "character_budget"), "run_id"
    )
