"""Checks and idempotent selection for a batch of events against the stored log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = ("source_id", "data_origin", "run_kind", "trace_id")


def ingest_conflicts(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Reused identities: one event id with different content, or one request revision
    under different event ids. Any row rejects the batch."""
    columns = ["event_id", "payload_hash", "request_id", "event_type", "revision"]
    rows = incoming.select(*columns, F.lit(True).alias("is_new"))
    if stored is not None:
        rows = rows.unionByName(stored.select(*columns, F.lit(False).alias("is_new")))
    distinct = rows.groupBy(*columns).agg(F.max("is_new").alias("is_new"))
    by_id = (
        distinct.groupBy("event_id")
        .agg(F.countDistinct("payload_hash").alias("versions"), F.max("is_new").alias("is_new"))
        .where((F.col("versions") > 1) & F.col("is_new"))
        .select(F.lit("event_id").alias("kind"), F.col("event_id").alias("key"), "versions")
    )
    by_revision = (
        distinct.where(F.col("request_id").isNotNull())
        .groupBy("request_id", "event_type", "revision")
        .agg(F.countDistinct("event_id").alias("versions"), F.max("is_new").alias("is_new"))
        .where((F.col("versions") > 1) & F.col("is_new"))
        .select(
            F.lit("request_revision").alias("kind"),
            F.concat_ws("/", "request_id", "event_type", F.col("revision").cast("string")).alias("key"),
            "versions",
        )
    )
    return by_id.unionByName(by_revision)


def provenance_violations(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Requests whose source, origin, kind or trace is not the same everywhere."""
    rows = incoming.select("request_id", *IDENTITY, F.lit(True).alias("is_new"))
    if stored is not None:
        rows = rows.unionByName(stored.select("request_id", *IDENTITY, F.lit(False).alias("is_new")))
    return (
        rows.where(F.col("request_id").isNotNull())
        .groupBy("request_id")
        .agg(
            F.countDistinct(F.struct(*IDENTITY)).alias("identities"),
            F.max("is_new").alias("is_new"),
        )
        .where((F.col("identities") > 1) & F.col("is_new"))
        .drop("is_new")
    )


def _pair(*columns: str) -> list[Column]:
    """128 bits of the values as two numbers; null is a value of its own."""
    told = [x for c in columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())]
    return [F.xxhash64(*told), F.xxhash64(F.lit(1), *told)]


def _differ(*names: str) -> Column:
    """Whether a group has two values of a pair of numbers."""
    apart = F.lit(False)
    for n in names:
        apart = apart | (F.min(n) != F.max(n))
    return apart


def event_counts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: ids of a batch that are not stored, and ids that may have different content.

    Ids and contents are hashes here, so that little moves. Ids that share a hash differ in
    content, so without a suspect the counts are those of the ids themselves.
    """
    def narrow(df: DataFrame, is_new: bool) -> DataFrame:
        a, b = _pair("payload_hash")
        return df.select(F.xxhash64("event_id").alias("key"), a.alias("a"), b.alias("b"), F.lit(is_new).alias("is_new"))

    by_id = narrow(incoming, True).unionByName(narrow(stored, False)).groupBy("key").agg(
        F.max("is_new").alias("is_new"), F.min("is_new").alias("is_fresh"), _differ("a", "b").alias("apart")
    )
    return by_id.where("is_new").agg(
        F.count(F.when(F.col("is_fresh"), 1)).alias("fresh"),
        F.count(F.when(F.col("apart"), 1)).alias("suspects"),
    )


def request_suspects(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Hashes of the requests of a batch whose provenance may not be the same everywhere,
    and of their revisions that may have different event ids. Without one there is no such
    request; with one the exact checks decide."""
    def suspects(key: list[str], told: list[str]) -> DataFrame:
        a, b = _pair(*told)
        both = [
            df.where(F.col("request_id").isNotNull()).select(
                _pair(*key)[0].alias("key"), a.alias("a"), b.alias("b"), F.lit(is_new).alias("is_new")
            )
            for df, is_new in ((incoming, True), (stored, False))
        ]
        found = both[0].unionByName(both[1]).groupBy("key").agg(F.max("is_new").alias("is_new"), _differ("a", "b").alias("apart"))
        return found.where("is_new AND apart").select("key")

    by_revision = suspects(["request_id", "event_type", "revision"], ["event_id"])
    return by_revision.unionByName(suspects(["request_id"], list(IDENTITY)))


def dedupe_events(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per new event id. Copies are equal after the conflict check, so which
    one is kept does not matter."""
    fresh = incoming.dropDuplicates(["event_id"])
    if stored is not None:
        fresh = fresh.join(stored.select("event_id"), "event_id", "left_anti")
    return fresh


def ingestion_health(ledger: DataFrame) -> DataFrame:
    """One row: the latest batch, the last failure and the first success after it.

    ``ledger``: sequence, status, finished_at and counts, one row per batch.
    """
    failed = F.col("status") == "failed"
    last = ledger.agg(F.max(F.when(failed, F.col("sequence")))).scalar()
    recovery = (~failed) & (F.col("sequence") > last)
    return ledger.agg(
        F.max("sequence").alias("sequence"),
        F.max_by("status", "sequence").alias("status"),
        F.max_by("finished_at", "sequence").alias("finished_at"),
        F.max_by("event_count", "sequence").alias("event_count"),
        F.max_by("inserted_count", "sequence").alias("inserted_count"),
        F.max_by(F.when(failed, F.col("finished_at")), F.when(failed, F.col("sequence"))).alias(
            "last_failure_at"
        ),
        F.min_by(F.col("finished_at"), F.when(recovery, F.col("sequence"))).alias("__recovered"),
    ).select(
        "sequence",
        "status",
        "finished_at",
        "event_count",
        "inserted_count",
        (F.col("status") == "failed").alias("is_open"),
        "last_failure_at",
        F.when((F.col("status") == "success"), F.col("__recovered")).alias("recovered_at"),
    )
