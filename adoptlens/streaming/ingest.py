"""Idempotent, all-or-nothing ingestion of event micro-batches."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.events import PAYLOAD_TYPE, parse_events, validate_events
from ..sources.published import PART, Published, State
from ..operators.ingestion import event_counts, ingest_conflicts, provenance_violations, request_suspects

LOG_SCHEMA = (
    "event_json string, payload_hash string, schema_version int, event_id string, "
    "source_id string, data_origin string, run_kind string, request_id string, trace_id string, "
    f"revision int, occurred_at timestamp, payload {PAYLOAD_TYPE}, event_type string, batch bigint"
)
#: What the checks of a batch need of stored events.
IDENTITY_SCHEMA = (
    "event_id string, payload_hash string, request_id string, event_type string, revision int, "
    "source_id string, data_origin string, run_kind string, trace_id string"
)
LEDGER_SCHEMA = (
    "sequence bigint, started_at timestamp, finished_at timestamp, status string, "
    "event_count bigint, inserted_count bigint, error_code string, batch bigint"
)
QUARANTINE_SCHEMA = "event_json string, rules string, batch bigint"
LEDGER_PARTS = 16
#: Lines of a refused batch for each of the folders, up to one per bucket, that hold them.
LINES_PER_PIECE = 10_000
#: Lines of a batch and a bucket that one task sorts; a bucket with more goes to several.
LINES_PER_TASK = 100_000
#: How a batch is held while it is judged: a task holds one row group, however large its input is.
HELD = {"compression": "zstd", "parquet.block.size": str(16 << 20)}


def names_of(schema: str) -> list[str]:
    return [c.name for c in StructType.fromDDL(schema)]


def bucket(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets))


@dataclass(frozen=True)
class EventStore:
    """Event log, request identities, ledger and quarantine below one shared folder.

    One streaming query at a time feeds a store. The log is bucketed by event id, the
    identities by request id; a batch reads only the buckets its own ids hash to, without
    payloads, and publishes log, identities and its ledger row at once. A batch is named by
    its number and its content: a retry after a lost driver finds its ledger row and adds
    nothing, and a query with a new checkpoint, which counts from 0 again, adds to what is
    stored. Small folders of a bucket are joined as they add up.
    """

    root: str
    buckets: int = 64

    @property
    def tables(self) -> Published:
        return Published(self.root)

    def log(self, spark: SparkSession) -> DataFrame:
        return self.tables.read(spark, "event_log", LOG_SCHEMA)

    def ledger(self, spark: SparkSession) -> DataFrame:
        return self.tables.read(spark, "ledger", LEDGER_SCHEMA)

    def quarantine(self, spark: SparkSession) -> DataFrame:
        return self.tables.read(spark, "quarantine", QUARANTINE_SCHEMA)

    def related(self, batch: DataFrame, events: list[int], requests: list[int], state: State) -> tuple[DataFrame, DataFrame]:
        """Stored identities that share an event id, and those that share a request id,
        with a batch whose ids hash to these buckets."""
        spark = batch.sparkSession
        ids = batch.select("event_id").distinct()
        asked = batch.where(F.col("request_id").isNotNull()).select("request_id").distinct()
        stored = self.tables.read(spark, "event_log", LOG_SCHEMA, map(str, events), state).select(*names_of(IDENTITY_SCHEMA))
        named = self.tables.read(spark, "request_events", IDENTITY_SCHEMA, map(str, requests), state)
        return stored.join(ids, "event_id", "left_semi"), named.join(asked, "request_id", "left_semi")

    def ingest(self, validated: DataFrame, batch_id: int) -> str:
        """One batch of ``validate_events`` rows, all of it or nothing; returns the ledger
        status."""
        spark = validated.sparkSession
        started = spark.range(1).select(F.current_timestamp()).head()[0]
        state = self.tables.state(spark)
        buckets = state.settings.get("buckets", self.buckets)
        # payloads are parsed again where they are stored: a line is shorter than its fields.
        # Read several times, so written and not cached: lines of one task may be gigabytes
        rows = validated.select("event_json", *names_of(IDENTITY_SCHEMA), "violations")
        held = self.tables.hold(rows, **HELD)
        try:
            batch = spark.read.schema(rows.schema).parquet(held)
            request = F.when(F.col("request_id").isNotNull(), bucket(F.col("request_id"), buckets))
            total, content, *touched = batch.agg(
                F.count(F.lit(1)),
                F.sum(F.xxhash64("event_json").cast("decimal(38,0)")),
                F.collect_set(bucket(F.col("event_id"), buckets)),
                F.collect_set(request),
            ).head()
            key = spark.range(1).select(F.xxhash64(F.lit(batch_id), F.lit(str(content)))).head()[0]
            part = str(key % LEDGER_PARTS)
            done = self.tables.read(spark, "ledger", LEDGER_SCHEMA, [part], state).where(F.col("batch") == key).head(1)
            if done:
                return done[0]["status"]
            error, inserted, plain = self._judged(batch, *touched, total, state)
            if error is None and inserted:
                lines = self._fresh_lines(batch, touched[0], None if plain else state, buckets, total)
                fresh = parse_events(lines, "event_json").withColumn("batch", F.lit(key).cast("long"))
                log = self.tables.stage(
                    fresh.select(*names_of(LOG_SCHEMA)), "event_log", bucket(F.col("event_id"), buckets),
                    sort=("event_type", "event_id"), placed=True,
                )
                state = state.added("event_log", log)
                added = self._staged(spark, log).select(*names_of(IDENTITY_SCHEMA))
                added = added.where(F.col("request_id").isNotNull())
                named = self.tables.stage(added, "request_events", bucket(F.col("request_id"), buckets), sort=("request_id",))
                state = state.added("request_events", named)
            elif error is not None:
                lines = batch.select("event_json", F.array_join("violations", ",").alias("rules"))
                lines = lines.withColumn("batch", F.lit(key).cast("long"))
                # a refused batch may be as large as any other: its lines go to many tasks
                pieces = min(buckets, total // LINES_PER_PIECE + 1)
                refused = self.tables.stage(lines, "quarantine", bucket(F.col("event_json"), pieces))
                state = state.added("quarantine", refused)
            status = "success" if error is None else "failed"
            entry = spark.range(1).select(
                F.lit(batch_id).cast("long").alias("sequence"),
                F.lit(started).alias("started_at"),
                F.current_timestamp().alias("finished_at"),
                F.lit(status).alias("status"),
                F.lit(total).cast("long").alias("event_count"),
                F.lit(inserted).cast("long").alias("inserted_count"),
                F.lit(error).cast("string").alias("error_code"),
                F.lit(key).cast("long").alias("batch"),
            )
            state = state.added("ledger", self.tables.stage(entry, "ledger", F.lit(part)))
            self.tables.publish(spark, replace(state, settings={"buckets": buckets}))
        finally:
            self.tables.let_go(spark, held)
        self.compact(spark)
        return status

    def compact(self, spark: SparkSession) -> None:
        """Joins small folders where a bucket has many; readers see the same rows."""
        self.tables.compact(spark, "event_log", LOG_SCHEMA, sort=("event_type", "event_id"))
        self.tables.compact(spark, "request_events", IDENTITY_SCHEMA, sort=("request_id",))
        self.tables.compact(spark, "ledger", LEDGER_SCHEMA)

    def _staged(self, spark: SparkSession, folders: dict[str, list[tuple[int, str]]]) -> DataFrame:
        return self.tables.read(spark, "staged", LOG_SCHEMA, state=State(tables={"staged": folders}))

    def _judged(self, batch: DataFrame, events: list[int], requests: list[int], total: int, state: State) -> tuple[str | None, int, bool]:
        """What is wrong with a batch; without an error how many events it adds, and whether
        these are all its lines. Hashes tell whether there is anything that the exact checks
        have to look at."""
        spark = batch.sparkSession
        if not batch.where(F.size("violations") > 0).isEmpty():
            return "invalid_event", 0, False
        stored = self.tables.read(spark, "event_log", LOG_SCHEMA, map(str, events), state)
        named = self.tables.read(spark, "request_events", IDENTITY_SCHEMA, map(str, requests), state)
        fresh, suspects = event_counts(batch, stored).head()
        if suspects or not request_suspects(batch, named).isEmpty():
            same_event, same_request = self.related(batch, events, requests, state)
            both = same_event.unionByName(same_request).dropDuplicates(["event_id", "payload_hash"])
            if not ingest_conflicts(batch, both).isEmpty():
                return "identity_conflict", 0, False
            if not provenance_violations(batch, same_request).isEmpty():
                return "provenance_changed", 0, False
        if suspects:
            # different ids share a hash
            fresh = batch.select("event_id").distinct().count() - same_event.select("event_id").distinct().count()
        return None, fresh, fresh == total

    def _fresh_lines(self, batch: DataFrame, events: list[int], state: State | None, buckets: int, total: int) -> DataFrame:
        """The lines of a batch that ``state`` does not hold, each event once, in the tasks
        that write its bucket; all lines without a state. A line moves once. Copies are equal
        after the conflict check, so which one is kept does not matter."""
        pieces = total // (buckets * LINES_PER_TASK) + 1
        # other bits than those of the bucket
        piece = F.pmod(F.xxhash64(F.lit(1), "event_id"), F.lit(pieces))
        where = {PART: bucket(F.col("event_id"), buckets).cast("string"), "__piece": piece}

        def placed(rows: DataFrame) -> DataFrame:
            rows = rows.withColumns(where)
            return rows.repartition(PART) if pieces == 1 else rows.repartition(pieces * buckets, PART, "__piece")

        lines = batch.select("event_id", "event_json", F.lit(False).alias("known"))
        if state is None:
            return placed(lines.select("event_id", "event_json"))
        stored = self.tables.read(batch.sparkSession, "event_log", LOG_SCHEMA, map(str, events), state)
        known = stored.select("event_id", F.lit(None).cast("string").alias("event_json"), F.lit(True).alias("known"))
        one = placed(lines.unionByName(known)).groupBy(PART, "__piece", "event_id").agg(
            F.max("known").alias("known"), F.max("event_json").alias("event_json")
        )
        return one.where(~F.col("known"))


def ingest_stream(lines: DataFrame, store: EventStore, checkpoint: str, once: bool = True):
    """Starts the query that feeds the store. ``lines`` is a stream with column value."""
    writer = (
        lines.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: store.ingest(validate_events(parse_events(df)), batch_id) and None)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def dedupe_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First occurrence of each event id inside the watermark; the state stays bounded."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_id"])
