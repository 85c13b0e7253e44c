"""Source monitoring: stale heartbeats and failed requests, reported on change only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.events import HEARTBEAT

SCOPE = ("source_id", "data_origin", "run_kind")
RULES = ("heartbeat_stale", "latest_request_failed")


def _latest(rows: DataFrame, by: list[str], value: Column, identity: str) -> DataFrame:
    """Latest (time, id) per key with its value; combines on the map side."""
    order = F.struct(F.col("occurred_at"), F.col(identity))
    return rows.groupBy(*by).agg(
        F.max_by(F.struct(F.col("occurred_at").alias("at"), value.alias("status")), order).alias("l")
    )


def _stale(at: Column, status: Column, as_at: Column, minutes: int) -> Column:
    limit = as_at - F.make_dt_interval(mins=F.lit(minutes))
    return at.isNull() | (at < limit) | F.coalesce(status == "failed", F.lit(False))


def _as_rules(rows: DataFrame, keep: list[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(r).alias("rule_key"), F.col(f"__{r}").alias("is_open")) for r in RULES]
    )
    return rows.select(*keep, F.inline(pairs))


def _check_of(time: str, step: int) -> Column:
    """The first check, in seconds, that is not before a time; a part of a second counts."""
    return F.ceil(F.unix_micros(time) / F.lit(step * 1_000_000)) * step


def check_points(events: DataFrame, minutes: int) -> DataFrame:
    """Regular check times per scope, from the first event to the first check after
    the last one."""
    step = minutes * 60
    bounds = events.groupBy(*SCOPE).agg(
        F.min("occurred_at").alias("a"), F.max("occurred_at").alias("b")
    )
    return bounds.select(
        *SCOPE, F.explode(F.sequence(_check_of("a", step), _check_of("b", step) + step, F.lit(step))).alias("check_s")
    )


def monitor_states(
    events: DataFrame, requests: DataFrame, step_minutes: int, stale_minutes: int = 10
) -> DataFrame:
    """State of both rules at every check point of every scope.

    Events shrink to the latest one per scope and check interval before anything is
    ordered, so a hot source costs one row per check. ``requests`` are the current
    revisions with their status.
    """
    step = step_minutes * 60
    slot = _check_of("occurred_at", step).alias("check_s")
    scope = list(SCOPE)
    beats = events.where(F.col("event_type") == HEARTBEAT)
    beats = _latest(
        beats.select("*", slot), [*scope, "check_s"], F.col("payload.status"), "event_id"
    ).withColumnRenamed("l", "__beat")
    done = _latest(
        requests.select("*", slot), [*scope, "check_s"], F.col("status"), "request_id"
    ).withColumnRenamed("l", "__done")
    points = check_points(events, step_minutes)
    order = (
        Window.partitionBy(*scope)
        .orderBy("check_s")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    key = [*scope, "check_s"]
    filled = (
        points.join(beats, key, "left")
        .join(done, key, "left")
        .withColumn("__beat", F.last("__beat", ignorenulls=True).over(order))
        .withColumn("__done", F.last("__done", ignorenulls=True).over(order))
        .withColumn("as_at", F.timestamp_seconds("check_s"))
    )
    states = filled.withColumn(
        "__heartbeat_stale",
        _stale(F.col("__beat.at"), F.col("__beat.status"), F.col("as_at"), stale_minutes),
    ).withColumn(
        "__latest_request_failed", F.coalesce(F.col("__done.status") == "failed", F.lit(False))
    )
    return _as_rules(states, [*scope, "as_at"])


def transitions(states: DataFrame) -> DataFrame:
    """Only the changes: first open, open to resolved, resolved to open."""
    order = Window.partitionBy(*SCOPE, "rule_key").orderBy("as_at")
    before = F.lag("is_open").over(order)
    changed = F.when(before.isNull(), F.col("is_open")).otherwise(before != F.col("is_open"))
    return (
        states.withColumn("__changed", changed)
        .where(F.col("__changed"))
        .select(
            *SCOPE,
            "rule_key",
            F.when(F.col("is_open"), "open").otherwise("resolved").alias("state"),
            F.col("as_at").alias("changed_at"),
        )
    )


def current_state(states: DataFrame) -> DataFrame:
    return states.groupBy(*SCOPE, "rule_key").agg(
        F.max_by("is_open", "as_at").alias("is_open"), F.max("as_at").alias("last_checked_at")
    )


def check_sources(
    events: DataFrame,
    requests: DataFrame,
    as_at: str,
    state: DataFrame | None = None,
    stale_minutes: int = 10,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One check of all scopes at ``as_at`` against the stored state.

    Returns (new state, transitions, refused). A scope checked later than ``as_at``
    before is refused and keeps its state: the clock may not go back.
    """
    if stale_minutes < 1:
        raise ValueError("stale_minutes must be at least 1")
    at = F.lit(as_at).cast("timestamp")
    scope = list(SCOPE)
    seen = events.where(F.col("occurred_at") <= at)
    beats = _latest(
        seen.where(F.col("event_type") == HEARTBEAT), scope, F.col("payload.status"), "event_id"
    ).withColumnRenamed("l", "__beat")
    done = _latest(
        requests.where(F.col("occurred_at") <= at), scope, F.col("status"), "request_id"
    ).withColumnRenamed("l", "__done")
    scopes = events.select(*scope).distinct()
    if state is not None:
        scopes = scopes.unionByName(state.select(*scope)).distinct()
    checks = _as_rules(
        scopes.join(beats, scope, "left")
        .join(done, scope, "left")
        .withColumn(
            "__heartbeat_stale",
            _stale(F.col("__beat.at"), F.col("__beat.status"), at, stale_minutes),
        )
        .withColumn(
            "__latest_request_failed", F.coalesce(F.col("__done.status") == "failed", F.lit(False))
        ),
        scope,
    )
    key = [*scope, "rule_key"]
    if state is None:
        state = checks.select(
            *key,
            F.lit(None).cast("boolean").alias("is_open"),
            F.lit(None).cast("timestamp").alias("last_checked_at"),
            F.lit(None).cast("timestamp").alias("last_changed_at"),
        ).where(F.lit(False))
    old = state.withColumnsRenamed(
        {"is_open": "__was", "last_checked_at": "__checked", "last_changed_at": "__changed"}
    )
    joined = checks.join(old, key, "left")
    refused = joined.where(F.col("__checked") > at).select(*key, "__checked")
    allowed = joined.where(F.col("__checked").isNull() | (F.col("__checked") <= at))
    flipped = F.when(F.col("__was").isNull(), F.col("is_open")).otherwise(
        F.col("__was") != F.col("is_open")
    )
    changes = allowed.where(flipped).select(
        *key,
        F.when(F.col("is_open"), "open").otherwise("resolved").alias("state"),
        at.alias("changed_at"),
    )
    moved = F.col("__was").isNull() | (F.col("__was") != F.col("is_open"))
    updated = allowed.select(
        *key,
        "is_open",
        at.alias("last_checked_at"),
        F.when(moved, at).otherwise(F.col("__changed")).alias("last_changed_at"),
    )
    kept = joined.where(F.col("__checked") > at).select(
        *key,
        F.col("__was").alias("is_open"),
        F.col("__checked").alias("last_checked_at"),
        F.col("__changed").alias("last_changed_at"),
    )
    return updated.unionByName(kept), changes, refused
