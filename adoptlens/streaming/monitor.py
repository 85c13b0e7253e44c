"""Stateful monitoring of sources: a row only when a rule opens or resolves.

Events shrink to one row per source and check interval in a windowed aggregation
(combined on the map side), and only those rows reach the keyed state, so a source
with a third of all events does not flood one task.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.events import HEARTBEAT, REQUEST
from ..operators.monitor import SCOPE

OUTPUT = (
    "source_id string, data_origin string, run_kind string, rule_key string, state string, "
    "changed_at timestamp"
)
STATE = (
    "beat_us bigint, beat_failed boolean, request_failed boolean, stale_open int, "
    "failed_open int, checked_us bigint"
)
MICRO = 1_000_000
UNKNOWN = -1


def checks_per_interval(events: DataFrame, step_minutes: int, delay: str = "1 hour") -> DataFrame:
    """Latest heartbeat and request per source and check interval of a stream.

    An interval includes its end, so that an event at the check time counts.
    """
    timed = events.withColumn("event_time", F.col("occurred_at") - F.expr("interval 1 microsecond"))
    beat = F.col("event_type") == HEARTBEAT
    done = F.col("event_type") == REQUEST
    order = F.struct("occurred_at", "event_id")
    return (
        timed.withWatermark("event_time", delay)
        .groupBy(*SCOPE, F.window("event_time", f"{step_minutes} minutes"))
        .agg(
            F.max(F.when(beat, F.unix_micros("occurred_at"))).alias("beat_us"),
            F.max_by(
                F.when(beat, F.col("payload.status") == "failed"), F.when(beat, order)
            ).alias("beat_failed"),
            F.max_by(
                F.when(done, F.col("payload.status") == "failed"), F.when(done, order)
            ).alias("request_failed"),
        )
        .select(
            *SCOPE,
            F.col("window.end").alias("check_time"),
            "beat_us",
            "beat_failed",
            "request_failed",
        )
    )


class SourceMonitor(StatefulProcessor):
    """Keeps the last heartbeat, the last request and both rule states of one source."""

    def __init__(self, step_minutes: int, stale_minutes: int):
        self.step = step_minutes * 60 * MICRO
        self.stale = stale_minutes * 60 * MICRO

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows, timerValues):
        beat, beat_failed, request_failed, stale_open, failed_open, checked = self._load()
        out = []
        frame = pd.concat(list(rows), ignore_index=True).sort_values("check_time")
        for row in frame.itertuples():
            at = row.check_time.value // 1000
            if checked is not None and at <= checked:
                continue
            # no event in between: at most one change, from fresh to stale
            silent = self._first_stale(beat, checked)
            if silent is not None and silent < at and stale_open != 1:
                out.append((*key, "heartbeat_stale", "open", silent))
                stale_open = 1
            if not pd.isna(row.beat_us):
                beat, beat_failed = int(row.beat_us), bool(row.beat_failed)
            if not pd.isna(row.request_failed):
                request_failed = bool(row.request_failed)
            is_stale = beat is None or beat < at - self.stale or beat_failed
            for rule, was, now in (
                ("heartbeat_stale", stale_open, int(is_stale)),
                ("latest_request_failed", failed_open, int(bool(request_failed))),
            ):
                if now != max(was, 0):
                    out.append((*key, rule, "open" if now else "resolved", at))
            stale_open, failed_open, checked = int(is_stale), int(bool(request_failed)), at
        self.state.update(
            (beat, beat_failed, request_failed, stale_open, failed_open, checked)
        )
        self._set_timer(beat, checked, stale_open)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        beat, beat_failed, request_failed, stale_open, failed_open, checked = self._load()
        silent = self._first_stale(beat, checked)
        if silent is not None and stale_open != 1:
            self.state.update((beat, beat_failed, request_failed, 1, failed_open, silent))
            yield _frame([(*key, "heartbeat_stale", "open", silent)])

    def close(self) -> None:
        pass

    def _load(self):
        if self.state.exists():
            return tuple(self.state.get())
        return None, False, False, UNKNOWN, UNKNOWN, None

    def _first_stale(self, beat, checked):
        """First check after the last one at which a silent source is stale."""
        if beat is None or checked is None:
            return None
        first = -(-(beat + self.stale + 1) // self.step) * self.step
        return max(first, checked + self.step)

    def _set_timer(self, beat, checked, stale_open):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        silent = self._first_stale(beat, checked)
        if silent is not None and stale_open != 1:
            self.handle.registerTimer(silent // 1000)


def _frame(rows) -> pd.DataFrame:
    names = [*SCOPE, "rule_key", "state", "changed_at"]
    frame = pd.DataFrame(rows, columns=names)
    epoch = dt.datetime(1970, 1, 1)
    frame["changed_at"] = [epoch + dt.timedelta(microseconds=int(v)) for v in frame["changed_at"]]
    return frame


def monitor_stream(
    events: DataFrame, step_minutes: int, stale_minutes: int = 10, delay: str = "1 hour"
) -> DataFrame:
    """Transitions of both rules for every source. Needs the RocksDB state store
    (``use_rocksdb``). A request counts with its latest completion by event time."""
    checks = checks_per_interval(events, step_minutes, delay)
    return checks.groupBy(*SCOPE).transformWithStateInPandas(
        statefulProcessor=SourceMonitor(step_minutes, stale_minutes),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )


def use_rocksdb(spark) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
