"""Tables published by a manifest: snapshot and event store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_sources import CELLS
from test_telemetry import beat, lines, request, review, uid

from adoptlens.sources import published, store
from adoptlens.streaming import ingest


def numbers(spark, low, high):
    return spark.range(low, high).select("id")


def stored(table, spark, **more):
    return sorted(r["id"] for r in table.read(spark, "t", "id long", **more).collect())


def test_readers_see_one_state(spark, tmp_path):
    table, part = published.Published(str(tmp_path)), F.col("id") % 3
    assert stored(table, spark) == [] and table.state(spark).version == 0
    first = table.publish(spark, table.state(spark).added("t", table.stage(numbers(spark, 0, 9), "t", part)))
    before = table.read(spark, "t", "id long")
    staged = table.stage(numbers(spark, 20, 23), "t", part)
    assert stored(table, spark) == list(range(9))
    table.publish(spark, table.state(spark).changed("t", {"0": staged["0"]}, drop=["1"]))
    assert stored(table, spark) == [2, 5, 8, 21]
    assert sorted(r["id"] for r in before.collect()) == list(range(9)) == stored(table, spark, state=first)
    assert stored(table, spark, parts=["0", "7"]) == [21]
    with pytest.raises(published.Conflict):
        table.publish(spark, first)
    assert stored(table, spark) == [2, 5, 8, 21]
    # the first state and the folder that only it names go; staged rows of a failed job too
    table.stage(numbers(spark, 0, 2), "t", part)
    assert table.vacuum(spark, keep=1) == 1
    assert stored(table, spark) == [2, 5, 8, 21]


def test_folders_stay_few_after_many_batches(spark, tmp_path):
    table, batches, fan = published.Published(str(tmp_path)), 30, 3
    for k in range(batches):
        state = table.state(spark)
        table.publish(spark, state.added("t", table.stage(numbers(spark, 2 * k, 2 * k + 2), "t", F.col("id") % 2)))
        table.compact(spark, "t", "id long", fan=fan, sort=("id",))
    parts = table.state(spark).tables["t"]
    sizes = {s for folders in parts.values() for s, _ in folders}
    for folders in parts.values():
        assert all(sum(s == size for s, _ in folders) < fan for size in sizes)
    # thirty batches in base three: 1010
    assert [s for s, _ in sorted(parts["0"])] == [1, 3] and stored(table, spark) == list(range(2 * batches))


def test_a_failed_refresh_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snapshot")
    old = spark.createDataFrame([(202401, "a", "g", "o", 10, 1, 5, 0.1), (202402, None, "g", "o", 10, 3, 9, 0.3)], CELLS)
    new = spark.createDataFrame([(202402, None, "g", "o", 10, 4, 9, 0.4), (202403, "a", "g", "o", 1, 1, 1, 1.0)], CELLS)
    assert store.merge_snapshot(old, path, dt.datetime(2024, 3, 1)) == 2

    def months():
        return sorted((r["year_month"], r["active_lawyers"], r["refreshed_at"].day) for r in store.read_snapshot(spark, path).collect())

    def fail(*_):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as patch:
        patch.setattr(published.Published, "publish", fail)
        with pytest.raises(RuntimeError):
            store.merge_snapshot(new, path, dt.datetime(2024, 3, 2))
    assert months() == [(202401, 1, 1), (202402, 3, 1)]
    assert store.merge_snapshot(new, path, dt.datetime(2024, 3, 3)) == 3
    assert months() == [(202402, 4, 3), (202403, 1, 3)]
    assert store.read_snapshot(spark, path, 202403).count() == 1 and store.read_snapshot(spark, path, 202401).count() == 0
    assert store.merge_snapshot(new, path, dt.datetime(2024, 3, 4)) == 0


def parts_read(df):
    return {f.split(f"{published.PART}=")[1].split("/")[0] for f in df.inputFiles()}


def bucket_of(spark, name):
    return spark.range(1).select(ingest.bucket(F.lit(name), 64)).first()[0]


def test_a_batch_reads_only_its_own_buckets(spark, tmp_path):
    kept = ingest.EventStore(str(tmp_path / "store"))
    many = [request(f"e{k}", f"r{k}") for k in range(60)]
    assert kept.ingest(lines(spark, many), 0) == "success"
    state = kept.tables.state(spark)
    batch = lines(spark, [review("v7", "r7"), request("e9", "r9")])
    events = [bucket_of(spark, uid(n)) for n in ("v7", "e9")]
    asked = [bucket_of(spark, uid(n)) for n in ("r7", "r9")]
    same_event, same_request = kept.related(batch, events, asked, state)
    assert parts_read(same_event) <= set(map(str, events)) and parts_read(same_request) == set(map(str, asked))
    assert len(state.tables["event_log"]) > 20
    plan = same_event._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not any("payload:struct" in line for line in scans)
    assert [r["event_id"] for r in same_event.collect()] == [uid("e9")]
    assert {r["event_id"] for r in same_request.collect()} == {uid("e7"), uid("e9")}


def test_a_batch_that_fails_before_its_publication_can_be_sent_again(spark, tmp_path, monkeypatch):
    kept = ingest.EventStore(str(tmp_path / "store"), buckets=4)
    assert kept.ingest(lines(spark, [beat("a")]), 0) == "success"

    def fail(*_):
        raise RuntimeError("lost driver")

    batch = [beat("b"), request("r", "r")]
    with monkeypatch.context() as patch:
        patch.setattr(published.Published, "publish", fail)
        with pytest.raises(RuntimeError):
            kept.ingest(lines(spark, batch), 1)
    assert kept.log(spark).count() == 1 and kept.ledger(spark).count() == 1
    assert kept.ingest(lines(spark, batch), 1) == "success"
    assert kept.ingest(lines(spark, batch), 1) == "success"
    assert kept.log(spark).count() == 3
    assert sorted(map(tuple, kept.ledger(spark).select("sequence", "inserted_count").collect())) == [(0, 1), (1, 2)]


def test_rejected_lines_are_kept_apart(spark, tmp_path):
    kept = ingest.EventStore(str(tmp_path / "store"), buckets=4)
    assert kept.ingest(lines(spark, ["torn line", beat("a")]), 3) == "failed"
    assert kept.log(spark).count() == 0 and kept.quarantine(spark).count() == 2


def test_conflicts_are_found_in_joined_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(published.Published.compact, "__defaults__", (2, ()))
    kept = ingest.EventStore(str(tmp_path / "store"), buckets=2)
    for k in range(5):
        assert kept.ingest(lines(spark, [beat(f"h{k}"), request(f"e{k}", f"r{k}")]), k) == "success"
    state = kept.tables.state(spark)
    assert max(s for f in state.tables["event_log"].values() for s, _ in f) >= 1
    assert all(len(f) <= 3 for f in state.tables["event_log"].values())
    assert kept.ingest(lines(spark, [beat("h0", at=9)]), 8) == "failed"
    assert kept.ingest(lines(spark, [request("other", "r1")]), 9) == "failed"
    assert kept.ingest(lines(spark, [beat("h0"), request("e1", "r1"), beat("new")]), 10) == "success"
    assert kept.log(spark).count() == 11


def test_a_batch_is_held_in_files_and_not_in_memory(spark, tmp_path, monkeypatch):
    kept, seen = ingest.EventStore(str(tmp_path / "store"), buckets=2), []
    judged = ingest.EventStore._judged

    def watched(self, batch, *rest):
        level = batch.storageLevel
        seen.append((level.useMemory, level.useDisk, len(batch.inputFiles()) > 0, batch.count()))
        return judged(self, batch, *rest)

    monkeypatch.setattr(ingest.EventStore, "_judged", watched)
    assert kept.ingest(lines(spark, [beat("a"), request("e1", "r1")]), 0) == "success"
    assert kept.ingest(lines(spark, ["torn line", beat("b")]), 1) == "failed"
    assert seen == [(False, False, True, 2)] * 2
    assert kept.log(spark).count() == 2 and kept.quarantine(spark).count() == 2
    # nothing of it stays behind, and a job that died leaves it to vacuum
    data = tmp_path / "store" / "data"
    assert not list(data.glob("held-*"))
    kept.tables.hold(spark.range(2))
    assert kept.tables.vacuum(spark) == 1 and kept.log(spark).count() == 2
