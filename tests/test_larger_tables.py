"""What only shows on larger tables: ranks beyond a sketch, lines parsed once, batches in one task."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adoptlens.functions.events import parse_events, validate_events
from adoptlens.operators import bm25, chunking, ingestion, monitor, passages
from adoptlens.plans import telemetry as plans
from adoptlens.streaming import ingest, windows

SF = "/root/testdata/sf0.001"


def test_window_percentile_is_exact_beyond_a_sketch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    base = spark.range(60_000).select(
        F.timestamp_seconds(F.lit(int(start.timestamp())) + F.col("id") % 36_000).alias("started_at"),
        F.when(F.col("id") % 9 == 0, "Error").otherwise("Success").alias("status"),
        (F.col("id") % 2).cast("int").alias("tool_id"),
        (F.col("id") * 7919 % 50_021).alias("latency_ms"),
    )
    base.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    want = {
        (r["w"]["start"], r["tool_id"]): (r["n"], r["p"])
        for r in df.where("status = 'Success'").groupBy(F.window("started_at", "24 hours", "1 hour").alias("w"), "tool_id")
        .agg(F.count("*").alias("n"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p")).collect()
    }
    as_dict = lambda rows: {(r["window_start"], r["tool_id"]): (r["sessions"], r["p95_latency_ms"]) for r in rows}
    assert as_dict(windows.windowed_percentile(df, by=["tool_id"]).collect()) == want
    got = as_dict(windows.run_available(windows.windowed_percentile(stream, by=["tool_id"]), "exact").collect())
    assert got and all(want[k] == v for k, v in got.items())


def test_no_check_before_the_first_part_of_a_second(spark):
    at = dt.datetime(2024, 1, 1, 0, 0, 0, 172_425), dt.datetime(2024, 1, 1, 2)
    events = spark.createDataFrame([("a", "o", "k", t) for t in at], "source_id string, data_origin string, run_kind string, occurred_at timestamp")
    got = monitor.check_points(events, 60).select(F.timestamp_seconds("check_s").cast("string"))
    assert sorted(r[0] for r in got.collect()) == [f"2024-01-01 0{h}:00:00" for h in (1, 2, 3)]


@pytest.mark.parametrize("name", ["ingest_conflicts", "review_revisions"])
def test_lines_are_parsed_once(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan


def test_a_refused_batch_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "LINES_PER_PIECE", 20, raising=False)
    store = ingest.EventStore(str(tmp_path / "store"), buckets=8)
    events = spark.read.parquet(f"{SF}/events.parquet").limit(400)
    checked = validate_events(parse_events(plans.event_lines(events.withColumn("event_id", -1 - F.col("event_id")))))
    checked = checked.withColumn("violations", F.array(F.lit("invalid_event")))
    assert store.ingest(checked, 0) == "failed"
    assert len(store.tables.state(spark).tables["quarantine"]) == 8
    lines = {r["event_json"] for r in checked.select("event_json").collect()}
    assert {r["event_json"] for r in store.quarantine(spark).collect()} == lines
    assert store.ingest(checked, 0) == "failed" and store.quarantine(spark).count() == 400


def test_word_runs_are_compiled(spark):
    docs = spark.createDataFrame([(1, "a b  c d e f")], "document_id long, text string")
    words = F.split("text", r"\s+").alias("__words")
    runs = passages._grams(docs.select("document_id", words), 4)
    assert "lambda" not in runs._jdf.queryExecution().optimizedPlan().toString()
    asked = spark.createDataFrame([(7, "b  c d"), (8, "d e f"), (9, "c d  e"), (10, "f")], "item_id long, text string")
    got = {(r["item_id"], r["start"]) for r in passages.passage_occurrences(asked, docs).collect()}
    assert got == {(7, 2), (8, 7), (10, 11)}


def test_sentences_are_not_sorted(spark):
    docs = spark.createDataFrame([(1, "One. Two!\nThree"), (2, "")], "document_id long, text string")
    units = chunking.sentence_units(docs)
    assert "Window" not in units._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in units.collect()) == [(1, 0, 5), (1, 5, 10), (1, 10, 15)]


def test_terms_are_put_back_by_compiled_steps(spark):
    listed = spark.createDataFrame([(1, ["cats", "a", "cats", "b"]), (2, [])], "document_id long, tokens array<string>")
    term_map = spark.createDataFrame([("cats", "cat"), ("a", "a"), ("b", None)], "raw string, norm string")
    out = bm25.normalize_terms(listed, ["document_id"], term_map)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["document_id"]: r["tokens"] for r in out.collect()} == {1: ["cat", "a", "cat", "b"], 2: []}


def test_keys_in_the_usual_order_are_not_sorted_by_a_function(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 20")
    checked = validate_events(parse_events(plans.event_lines(events, faults=False)))
    assert "array_sort" not in checked._jdf.queryExecution().optimizedPlan().toString()
    turned = plans.event_lines(events, faults=False).select(F.regexp_replace("value", r'^\{("schema_version":1),(.*)\}$', r"{$2,$1}").alias("value"))
    for lines in (plans.event_lines(events, faults=False), turned):
        assert validate_events(parse_events(lines)).where("size(violations) > 0").count() == 0


def test_a_line_moves_once_into_the_event_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "LINES_PER_TASK", 10, raising=False)
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 400")
    checked = validate_events(parse_events(plans.event_lines(events, faults=False)))
    staged, stage = [], ingest.Published.stage

    def watched(self, rows, table, *args, **more):
        if table == "event_log":
            staged.append(rows._jdf.queryExecution().executedPlan().toString() if more.get("placed") else "moved later")
        return stage(self, rows, table, *args, **more)

    monkeypatch.setattr(ingest.Published, "stage", watched)
    store = ingest.EventStore(str(tmp_path / "store"), buckets=4)
    half = checked.where("conv(substr(event_id, 1, 1), 16, 10) < 8")
    for number, batch in enumerate((half, half.unionByName(checked), checked, checked.limit(300))):
        assert store.ingest(batch, number) == "success"
    # the payload is not among what moves, and a batch without a new event moves none of it
    assert len(staged) == 2 and all(plan.count("Exchange hashpartitioning") == 1 for plan in staged)
    want = {r["event_id"]: r for r in checked.select(*ingest.names_of(ingest.LOG_SCHEMA)[:-1]).collect()}
    got = store.log(spark).drop("batch").select(*ingest.names_of(ingest.LOG_SCHEMA)[:-1]).collect()
    assert len(got) == len(want) == 400 and {r["event_id"]: r for r in got} == want
    found = [r["inserted_count"] for r in store.ledger(spark).orderBy("sequence").collect()]
    assert found == [half.count(), 400 - half.count(), 0, 0]


def test_ids_that_share_a_hash_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingestion, "_pair", lambda *columns: [F.lit(1).cast("long"), F.xxhash64(*columns)])
    store = ingest.EventStore(str(tmp_path / "store"), buckets=4)
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 60")
    checked = validate_events(parse_events(plans.event_lines(events, faults=False)))
    real = ingestion.event_counts
    monkeypatch.setattr(ingest, "event_counts", lambda new, old: real(new.withColumn("event_id", F.lit("x")), old.withColumn("event_id", F.lit("x"))))
    half = checked.where("conv(substr(event_id, 1, 1), 16, 10) < 8")
    assert store.ingest(half, 0) == "success" and store.ingest(checked, 1) == "success"
    assert store.log(spark).select("event_id").distinct().count() == store.log(spark).count() == 60
