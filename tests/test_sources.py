import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from adoptlens.functions.events import parse_events
from adoptlens.operators import checks, scoring
from adoptlens.sources import corpus as qa
from adoptlens.sources import star, store, telemetry


def test_read_star_csv(spark, tmp_path):
    (tmp_path / "dim_tool.csv").write_text(
        'tool_id,tool_name,deployment_date,cost_per_1k_input,cost_per_1k_output,licence_cost_per_seat_month\n'
        '1,"Chat, firm",2024-01-05,0.00100,0.00200,45.00\n2,,2024-02-01,,0.1,3\n'
    )
    (tmp_path / "fact_seat_month.csv").write_text(
        "seat_month_id,lawyer_id,tool_id,date_id,seats,licence_cost_aud,used_in_month\n"
        "1,7,1,20240101,1,45.00,1\n2,8,1,20240101,1,45.00,0\nx,8,1,20240101,1,45.00,0\n"
    )
    names = {n: star.STAR_SCHEMAS[n] for n in ("dim_tool", "fact_seat_month")}
    tables = star.read_star(spark, str(tmp_path), tables=names)
    rows = tables["dim_tool"].orderBy("tool_id").collect()
    assert rows[0]["tool_name"] == "Chat, firm" and rows[0]["deployment_date"] == dt.date(2024, 1, 5)
    assert rows[1]["tool_name"] is None and rows[1]["cost_per_1k_input"] is None
    good, bad = star.quarantine(tables["fact_seat_month"])
    assert sorted((r["lawyer_id"], r["used_in_month"]) for r in good.collect()) == [(7, True), (8, False)]
    assert bad.count() == 1
    counts = {r["table"]: r["rows"] for r in checks.row_counts(tables).collect()}
    assert counts == {"dim_tool": 2, "fact_seat_month": 3}
    star.write_star({"fact_seat_month": good}, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out/fact_seat_month.parquet"))
    assert back.select("activity_month").distinct().collect()[0][0] == 202401


CELLS = "year_month int, level string, practice_group string, office string, lawyers long, active_lawyers long, sessions long, adoption_rate double"


def test_snapshot_keeps_unchanged_cells(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    first = spark.createDataFrame(
        [(202401, "a", "g", "o", 10, 1, 5, 0.1), (202401, "b", "g", "o", 4, 2, 6, 0.5), (202402, "a", "g", "o", 10, 3, 9, 0.3)], CELLS
    )
    assert store.merge_snapshot(first, path, dt.datetime(2024, 3, 1)) == 3
    assert store.merge_snapshot(first, path, dt.datetime(2024, 3, 2)) == 0
    changed = spark.createDataFrame([(202401, "a", "g", "o", 10, 2, 7, 0.2), (202401, "c", "g", "o", 1, 0, 0, None)], CELLS)
    # b left January: deleted; February is not part of this refresh
    assert store.merge_snapshot(changed, path, dt.datetime(2024, 3, 3), 202401) == 3
    got = {(r["year_month"], r["level"]): r for r in store.read_snapshot(spark, path).collect()}
    assert set(got) == {(202401, "a"), (202401, "c"), (202402, "a")}
    assert got[202401, "a"]["refreshed_at"] == dt.datetime(2024, 3, 3)
    assert got[202402, "a"]["refreshed_at"] == dt.datetime(2024, 3, 1)
    gone = changed.limit(0)
    assert store.merge_snapshot(gone, path, dt.datetime(2024, 3, 4), 202401) == 2
    assert store.read_snapshot(spark, path).count() == 1


def test_run_log_records_failures(spark, tmp_path):
    log = str(tmp_path / "log")
    assert store.run_logged(spark, log, "job", "all", lambda: 7) == 7
    with pytest.raises(RuntimeError):
        store.run_logged(spark, log, "job", "all", lambda: (_ for _ in ()).throw(RuntimeError("no disk")))
    got = sorted((r["status"], r["rows_written"], r["message"]) for r in spark.read.parquet(log).collect())
    assert got == [("Failed", 0, "no disk"), ("Success", 7, None)]


def packet(spark, run_id="r1", recall=0.5, retrieved=100, expected=4):
    run = spark.createDataFrame(
        [(run_id, "label", "development", "p", dt.datetime(2024, 1, 1), "o", "e", 100, expected)],
        "run_id string, run_label string, phase string, protocol_sha256 string, started_at timestamp, "
        "case_origin string, execution_origin string, character_budget int, expected_rows long",
    )
    configs = spark.createDataFrame([(run_id, "a", "baseline"), (run_id, "b", "candidate")], "run_id string, config_id string, config_role string")
    rows = []
    for c in ("a", "b"):
        rows.append((run_id, "q1", c, "d", "development", "cat", 1, 500, "ok", True, recall, True, False, 0.1, retrieved, 1.0))
        rows.append((run_id, "q2", c, "d", "development", "cat", 1, 500, "ok", False, None, None, None, None, 100, 1.0))
    cases = spark.createDataFrame(
        rows,
        "run_id string, case_id string, config_id string, document_id string, partition string, category string, "
        "length_quartile int, document_characters int, response_state string, is_answerable boolean, "
        "gold_character_recall double, any_gold_hit boolean, all_gold_covered boolean, context_precision double, "
        "retrieved_characters int, retrieval_latency_ms double",
    )
    return run, configs, cases


def test_packet_import_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.ingest_packet(*packet(spark), root) == 4
    assert store.ingest_packet(*packet(spark), root) == 0
    with pytest.raises(store.PacketRejected, match="conflicts"):
        store.ingest_packet(*packet(spark, recall=0.25), root)
    for bad in (packet(spark, "r2", expected=5), packet(spark, "r2", retrieved=90)):
        with pytest.raises(store.PacketRejected):
            store.ingest_packet(*bad, root)
    run, configs, cases = packet(spark, "r2", expected=3)
    with pytest.raises(store.PacketRejected):
        store.ingest_packet(run, configs, cases.where("not (case_id = 'q2' and config_id = 'b')"), root)
    summary = scoring.config_summary(store.stored_cases(spark, root)).orderBy("config_id").collect()
    assert [(r["config_id"], r["query_rows"], r["macro_gold_character_recall"]) for r in summary] == [("a", 2, 0.5), ("b", 2, 0.5)]
    back = store.stored_cases(spark, root).select(*store.CASE_FIELDS)
    keys = ["run_id", "case_id", "config_id"]
    assert checks.reconcile(packet(spark)[2], back, keys).count() == 0


def test_prediction_membership(spark):
    predictions = spark.createDataFrame(
        [("q1", "a", "d1", "ok"), ("q1", "a", "d1", "ok"), ("q9", "a", "d1", "ok"), ("q2", "z", "d2", "ok"), ("q2", "a", "d2", "error")],
        "case_id string, config_id string, document_id string, status string",
    )
    contexts = spark.createDataFrame([("q1", "a", 0, 50), ("q2", "a", 0, 1)], "case_id string, config_id string, start int, end int")
    tasks = spark.createDataFrame([("q1", "d1"), ("q2", "d9")], "case_id string, document_id string")
    configs = spark.createDataFrame([("a", 3)], "config_id string, top_k int")
    docs = spark.createDataFrame([("d1", "short"), ("d2", "t")], "document_id string, text string")
    kinds = {r["rule"] for r in checks.prediction_violations(predictions, contexts, tasks, configs, docs).collect()}
    assert kinds == {"unknown_case", "unknown_configuration", "duplicate_prediction", "wrong_document", "error_with_chunks", "invalid_offsets"}


def test_qa_corpus(spark, tmp_path):
    def doc(title, text, answers):
        return {"title": title, "paragraphs": [{"context": text, "qas": [
            {"id": f"{title}__Term", "question": "How long?", "is_impossible": not answers, "answers": answers}]}]}

    body = {"data": [doc("A", "It runs ten years.", [{"answer_start": 8, "text": "ten years"}]), doc("B", "Nothing.", [])]}
    (tmp_path / "c.json").write_text(json.dumps(body))
    documents, questions = qa.read_qa_corpus(spark, str(tmp_path / "c.json"))
    assert qa.corpus_violations(documents, questions).count() == 0
    assert scoring.gold_mismatches(questions, documents).count() == 0
    assert {r["category"] for r in questions.collect()} == {"Term"}
    full = documents.select("title", "text")
    ok = {"train": full.where("title = 'A'"), "test": full.where("title = 'B'")}
    assert qa.partition_mismatches(full, ok).count() == 0
    bad = {"train": full, "test": full.where("title = 'B'").withColumn("text", F.lit("?"))}
    assert [r["problem"] for r in qa.partition_mismatches(full, bad).collect()] == ["in_two_partitions"]
    assert qa.partition_mismatches(full, {"train": full.where("title = 'A'")}).collect()[0]["problem"] == "in_no_partition"


def test_event_files_and_export(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"schema_version":1}\nnot json\n')
    good, bad = telemetry.accepted_and_rejected(telemetry.read_events(spark, str(tmp_path / "e.jsonl")))
    assert good.count() == 0 and bad.count() == 2
    assert ["malformed"] in [r["violations"] for r in bad.collect()]
    parsed = parse_events(spark.read.text(str(tmp_path / "e.jsonl")))
    telemetry.export_views({"v": parsed.select("event_json", "payload")}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/v.csv")).count() == 2
    assert spark.read.json(str(tmp_path / "out/v.json")).count() == 2


def test_months_are_read_by_their_partitions(spark, tmp_path):
    schema = star.STAR_SCHEMAS["fact_seat_month"]
    names = [c.split()[0] for c in schema.split(", ")]
    rows = spark.range(6).select(*[F.col("id").cast("int").alias(n) if n != "date_id" else (F.col("id") % 3 * 100 + 20240101).cast("int").alias(n) for n in names])
    typed = rows.select(*[F.col(c.split()[0]).cast(c.split(maxsplit=1)[1]) for c in schema.split(", ")])
    star.write_star({"fact_seat_month": typed}, str(tmp_path))
    got = star.read_months(spark, str(tmp_path), "fact_seat_month", 202402, 202403)
    assert sorted(r["date_id"] for r in got.collect()) == [20240201, 20240201, 20240301, 20240301]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(activity_month" in plan
