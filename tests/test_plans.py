"""Shapes of physical plans that must hold at scale."""

from pyspark.sql import functions as F

from adoptlens.operators import feeds, governance, scoring
from adoptlens.plans import bindings as b
from adoptlens.plans import evidence

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    text = plan(governance.review_coverage(b.enriched(spark, SF), "confidentiality_tier"))
    scan = next(line for line in text.splitlines() if "events.parquet" in line)
    schema = scan.split("ReadSchema:")[1]
    assert "ts:" not in schema and "props" not in schema and "value" not in schema
    assert "EqualTo" in scan or "IsNotNull(event_type)" in scan or "event_type" in scan


def test_feed_health_has_no_single_partition_window(spark):
    runs, live = b.line_feed(spark, SF)
    text = plan(feeds.feed_health(runs, live))
    for before, line in zip(text.splitlines(), text.splitlines()[1:]):
        assert not ("Window" in before and "SinglePartition" in line)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scoring_joins_are_equi_joins(spark):
    schema = "case_id string, config_id string, start long, end long"
    contexts = spark.createDataFrame([("c", "a", 0, 5)], schema)
    gold = spark.createDataFrame([("c", "d", 1, 3)], "case_id string, document_id string, start long, end long")
    grid = spark.createDataFrame([("c", "a", False)], "case_id string, config_id string, is_impossible boolean")
    predictions = grid.select("case_id", "config_id", F.lit("ok").alias("status"))
    text = plan(scoring.score_retrieval(grid, predictions, contexts, gold))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_passages_are_found_by_key(spark):
    docs = evidence.documents(spark, SF)
    text = plan(evidence.passage_matches(b.table(spark, SF, "benchmark"), docs))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
