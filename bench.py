"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from adoptlens.plans import registry
from adoptlens.session import build_session, scratch

HEADLINE = [
    "review_coverage_by_tier",
    "adoption_by_group_month",
    "week4_retention_cohorts",
    "quality_panel",
    "cost_efficiency",
    "governance_screen",
    "feed_health",
    "alert_status",
    "rolling_12w_adoption",
    "fe_effect",
    "screen_evaluation",
    "interval_union",
    "chunk_documents",
    "bm25_top3",
    "budget_context_scores",
    "stratified_selection",
    "triage_markers",
    "config_comparison",
    "source_monitor",
    "stream_windowed_error_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        with scratch(spark):
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
