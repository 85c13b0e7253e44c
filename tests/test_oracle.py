"""Registered queries against the same query in SQL. A quick choice by default; every
query with ADOPTLENS_ALL=1 (several minutes)."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

from adoptlens.plans import registry

SF = os.environ.get("ADOPTLENS_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUICK = [
    "review_coverage_by_tier",
    "adoption_by_group_month",
    "week4_retention_cohorts",
    "quality_panel",
    "governance_screen",
    "feed_health",
    "fe_effect",
    "interval_union",
    "stratified_selection",
    "bm25_top3",
    "config_comparison",
    "source_monitor",
    "stream_windowed_error_rate",
]
CHOSEN = sorted(registry.oracles()) if os.environ.get("ADOPTLENS_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cursor = duck.execute(registry.oracles()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(columns, cursor.fetchall())


def test_registry_is_consistent():
    assert set(registry.oracles()) <= set(registry.queries())
    assert not any(n.startswith("op") and n[2:3].isdigit() for n in registry.queries())
