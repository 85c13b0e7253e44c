import random
import time

import numpy as np
import pytest

from adoptlens.operators import intervals as iv


def random_spans(seed, cases, most, length, key="k"):
    rng = random.Random(seed)
    out = []
    for c in range(cases):
        for _ in range(rng.randint(1, most)):
            a = rng.randint(0, length - 1)
            out.append((c, a, rng.randint(a + 1, min(length, a + 1 + length // 3))))
    return out


def positions(spans):
    out = {}
    for k, a, b in spans:
        out.setdefault(k, set()).update(range(a, b))
    return out


def frame(spark, spans):
    return spark.createDataFrame(spans, "k int, start long, end long")


@pytest.mark.parametrize("bucket", [8, 4096])
def test_union_matches_position_sets(spark, bucket):
    spans = random_spans(1, 60, 11, 50)
    merged = [tuple(r) for r in iv.interval_union(frame(spark, spans), ["k"], bucket).collect()]
    assert positions(merged) == positions(spans)
    by_key = {}
    for k, a, b in sorted(merged):
        assert all(b0 < a for _, b0 in by_key.get(k, []))
        by_key.setdefault(k, []).append((a, b))


@pytest.mark.parametrize("bucket", [8, 4096])
def test_overlap_and_difference(spark, bucket):
    left, right = random_spans(2, 60, 6, 50), random_spans(3, 60, 6, 50)
    a, b = positions(left), positions(right)
    got = {r["k"]: r["overlap"] for r in iv.interval_overlap(frame(spark, left), frame(spark, right), ["k"], bucket).collect()}
    assert got == {k: len(a[k] & b[k]) for k in a if a[k] & b.get(k, set())}
    whole = iv.interval_union(frame(spark, left), ["k"])
    gaps = [tuple(r) for r in iv.interval_difference(whole, frame(spark, right), ["k"]).collect()]
    assert positions(gaps) == {k: a[k] - b.get(k, set()) for k in a if a[k] - b.get(k, set())}
    assert sum(e - s for _, s, e in gaps) == sum(len(v) for v in positions(gaps).values())


def proposals(seed, cases=60):
    rng = random.Random(seed)
    out = []
    for c in range(cases):
        ranks = list(range(rng.randint(1, 8)))
        for r in ranks:
            a = rng.randint(0, 40)
            out.append((c, r, a, a + rng.randint(1, 20)))
    return out


@pytest.mark.parametrize("bucket", [8, 4096])
def test_budget_context_matches_a_walk(spark, bucket):
    rows = proposals(5)
    df = spark.createDataFrame(rows, "k int, rank int, start long, end long")
    budget = 17
    got = {}
    for r in iv.budget_context(df, ["k"], budget, bucket).collect():
        got.setdefault(r["k"], {}).update({p: r["rank"] for p in range(r["start"], r["end"])})
    want = {}
    for k, rank, a, b in sorted(rows):
        mine = want.setdefault(k, {})
        for p in range(a, b):
            if p not in mine and len(mine) < budget:
                mine[p] = rank
    assert got == want


def test_budget_may_be_a_column(spark):
    df = spark.createDataFrame([(0, 1, 0, 10, 4), (1, 1, 0, 10, 7)], "k int, rank int, start long, end long, n int")
    got = sorted((r["k"], r["end"], r["deferred_end"]) for r in iv.budget_context(df, ["k"], "n").collect())
    assert got == [(0, 4, 10), (1, 7, 10)]


def test_unit_context_skips_what_does_not_fit(spark):
    units = spark.createDataFrame(
        [("d", 0, 5), ("d", 5, 25), ("d", 25, 29), ("d", 29, 60)], "doc string, start long, end long"
    )
    asked = spark.createDataFrame([("c", "d", 1, 3, 27), ("c", "d", 2, 27, 40)], "case string, doc string, rank int, start long, end long")
    got = sorted((r["start"], r["end"]) for r in iv.unit_context(asked, units, ["case"], "doc", 10).collect())
    assert got == [(0, 5), (25, 29)]


def test_overlap_plan_has_no_nested_loop(spark):
    left, right = frame(spark, [(1, 0, 5)]), frame(spark, [(1, 3, 9)])
    plan = iv.interval_overlap(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def walked(proposals, units, budget):
    """[(rank, start, end)] by walking the units one after the other."""
    met = {}
    for rank, a, b in proposals:
        for s, e in units:
            if s < b and a < e and b > a:
                met[s, e] = min(rank, met.get((s, e), rank))
    left, out = budget, []
    for rank, (s, e) in sorted((r, u) for u, r in met.items()):
        if e - s <= left:
            left -= e - s
            out.append((rank, s, e))
    return sorted(out)


def test_unit_walk_equals_plain_python(spark):
    random = np.random.default_rng(5)
    asked, table, want = [], [], {}
    for case in range(12):
        cuts = np.cumsum(random.integers(1, 30, 700))
        units = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]
        spans = [(k + 1, int(a), int(a) + int(n)) for k, (a, n) in enumerate(zip(random.integers(0, cuts[-1], 90), random.integers(0, 400, 90)))]
        budget = int(random.integers(1, 4000))
        table += [(case, *u) for u in units]
        asked += [(f"q{case}", case, *p, budget) for p in spans]
        want[f"q{case}"] = walked(spans, units, budget)
    asked = spark.createDataFrame(asked, "case string, doc int, rank int, start int, end int, budget int")
    table = spark.createDataFrame(table, "doc int, start int, end int")
    got = {}
    for r in iv.unit_context(asked, table, ["case"], "doc", "budget").collect():
        got.setdefault(r["case"], []).append((r["rank"], r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_unit_walk_takes_linear_time(spark):
    def seconds(n):
        units = spark.range(n).selectExpr("1 as doc", "id * 7 as start", "id * 7 + 3 + id % 5 as end")
        asked = spark.range(n // 20).selectExpr("'q' as case", "1 as doc", "int(id) as rank", "id * 140 as start", "id * 140 + 200 as end")
        begun = time.perf_counter()
        assert iv.unit_context(asked, units, ["case"], "doc", n).count() > n // 10
        return time.perf_counter() - begun

    seconds(1000)
    assert seconds(100_000) < 25 * max(0.5, seconds(10_000))
