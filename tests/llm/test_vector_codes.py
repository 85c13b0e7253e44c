"""Product codes of vectors by ball k-means."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adoptlens.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code int, sums int, error string, __label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, label, "v", 1, 2, "e", 3) for i, e, label in rows], SCHEMA)


def brute(rows, parts=vc.PARTS, entries=vc.ENTRIES, rounds=vc.ROUNDS):
    """Lloyd's rounds in Python integers: rows (vec_id, label, code, error) and the codebooks."""
    kept = [
        (i, [math.floor(np.float64(np.float32(x)) * 4096) for x in e], label)
        for i, e, label in rows
        if e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    by = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, len(r[1])))
    length = next((len(r[1]) for r in by if r[1] and len(r[1]) % parts == 0), 0)
    most = vc.largest_component(length) if length else 0
    good = [r for r in kept if length and len(r[1]) == length and all(abs(x) <= most for x in r[1])]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = length // parts
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def nearest(p, v):
        x = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(books[p]))

    for _ in range(rounds):
        members = [[[] for _ in first] for _ in range(parts)]
        for _, v, _ in good:
            for p in range(parts):
                members[p][nearest(p, v)[1]].append(v[p * width : (p + 1) * width])
        for p in range(parts):
            for j, m in enumerate(members[p]):
                if m:
                    books[p][j] = [sum(x) // len(m) for x in zip(*m)]
    out = [(i, label, None, None) for i, v, label in kept if not any(v is g[1] for g in good)]
    for i, v, label in good:
        found = [nearest(p, v) for p in range(parts)]
        out.append((i, label, bytes(j for _, j in found), sum(d for d, _ in found)))
    return sorted(out, key=repr), books


def check(spark, rows, **more):
    found = vc.vector_codes(frame(spark, rows).repartition(3), **more)
    got = sorted(((r[0], r[1], r[2] and bytes(r[2]), r[3]) for r in found.rows.collect()), key=repr)
    want, books = brute(rows, **more)
    assert got == want
    assert found.codebooks.tolist() == books or not found.codebooks.size
    return found


def vectors(n, length=16, seed=1, spread=1.0):
    random = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in random.normal(0, spread, length)] for _ in range(n)]


def test_codes_of_odd_rows(spark):
    base = vectors(40)
    rows = [(k, e, k % 3 if k % 4 else None) for k, e in enumerate(base)]
    rows += [(100, None, 1), (101, [None] * 16, 1), (102, [*base[0][:15], math.nan], 1), (103, [*base[0][:15], -math.inf], 1)]
    rows += [(104, [], 1), (105, base[0][:8], 1), (106, base[0][:7], None), (107, [9e4] * 16, 2), (108, [1e38] * 16, 2)]
    rows += [(None, base[1], 5), (None, base[2], 5), (3, base[4], 6), (3, base[4], 6), (-7, base[9], 6)]
    found = check(spark, rows)
    summed = vc.with_label_error(found.rows)
    by = {}
    for r in found.rows.collect():
        by.setdefault(r["label"], []).append(r["error"])
    assert summed.count() == len(rows) - 4
    for r in summed.collect():
        assert r["label_error"] == (sum(e for e in by[r["label"]] if e is not None) if any(e is not None for e in by[r["label"]]) else None)


def test_ties_go_to_the_lower_index_and_unused_entries_stay(spark):
    same = [[0.25] * 8] * 20  # sixteen equal entries, one is used
    check(spark, list(zip(range(20), same, [None] * 20)))
    grid = [[(k // 3**j % 3 - 1) / 4096 for j in range(8)] for k in range(81)]
    check(spark, list(zip(range(81), grid, [0] * 81)))


def test_many_rounds_with_entries_that_stand_still(spark):
    clusters = [[c + x / 64 for x in e] for c in (-3, 0, 3, 9) for e in vectors(30, 8, seed=c + 5)]
    check(spark, list(zip(range(120), clusters, [1] * 120)), rounds=9, entries=7)


def test_few_rows_and_none(spark):
    check(spark, list(zip(range(5), vectors(5), [0] * 5)))
    assert check(spark, []).rows.columns == ["vec_id", "label", "code", "error"]
    found = check(spark, [(1, [], 0), (2, [1.0], 0), (3, None, 0)])
    assert vc.with_label_error(found.rows).count() == 2


def test_long_vectors_and_doubles(spark):
    rows = [(k, e, 0) for k, e in enumerate(vectors(20, 1024))]
    df = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    got = sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in vc.vector_codes(df).rows.collect()), key=repr)
    assert got == brute(rows)[0]


def test_codes_decode_to_near_vectors(spark):
    rows = [(k, e, 0) for k, e in enumerate(vectors(64, 8, spread=0.1))]
    found = vc.vector_codes(frame(spark, rows), parts=2, entries=32)
    near = found.rows.select("vec_id", "error", vc.decode(F.col("code"), found.codebooks).alias("x")).collect()
    for r in near:
        exact = [math.floor(x * 4096) for x in rows[r["vec_id"]][1]]
        assert sum((a - round(4096 * b)) ** 2 for a, b in zip(exact, r["x"])) == r["error"]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 12), st.integers(1, 60), st.booleans())
def test_assign_agrees_with_every_distance(seed, width, entries, n, again):
    random = np.random.default_rng(seed)
    x, c = random.integers(-4, 5, (n, width)), random.integers(-4, 5, (entries, width))
    own, moved = random.integers(0, entries, n), np.ones(entries, bool)
    if again:  # the nearest before some entries moved
        own = vc.squared(x[:, None] - c[None]).argmin(axis=1)
        moved = random.random(entries) < 0.4
        c = np.where(moved[:, None], random.integers(-4, 5, c.shape), c)
    codes, least = vc.assign(x, c, own, moved)
    every = vc.squared(x[:, None] - c[None])
    assert codes.tolist() == every.argmin(axis=1).tolist() and least.tolist() == every.min(axis=1).tolist()


def test_far_balls_are_not_compared(monkeypatch):
    random = np.random.default_rng(3)
    c = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    own = random.integers(0, 4, 4000)
    x = c[own] + random.integers(-20, 21, (4000, 2))
    compared, plain = [], vc.squared
    monkeypatch.setattr(vc, "squared", lambda d: compared.append(d.size) or plain(d))
    vc.assign(x, c, own, np.ones(4, bool))
    assert compared == [4 * 4 * 2, 4000 * 2]  # entries, and every part with its own entry


@pytest.mark.parametrize("length", [8, 64, 1024])
def test_largest_component_is_safe(length):
    most = vc.largest_component(length)
    assert 4 * length * (2 * most) ** 2 < 2**63 and most < 2**31 - 1
