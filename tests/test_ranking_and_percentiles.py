import numpy as np
import pandas as pd
import pytest

from adoptlens.operators.percentiles import exact_percentiles
from adoptlens.operators.ranking import global_rank, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 30000
    frame = pd.DataFrame(
        {
            # one group holds most rows, and one value a third of them
            "g": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n)),
            "v": np.where(rng.random(n) < 0.33, 5.0, np.round(rng.lognormal(3, 2, n), 3)),
        }
    )
    frame.loc[:3, "g"] = "tiny"
    return frame, spark.createDataFrame(frame)


def test_linear_percentiles_match_numpy(skewed):
    frame, df = skewed
    got = exact_percentiles(df, ["g"], "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95}).collect()
    assert len(got) == frame["g"].nunique()
    for row in got:
        values = frame[frame["g"] == row["g"]]["v"]
        for name, p in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95)):
            assert row[name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_nearest_rank_and_no_keys(skewed):
    frame, df = skewed
    row = exact_percentiles(df, [], "v", {"p": 0.95}, method="nearest").collect()[0]
    ordered = np.sort(frame["v"])
    assert row["p"] == ordered[int(np.ceil(len(ordered) * 0.95)) - 1]


@pytest.mark.parametrize("method", ["linear", "nearest"])
@pytest.mark.parametrize("limit", [2000, 40, 4])
def test_rounds_narrow_to_the_exact_rank(spark, skewed, method, limit):
    frame, df = skewed
    probs = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p9999": 0.9999, "p100": 1.0}
    for row in exact_percentiles(df, ["g"], "v", probs, method, limit).collect():
        values = np.sort(frame[frame["g"] == row["g"]]["v"])
        for name, p in probs.items():
            nearest = values[max(0, int(np.ceil(len(values) * p)) - 1)]
            assert row[name] == pytest.approx(np.quantile(values, p) if method == "linear" else nearest, rel=1e-12)


def test_no_task_orders_more_than_the_limit(spark, skewed, monkeypatch):
    from adoptlens.operators import percentiles

    seen, narrowed = [], percentiles._narrowed

    def spied(values, wanted, by, group):
        out = narrowed(values, wanted, by, group)
        seen.append((values.count(), out[0].groupBy(*group, "__name").count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(percentiles, "_narrowed", spied)
    exact_percentiles(skewed[1], ["g"], "v", {"p": 0.95}, limit=100).collect()
    assert seen and seen[0][1] < 400 and seen[-1][1] <= 100


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, float(k)) for k in range(50)] + [("a", 1.0)], "g string, v double")
    for limit in (1000, 8):
        assert {tuple(r) for r in exact_percentiles(df, ["g"], "v", {"p": 0.5}, limit=limit).collect()} == {(None, 24.5), ("a", 1.0)}
    assert exact_percentiles(df.limit(0), ["g"], "v", {"p": 0.5}).count() == 0


def test_two_values_interpolate(spark):
    df = spark.createDataFrame([(100.0,), (1000.0,)], "v double")
    assert exact_percentiles(df, [], "v", {"p": 0.95}).collect()[0]["p"] == pytest.approx(955)
    assert exact_percentiles(df, [], "v", {"p": 0.05}).collect()[0]["p"] == pytest.approx(145)


def test_nulls_are_ignored(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in exact_percentiles(df, ["g"], "v", {"p": 0.5}).collect()] == [("a", 2.0)]


@pytest.mark.parametrize("descending", [True, False])
def test_global_rank_matches_pandas(spark, descending):
    rng = np.random.default_rng(3)
    n = 4000
    frame = pd.DataFrame(
        {"k": rng.permutation(n), "s": np.where(rng.random(n) < 0.4, 0.5, rng.random(n).round(2))}
    )
    got = global_rank(spark.createDataFrame(frame), "s", "k", descending=descending).toPandas()
    want = frame.sort_values(["s", "k"], ascending=[not descending, True]).reset_index(drop=True)
    want["row_number"] = want.index + 1
    want["average_rank"] = want["s"].rank(ascending=not descending)
    merged = got.merge(want, on="k", suffixes=("", "_w"))
    assert (merged["row_number"] == merged["row_number_w"]).all()
    assert (merged["average_rank"] == merged["average_rank_w"]).all()


def test_running_total(spark):
    frame = pd.DataFrame({"i": np.arange(1, 501), "v": np.arange(500) % 3})
    got = running_total(spark.createDataFrame(frame), "v", "i").toPandas().sort_values("i")
    assert (got["running"].to_numpy() == frame["v"].cumsum().to_numpy()).all()
