import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from adoptlens.functions.calendar import calendar
from adoptlens.functions.policy import effective_review_policy, enrich_outputs
from adoptlens.operators import adoption, alerts, checks, cost, feeds, governance, metrics
from adoptlens.operators import quality, regression, screening

D = dt.date


def test_calendar(spark):
    got = {r["date"]: r for r in calendar(spark, "2024-12-29", "2025-07-01").collect()}
    assert got[D(2024, 12, 30)]["iso_year_week"] == "2025-W01"
    assert got[D(2024, 12, 29)]["is_business_day"] is False
    assert (got[D(2025, 6, 30)]["fy_year"], got[D(2025, 6, 30)]["fy_quarter"]) == (2025, 4)
    assert (got[D(2025, 7, 1)]["fy_year"], got[D(2025, 7, 1)]["fy_quarter"]) == (2026, 1)
    assert got[D(2025, 1, 5)]["day_of_week"] == 7 and got[D(2025, 1, 5)]["date_id"] == 20250105


def policy_frames(spark):
    tasks = spark.createDataFrame(
        [(1, "Mandatory", "Full"), (2, "None", "Full"), (3, "Optional", "Full")],
        "task_type_id int, review_policy_base string, review_type string",
    )
    matters = spark.createDataFrame(
        [(1, "Standard", "a", None), (2, "Restricted", "a", None), (3, "Barrier", "a", 7)],
        "matter_id int, confidentiality_tier string, practice_area string, barrier_group_id int",
    )
    outputs = spark.createDataFrame(
        [
            (1, 1, 3, False, True),
            (2, 2, 2, True, False),
            (3, 2, 3, False, False),
            (4, 3, 1, True, True),
            (5, 2, 1, False, False),
            (6, 3, 1, False, True),
        ],
        "output_id int, task_type_id int, matter_id int, is_client_facing boolean, reviewed boolean",
    )
    return outputs, tasks, matters


def test_policy_order_and_gap(spark):
    got = {r["output_id"]: (r["effective_review_policy"], r["policy_driver"]) for r in effective_review_policy(*policy_frames(spark)).collect()}
    assert got == {
        1: ("Mandatory", "Task type"),
        2: ("Mandatory", "Confidentiality tier"),
        3: ("Mandatory", "Confidentiality tier"),
        4: ("Mandatory", "Client-facing output"),
        5: ("Optional", "Not required"),
        6: ("Optional", "Not required"),
    }
    gaps = {r["output_id"] for r in enrich_outputs(*policy_frames(spark)).where("is_review_gap").collect()}
    assert gaps == {2, 3}


def cost_change(spark, sessions, seats, mark):
    s = spark.createDataFrame(sessions, "activity_date date, cost double")
    m = spark.createDataFrame(seats, "month date, licence_cost double")
    r = spark.createDataFrame([(mark,)] if mark else [], "run_date date")
    change = alerts.monthly_cost_change(s, m, r)
    values = change.select(
        F.lit(alerts.MONTHLY_COST).alias("rule_name"),
        F.col("change").alias("current_value"),
        F.lit(None).cast("long").alias("affected"),
    )
    return values


SESSIONS = [(D(2026, 4, 30), 5000.0), (D(2026, 5, 31), 10.0), (D(2026, 6, 30), 10.0), (D(2026, 7, 31), 10.0), (D(2026, 8, 29), 10.0)]
SEATS = [(D(2026, m, 1), 90.0) for m in range(4, 9)]


def verdict(spark, sessions=SESSIONS, seats=SEATS, mark=D(2026, 8, 31), limit=0.30, op=">"):
    rule = spark.createDataFrame(
        [(1, alerts.MONTHLY_COST, limit, op)], "rule_id int, rule_name string, threshold_value double, comparison string"
    )
    row = alerts.evaluate_rules(cost_change(spark, sessions, seats, mark), rule).collect()[0]
    return row["current_value"], row["is_breached"], row["affected_count"]


def seats_with(august):
    return [*SEATS[:-1], (D(2026, 8, 1), august)]


def test_cost_rule_looks_at_four_complete_months(spark):
    assert verdict(spark) == (0.0, False, 0)
    assert verdict(spark, seats=seats_with(190.0)) == (1.0, True, 1)
    partial = [(D(2026, 4, 30), 10.0), *SESSIONS[1:]]
    assert verdict(spark, partial, seats_with(9999.0), D(2026, 8, 15)) == (0.0, False, 0)


def test_cost_rule_unknown_is_null(spark):
    no_july = [s for s in SESSIONS if s[0].month != 7], [s for s in SEATS if s[0].month != 7]
    assert verdict(spark, *no_july) == (None, None, None)
    zero = [(d, 0.0 if d.month < 8 else c) for d, c in SESSIONS], [(d, 0.0 if d.month < 8 else c) for d, c in SEATS]
    assert verdict(spark, *zero) == (None, None, None)
    assert verdict(spark, mark=None) == (None, None, None)


def test_cost_rule_reads_operator_and_threshold(spark):
    seats = seats_with(120.0)
    assert verdict(spark, seats=seats) == (pytest.approx(0.3), False, 0)
    assert verdict(spark, seats=seats, op=">=") == (pytest.approx(0.3), True, 1)
    assert verdict(spark, seats=seats, limit=0.5, op=">=") == (pytest.approx(0.3), False, 0)
    assert verdict(spark, seats=seats, op="<=")[1] is False


def test_rule_without_value_stays_unknown(spark):
    rules = alerts.rule_catalogue(spark)
    assert rules.count() == 16
    values = spark.createDataFrame([("Feed loaded zero rows", 0.0, 3)], "rule_name string, current_value double, affected long")
    got = alerts.evaluate_rules(values, rules)
    assert got.where("is_breached").count() == 1 and got.where("is_breached is null").count() == 15


def test_exposure_excludes_unbillable_and_earlier_hours(spark):
    time = spark.createDataFrame(
        [
            (1, 1, D(2026, 8, 1), 90.0, True, True),
            (1, 1, D(2026, 8, 1), 90.0, False, True),
            (1, 1, D(2026, 8, 1), 900.0, True, False),
            (2, 1, D(2026, 8, 1), 90.0, True, True),
            (2, 1, D(2026, 8, 1), 90.0, False, True),
            (1, 2, D(2026, 8, 1), 90.0, True, True),
        ],
        "lawyer_id int, matter_id int, entry_date date, hours double, billable boolean, is_post_adoption boolean",
    )
    sessions = spark.createDataFrame([(1, 1, D(2026, 7, 1))], "lawyer_id int, matter_id int, activity_date date")
    matters = spark.createDataFrame(
        [(1, "Hourly", "a", "Standard"), (2, "Fixed Fee", "a", "Standard")],
        "matter_id int, fee_arrangement string, practice_area string, confidentiality_tier string",
    )
    lawyers = spark.createDataFrame(
        [(1, "l", "g", "o", 100.0), (2, "l", "g", "o", 200.0)],
        "lawyer_id int, level string, practice_group string, office string, rate double",
    )
    estimates = spark.createDataFrame(
        [("Hourly", -10.0, -12.0, -8.0), ("Fixed Fee", -10.0, -12.0, -8.0)],
        "fee_arrangement string, estimate_pct double, ci_low_pct double, ci_high_pct double",
    )
    df = cost.billable_impact(time, sessions, matters, lawyers, estimates)
    hourly = df.where("fee_arrangement = 'Hourly'").agg(
        F.sum("hourly_revenue_exposure"), F.sum("notional_capacity_released"), F.sum("post_adoption_billable_hours")
    ).collect()[0]
    assert hourly[0] == pytest.approx(3000) and hourly[1] == pytest.approx(6000) and hourly[2] == 180
    assert df.where("fee_arrangement = 'Fixed Fee' and hourly_revenue_exposure is not null").count() == 0


def test_adoption_reports_groups_without_users(spark):
    lawyers = spark.createDataFrame(
        [(1, "a", "g", "o", True), (2, "b", "g", "o", True), (3, "a", "g", "o", False)],
        "lawyer_id int, level string, practice_group string, office string, is_active boolean",
    )
    sessions = spark.createDataFrame(
        [(1, D(2024, 1, 15)), (1, D(2024, 1, 16)), (3, D(2024, 2, 2))], "lawyer_id int, activity_date date"
    )
    got = {(r["year_month"], r["level"]): r for r in adoption.adoption_by_group(sessions, lawyers).collect()}
    assert len(got) == 4
    assert got[202401, "b"]["active_lawyers"] == 0 and got[202401, "b"]["adoption_rate"] == 0
    assert got[202401, "b"]["sessions_per_active_lawyer"] is None
    # an inactive lawyer counts as user but not as population
    assert got[202402, "a"]["active_lawyers"] == 1 and got[202402, "a"]["lawyers"] == 1
    assert got[202401, "a"]["month_start"] == D(2024, 1, 15)


def test_retention_is_one_week_and_incomplete_is_null(spark):
    activity = spark.createDataFrame(
        [(1, D(2024, 1, 3)), (1, D(2024, 1, 29)), (2, D(2024, 1, 2)), (2, D(2024, 2, 5)), (3, D(2024, 1, 10))],
        "actor int, activity_date date",
    )
    got = {r["week_start"]: r for r in adoption.retention_cohort(activity).collect()}
    first, late = got[D(2024, 1, 1)], got[D(2024, 1, 8)]
    assert (first["cohort_lawyers"], first["retained_lawyers"], first["is_complete"]) == (2, 1, True)
    assert late["retained_lawyers"] is None and late["retention"] is None and late["is_complete"] is False


def test_rolling_reach_counts_84_days(spark):
    lawyers = spark.createDataFrame([(1, True), (2, True)], "lawyer_id int, is_active boolean")
    sessions = spark.createDataFrame(
        [(1, D(2024, 1, 1)), (1, D(2024, 1, 20)), (2, D(2024, 4, 12))], "lawyer_id int, activity_date date"
    )
    got = {r["date"]: r["active_lawyers"] for r in adoption.rolling_reach(sessions, lawyers).collect()}
    assert got[D(2024, 4, 11)] == 1 and got[D(2024, 4, 12)] == 2 and got[D(2024, 1, 1)] == 1


def test_feed_health(spark):
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    loads = [("s", d) for i, d in enumerate(days) for _ in range(0 if i == 36 else 25)]
    loads = spark.createDataFrame(loads, "source string, run_date date")
    rejects = spark.createDataFrame([("s", days[3])] * 5, "source string, run_date date")
    spans = spark.createDataFrame([("s", days[0], days[-1])], "source string, first_day date, last_day date")
    live = spark.createDataFrame([("s", days[1])], "source string, live_from date")
    runs = feeds.feed_runs(loads, rejects, spans)
    got = {r["run_date"]: r for r in feeds.feed_health(runs, live).collect()}
    assert len(got) == 40 and got[days[3]]["run_status"] == "Warning" and got[days[3]]["rows_loaded"] == 20
    gap = got[days[36]]
    assert gap["rows_loaded"] == 0 and gap["is_unexpected_zero_load"] and gap["last_good_run"] == days[35]
    assert gap["hours_since_good_run"] == 96 and gap["trailing_mean"] == pytest.approx((29 * 25 + 25) / 30)
    assert got[days[0]]["trailing_mean"] is None and got[days[0]]["is_expected_active"] is False


def test_barrier_crossing_leaves_the_window(spark):
    matters = spark.createDataFrame([(1, 10), (2, 20)], "matter_id int, barrier_group_id int")
    sessions = spark.createDataFrame(
        [(1, 1, D(2024, 1, 1)), (1, 2, D(2024, 3, 30)), (2, 1, D(2024, 1, 1)), (2, 2, D(2024, 3, 31))],
        "lawyer_id int, matter_id int, activity_date date",
    )
    got = [r["lawyer_id"] for r in governance.barrier_rolling(sessions, matters, 90).collect()]
    assert got == [1]


def effect_frame(seed=0):
    rng = np.random.default_rng(seed)
    n = 6000
    group = rng.choice(["x", "y", "z"], n)
    cell = np.char.add(np.char.add(group, "/"), rng.choice(["1", "2", "3"], n))
    arm = (rng.random(n) < 0.4).astype(int)
    cluster = rng.integers(0, 80, n)
    effect = pd.Series(group).map({"x": -0.1, "y": -0.2, "z": 0.0}).to_numpy()
    y = np.exp(1 + pd.factorize(cell)[0] * 0.1 + arm * effect + rng.normal(0, 0.5, n) + (cluster % 7) * 0.02)
    return pd.DataFrame({"y": y, "arm": arm, "grp": group, "cell": cell, "cluster": cluster})


def test_effect_equals_full_least_squares(spark):
    frame = effect_frame()
    names = {"y": "y", "group": "grp", "cell": "cell", "cluster": "cluster"}
    df = spark.createDataFrame(frame)
    got = regression.fe_effect(df, **names).orderBy("grp").collect()
    groups = sorted(frame["grp"].unique())
    cells = pd.get_dummies(frame["cell"], dtype=float).to_numpy()
    treat = np.column_stack([((frame["grp"] == g) & (frame["arm"] == 1)).astype(float) for g in groups])
    x, y = np.hstack([cells, treat]), np.log(frame["y"].to_numpy())
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    resid = y - x @ beta
    g = frame["cluster"].nunique()
    s = np.zeros((g, x.shape[1]))
    np.add.at(s, pd.factorize(frame["cluster"])[0], x * resid[:, None])
    inv = np.linalg.pinv(x.T @ x)
    v = inv @ (s.T @ s) @ inv * (g / (g - 1)) * ((len(y) - 1) / (len(y) - x.shape[1]))
    k = len(groups)
    for i, row in enumerate(got):
        b, se = beta[-k + i], np.sqrt(v[-k + i, -k + i])
        assert row["estimate_pct"] == pytest.approx((np.exp(b) - 1) * 100, rel=1e-8)
        assert row["se_pct"] == pytest.approx(se * 100, rel=1e-8)
        assert row["ci_high_pct"] == pytest.approx((np.exp(b + 1.96 * se) - 1) * 100, rel=1e-7)
    pairs = regression.pairwise_contrasts(df, **names).collect()
    assert len(pairs) == 3
    row = next(r for r in pairs if (r["group_a"], r["group_b"]) == ("x", "y"))
    assert row["difference_pct"] == pytest.approx((np.exp(beta[-3] - beta[-2]) - 1) * 100, rel=1e-8)
    var = v[-3, -3] + v[-2, -2] - 2 * v[-3, -2]
    assert row["ci_low_pct"] == pytest.approx((np.exp(beta[-3] - beta[-2] - 1.96 * np.sqrt(var)) - 1) * 100, rel=1e-7)


def test_effect_refuses_a_cell_in_two_groups(spark):
    frame = effect_frame()
    frame["cell"] = "same"
    with pytest.raises(Exception, match="more than one group"):
        regression.fe_effect(spark.createDataFrame(frame), y="y", group="grp", cell="cell", cluster="cluster").collect()


def test_arms(spark):
    time = spark.createDataFrame(
        [(1, 3, True), (1, None, False), (2, None, False), (3, 5, False)],
        "lawyer_id int, ai_sessions int, is_post_adoption boolean",
    )
    sessions = spark.createDataFrame([(1,)] * 20 + [(3,)] * 5, "lawyer_id int")
    got = sorted((r["lawyer_id"], r["arm"]) for r in regression.assign_arms(time, sessions).collect())
    assert got == [(1, -1), (1, 1), (2, 0), (3, -1)]
    mixed = sorted((r["lawyer_id"], r["arm"]) for r in regression.assign_contaminated_arms(time).collect())
    assert mixed == [(1, 0), (1, 1), (2, 0), (3, -1)]


def test_screens(spark):
    features = spark.createDataFrame(
        [(i, 30, i / 10, 10, 10 - i, (10 - i) / 10) for i in range(10)],
        "lawyer_id long, mandatory_outputs long, completion double, sessions long, sensitive_count long, sensitive_rate double",
    )
    labels = spark.createDataFrame([(0,), (2,)], "lawyer_id long")
    cohort = spark.createDataFrame([(0,), (2,), (99,)], "lawyer_id long")
    got = {
        (r["screen"], r["list_size"]): r
        for r in screening.evaluate_screens(screening.score_screens(features), labels, cohort, [1, 3]).collect()
    }
    row = got["completion", 3]
    assert (row["true_positives"], row["recall_of_screenable"]) == (2, 1.0)
    assert row["recall_of_cohort"] == pytest.approx(2 / 3)
    assert row["average_precision"] == pytest.approx((1 + 2 / 3) / 2)


def test_quartiles_cut_at_values(spark):
    enriched = spark.createDataFrame(
        [(i, "Mandatory", j < i) for i in range(1, 5) for j in range(4)],
        "lawyer_id int, effective_review_policy string, reviewed boolean",
    )
    incidents = spark.createDataFrame([(1,), (1,), (4,)], "lawyer_id int")
    got = {r["quartile"]: r for r in quality.incidents_by_coverage_quartile(enriched, incidents).collect()}
    assert {q: r["incidents_per_lawyer"] for q, r in got.items()} == {1: 2.0, 2: 0.0, 3: 0.0, 4: 1.0}
    frame = quality.incidents_by_coverage_quartile(enriched, incidents)
    assert quality.worst_to_best_ratio(frame).collect()[0][0] == 2.0


def test_metrics_are_ratios_of_sums(spark):
    known = metrics.catalogue()
    outputs = spark.createDataFrame(
        [("a", True), ("a", False), ("a", False), ("b", True)], "tool string, accepted boolean"
    ).withColumn("edit_distance_pct", F.lit(10))
    sessions = spark.createDataFrame([("a", 1, 3.0), ("b", 1, 5.0)], "tool string, lawyer_id int, cost double")
    seats = spark.createDataFrame([("a", 7.0, True), ("c", 2.0, False)], "tool string, licence_cost double, used_in_month boolean")
    lawyers = spark.createDataFrame([(1, True), (2, True), (3, False)], "lawyer_id int, is_active boolean")
    facts = {"outputs": outputs, "sessions": sessions, "seats": seats, "lawyers": lawyers}
    names = ["total_cost", "cost_per_accepted_output", "adoption_rate", "acceptance_rate"]
    by_tool = {r["tool"]: r for r in metrics.evaluate([known[n] for n in names], facts, ["tool"]).collect()}
    assert by_tool["a"]["cost_per_accepted_output"] == 10.0 and by_tool["c"]["total_cost"] == 2.0
    assert by_tool["c"]["cost_per_accepted_output"] is None and by_tool["a"]["adoption_rate"] == 0.5
    whole = metrics.evaluate([known[n] for n in names], facts).collect()[0]
    assert whole["cost_per_accepted_output"] == 17.0 / 2 and whole["acceptance_rate"] == 0.5


def test_month_gap_has_no_change(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 1.0), (D(2024, 2, 1), 3.0), (D(2024, 4, 1), 9.0)], "month date, v double")
    got = {r["month"].month: r["change"] for r in metrics.month_over_month(df, "v").collect()}
    assert got == {1: None, 2: 2.0, 4: None}


def test_lookup_needs_one_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="more than one value"):
        metrics.one_per_key(df, "k").collect()


def test_row_rules_and_reconcile(spark):
    matters = spark.createDataFrame(
        [(1, "Barrier", "Hourly", None), (2, "Secret", "Hourly", None), (3, "Standard", "Capped", 4)],
        "matter_id int, confidentiality_tier string, fee_arrangement string, barrier_group_id int",
    )
    got = sorted(tuple(r) for r in checks.row_violations(matters, checks.matter_rules(), ["matter_id"]).collect())
    assert got == [(1, "barrier_group_iff_barrier"), (2, "tier_domain"), (3, "barrier_group_iff_barrier")]
    left = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, None), (3, 1.0, "x")], "k int, v double, s string")
    right = spark.createDataFrame([(1, 1.0 + 1e-12, "a"), (2, 2.1, None), (4, 1.0, "x")], "k int, v double, s string")
    diff = sorted((r["k"], r["field"]) for r in checks.reconcile(left, right, ["k"]).collect())
    assert diff == [(2, "v"), (3, "(row)"), (4, "(row)")]


def test_control_sensitivity_fits_both_controls(spark):
    frame = effect_frame().rename(columns={"y": "hours", "grp": "fee_arrangement", "cluster": "lawyer_id"})
    heavy = frame["lawyer_id"] < 40
    frame["is_post_adoption"] = (frame["arm"] == 1) & heavy
    frame["ai_sessions"] = np.where(frame["is_post_adoption"], 3.0, np.nan)
    time = spark.createDataFrame(frame.drop(columns="arm")).withColumn("ai_sessions", F.nanvl("ai_sessions", F.lit(None)))
    sessions = spark.createDataFrame([(i,) for i in range(40) for _ in range(25)], "lawyer_id long")
    got = regression.control_sensitivity(time, sessions).collect()
    assert len(got) == 6
    size = {(r["control"], r["fee_arrangement"]): (r["treated_entries"], r["control_entries"]) for r in got}
    for g in "xyz":
        mine = frame[frame["fee_arrangement"] == g]
        treated = int(mine["is_post_adoption"].sum())
        assert size["never adopted", g] == (treated, int((mine["lawyer_id"] >= 40).sum()))
        assert size["same lawyers", g] == (treated, len(mine) - treated)


def test_freed_capacity(spark):
    capacity = spark.createDataFrame([(True, 10.0, 6.0), (True, 10.0, 8.0), (False, 5.0, 0.0)], "r boolean, freed double, returned double")
    got = {r["r"]: r["returned_share"] for r in quality.freed_capacity_summary(capacity, "r").collect()}
    assert got == {True: 0.7, False: 0.0}
