"""Registered queries over the operations star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import calendar_of
from ..functions.exprs import count_where, year_month
from ..functions.policy import effective_review_policy
from ..operators import adoption, alerts, checks, cost, expectations, expected, feeds, governance, metrics
from ..operators import quality, regression, screening
from . import bindings as b
from .bindings import (
    EFFECT_SQL,
    ENRICHED_SQL,
    ESTIMATES_SQL,
    INCIDENTS_SQL,
    LAWYERS_SQL,
    LINE_FEED_SQL,
    MATTERS_SQL,
    OUTPUTS_SQL,
    SEATS_SQL,
    SESSIONS_SQL,
    STAR_SQL,
    TASKS_SQL,
    TIME_SQL,
    TOOLS_SQL,
    rounded,
    six,
    with_sql,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


POLICY_SQL = with_sql(
    SESSIONS_SQL, OUTPUTS_SQL, MATTERS_SQL, TASKS_SQL, TOOLS_SQL, ENRICHED_SQL
)


@query(
    POLICY_SQL
    + """SELECT confidentiality_tier, count(*) AS mandatory_outputs,
  count(*) FILTER (WHERE reviewed) AS mandatory_reviewed,
  round(count(*) FILTER (WHERE reviewed) / count(*), 6) AS review_coverage
FROM enriched WHERE mandatory GROUP BY 1"""
)
def review_coverage_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        governance.review_coverage(b.enriched(spark, d), "confidentiality_tier"), "review_coverage"
    )


@query(
    POLICY_SQL
    + """SELECT driver AS policy_driver,
  CASE WHEN mandatory THEN 'Mandatory' ELSE 'Optional' END AS effective_review_policy, count(*) AS outputs
FROM enriched GROUP BY 1, 2"""
)
def effective_policy_drivers(spark: SparkSession, d: str) -> DataFrame:
    policy = effective_review_policy(b.outputs(spark, d), b.tasks(spark, d), b.matters(spark, d))
    return policy.groupBy("policy_driver", "effective_review_policy").agg(
        F.count(F.lit(1)).alias("outputs")
    )


@query(
    """WITH days AS (
  SELECT CAST(unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE),
    INTERVAL 1 DAY)) AS DATE) AS date FROM orders)
SELECT date, CAST(strftime(date, '%Y%m%d') AS INT) AS date_id, CAST(year(date) AS INT) AS year,
  CAST(quarter(date) AS INT) AS quarter, CAST(month(date) AS INT) AS month,
  strftime(date, '%b') AS month_name, CAST(year(date) * 100 + month(date) AS INT) AS year_month,
  concat(isoyear(date), '-W', lpad(CAST(week(date) AS VARCHAR), 2, '0')) AS iso_year_week,
  CAST(isodow(date) AS INT) AS day_of_week, isodow(date) <= 5 AS is_business_day,
  CAST(year(date) + CASE WHEN month(date) >= 7 THEN 1 ELSE 0 END AS INT) AS fy_year,
  CAST(((month(date) + 5) % 12) // 3 + 1 AS INT) AS fy_quarter
FROM days"""
)
def order_calendar(spark: SparkSession, d: str) -> DataFrame:
    days = b.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return calendar_of(days, "day")


@query(
    with_sql(SESSIONS_SQL, LAWYERS_SQL)
    + """, bounds AS (SELECT min(activity_date) AS a, max(activity_date) AS z FROM sessions),
months AS (SELECT greatest(CAST(m AS DATE), a) AS month_start FROM (
  SELECT a, unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH)) AS m
  FROM bounds)),
population AS (SELECT level, practice_group, office, count(*) AS lawyers FROM lawyers WHERE is_active
  GROUP BY 1, 2, 3),
active AS (SELECT year(activity_date) * 100 + month(activity_date) AS year_month, level, practice_group, office,
  count(DISTINCT lawyer_id) AS active_lawyers, count(*) AS sessions
  FROM sessions JOIN lawyers USING (lawyer_id) GROUP BY 1, 2, 3, 4)
SELECT CAST(year(m.month_start) * 100 + month(m.month_start) AS INT) AS year_month, m.month_start,
  p.level, p.practice_group, p.office, p.lawyers, coalesce(a.active_lawyers, 0) AS active_lawyers,
  coalesce(a.sessions, 0) AS sessions, round(coalesce(a.active_lawyers, 0) / p.lawyers, 6) AS adoption_rate,
  round(coalesce(a.sessions, 0) / nullif(a.active_lawyers, 0), 6) AS sessions_per_active_lawyer
FROM months m CROSS JOIN population p LEFT JOIN active a
  ON a.year_month = year(m.month_start) * 100 + month(m.month_start) AND a.level = p.level
  AND a.practice_group = p.practice_group AND a.office = p.office"""
)
def adoption_by_group_month(spark: SparkSession, d: str) -> DataFrame:
    df = adoption.adoption_by_group(b.sessions(spark, d), b.lawyers(spark, d))
    return rounded(df, "adoption_rate", "sessions_per_active_lawyer")


RETENTION_SQL = """WITH act AS (SELECT DISTINCT o_custkey AS actor, CAST(o_orderdate AS DATE) AS day FROM orders),
first AS (SELECT actor, min(day) AS f, CAST(date_trunc('week', min(day)) AS DATE) AS ws FROM act GROUP BY 1),
back AS (SELECT first.actor, f, ws, max(CASE WHEN day >= ws + 28 AND day < ws + 35 THEN 1 ELSE 0 END) AS r
  FROM first JOIN act USING (actor) GROUP BY 1, 2, 3),
cohorts AS (
  SELECT concat(isoyear(f), '-W', lpad(CAST(week(f) AS VARCHAR), 2, '0')) AS cohort_week, ws AS week_start,
    c_mktsegment AS level, count(*) AS cohort_lawyers, CAST(sum(r) AS BIGINT) AS r,
    ws + 34 <= (SELECT max(day) FROM act) AS is_complete
  FROM back JOIN customer ON c_custkey = actor GROUP BY 1, 2, 3, 6)
"""


@query(
    RETENTION_SQL
    + """SELECT cohort_week, week_start, level, cohort_lawyers, is_complete,
  CASE WHEN is_complete THEN r END AS retained_lawyers,
  CASE WHEN is_complete THEN round(r / cohort_lawyers, 6) END AS retention FROM cohorts"""
)
def week4_retention_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_cohorts(spark, d), "retention")


def _cohorts(spark: SparkSession, d: str) -> DataFrame:
    activity = b.table(spark, d, "orders").select(
        F.col("o_custkey").alias("actor"), F.col("o_orderdate").cast("date").alias("activity_date")
    )
    actors = b.table(spark, d, "customer").select(
        F.col("c_custkey").alias("actor"), F.col("c_mktsegment").alias("level")
    )
    return adoption.retention_cohort(activity, actors, by=["level"])


@query(
    RETENTION_SQL
    + """SELECT level, CAST(sum(cohort_lawyers) AS BIGINT) AS cohort_lawyers,
  CAST(sum(r) AS BIGINT) AS retained_lawyers, round(sum(r) / sum(cohort_lawyers), 6) AS retention
FROM cohorts WHERE is_complete GROUP BY 1"""
)
def week4_retention_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(adoption.retention_rate(_cohorts(spark, d), ["level"]), "retention")


@query(
    POLICY_SQL
    + """SELECT CAST(year(s.activity_date) * 100 + month(s.activity_date) AS INT) AS year_month, tool_name, task_name,
  t.review_type, m.practice_area, count(*) AS sessions, count(*) FILTER (WHERE status <> 'Success') AS failed_sessions,
  count(*) FILTER (WHERE retry_count > 0) AS retried_sessions, round(CAST(sum(cost) AS DOUBLE), 6) AS cost,
  count(e.accepted) AS outputs, count(*) FILTER (WHERE e.accepted) AS accepted_outputs,
  count(*) FILTER (WHERE e.mandatory) AS mandatory_outputs,
  count(*) FILTER (WHERE e.mandatory AND e.reviewed) AS mandatory_reviewed,
  count(*) FILTER (WHERE e.mandatory AND NOT e.reviewed) AS review_gap,
  round(quantile_cont(CAST(e.edit_distance_pct AS DOUBLE), 0.5), 6) AS median_edit_distance_pct,
  round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.95), 6) AS p95_latency_ms,
  round(count(*) FILTER (WHERE status <> 'Success') / count(*), 6) AS error_rate,
  round(count(*) FILTER (WHERE e.accepted) / nullif(count(e.accepted), 0), 6) AS acceptance_rate,
  round(count(*) FILTER (WHERE e.mandatory AND e.reviewed) / nullif(count(*) FILTER (WHERE e.mandatory), 0), 6)
    AS review_coverage,
  round(CAST(sum(cost) AS DOUBLE) / nullif(count(*) FILTER (WHERE e.accepted), 0), 6) AS cost_per_accepted_output
FROM sessions s JOIN tools USING (tool_id) JOIN tasks t USING (task_type_id) JOIN matters m USING (matter_id)
  LEFT JOIN enriched e USING (session_id)
GROUP BY 1, 2, 3, 4, 5"""
)
def quality_panel(spark: SparkSession, d: str) -> DataFrame:
    df = quality.quality_panel(
        b.sessions(spark, d),
        b.enriched(spark, d),
        b.tools(spark, d),
        b.tasks(spark, d),
        b.matters(spark, d),
    )
    return rounded(
        df,
        "cost",
        "median_edit_distance_pct",
        "p95_latency_ms",
        "error_rate",
        "acceptance_rate",
        "review_coverage",
        "cost_per_accepted_output",
    )


@query(
    with_sql(SESSIONS_SQL, OUTPUTS_SQL, LAWYERS_SQL, TOOLS_SQL, SEATS_SQL)
    + """, se AS (SELECT year(month) * 100 + month(month) AS year_month,
  year(month) + CASE WHEN month(month) >= 7 THEN 1 ELSE 0 END AS fy_year, tool_id, count(*) AS seats,
  count(*) FILTER (WHERE NOT used_in_month) AS idle_seats, sum(licence_cost) AS licence,
  coalesce(sum(licence_cost) FILTER (WHERE NOT used_in_month), 0) AS idle FROM seats GROUP BY 1, 2, 3),
us AS (SELECT year(s.activity_date) * 100 + month(s.activity_date) AS year_month, s.tool_id, count(*) AS sessions,
  sum(cost) AS token, count(*) FILTER (WHERE accepted) AS accepted
  FROM sessions s LEFT JOIN outputs o USING (session_id) GROUP BY 1, 2)
SELECT CAST(se.year_month AS INT) AS year_month, CAST(se.fy_year AS INT) AS fy_year, tool_name, se.seats, se.idle_seats,
  round(se.idle_seats / se.seats, 6) AS idle_seat_share, round(CAST(licence AS DOUBLE), 6) AS licence_cost,
  round(CAST(idle AS DOUBLE), 6) AS idle_licence_cost, round(CAST(coalesce(token, 0) AS DOUBLE), 6) AS token_cost,
  round(CAST(licence + coalesce(token, 0) AS DOUBLE), 6) AS total_cost, coalesce(sessions, 0) AS sessions,
  coalesce(accepted, 0) AS accepted_outputs,
  round(CAST(licence + coalesce(token, 0) AS DOUBLE) / nullif(accepted, 0), 6) AS cost_per_accepted_output,
  round(CAST(coalesce(token, 0) AS DOUBLE) / CAST(licence + coalesce(token, 0) AS DOUBLE), 6) AS token_share_of_cost
FROM se JOIN tools USING (tool_id) LEFT JOIN us USING (year_month, tool_id)"""
)
def cost_efficiency(spark: SparkSession, d: str) -> DataFrame:
    df = cost.cost_efficiency(
        b.seats(spark, d), b.sessions(spark, d), b.outputs(spark, d), b.tools(spark, d)
    )
    df = df.withColumn("seats", F.col("seats").cast("long"))
    return rounded(
        df,
        "idle_seat_share",
        "licence_cost",
        "idle_licence_cost",
        "token_cost",
        "total_cost",
        "cost_per_accepted_output",
        "token_share_of_cost",
    )


@query(
    with_sql(SESSIONS_SQL, LAWYERS_SQL, TOOLS_SQL, SEATS_SQL)
    + """SELECT tool_id, month, count(*) AS seats, count(*) FILTER (WHERE used_in_month) AS used_seats
FROM seats GROUP BY 1, 2"""
)
def seat_usage(spark: SparkSession, d: str) -> DataFrame:
    return (
        b.seats(spark, d)
        .groupBy("tool_id", "month")
        .agg(F.count(F.lit(1)).alias("seats"), count_where(F.col("used_in_month")).alias("used_seats"))
    )


@query(
    POLICY_SQL
    + """, used AS (
  SELECT year(activity_date) * 100 + month(activity_date) AS year_month,
    year(activity_date) + CASE WHEN month(activity_date) >= 7 THEN 1 ELSE 0 END AS fy_year,
    ((month(activity_date) + 5) % 12) // 3 + 1 AS fy_quarter, m.confidentiality_tier, m.practice_area, tool_name,
    count(*) AS sessions FROM sessions JOIN matters m USING (matter_id) JOIN tools USING (tool_id)
  GROUP BY 1, 2, 3, 4, 5, 6),
rev AS (
  SELECT year(activity_date) * 100 + month(activity_date) AS year_month, confidentiality_tier, practice_area,
    tool_name, count(*) FILTER (WHERE mandatory) AS mandatory_outputs,
    count(*) FILTER (WHERE mandatory AND reviewed) AS mandatory_reviewed
  FROM enriched JOIN tools USING (tool_id) GROUP BY 1, 2, 3, 4)
SELECT CAST(year_month AS INT) AS year_month, CAST(fy_year AS INT) AS fy_year, CAST(fy_quarter AS INT) AS fy_quarter,
  confidentiality_tier, practice_area, tool_name, sessions,
  round(sessions / sum(sessions) OVER (PARTITION BY year_month), 6) AS session_share, mandatory_outputs,
  mandatory_reviewed, round(mandatory_reviewed / nullif(mandatory_outputs, 0), 6) AS review_coverage
FROM used LEFT JOIN rev USING (year_month, confidentiality_tier, practice_area, tool_name)"""
)
def governance_exposure(spark: SparkSession, d: str) -> DataFrame:
    df = governance.governance_exposure(
        b.sessions(spark, d), b.enriched(spark, d), b.matters(spark, d), b.tools(spark, d)
    )
    return rounded(df, "session_share", "review_coverage")


SCREEN_CTE = """, q AS (
  SELECT lawyer_id, year(activity_date) + CASE WHEN month(activity_date) >= 7 THEN 1 ELSE 0 END AS fy_year,
    ((month(activity_date) + 5) % 12) // 3 + 1 AS fy_quarter, count(*) AS sessions,
    count(*) FILTER (WHERE m.confidentiality_tier IN ('Restricted', 'Barrier')) AS sensitive_sessions,
    count(DISTINCT m.barrier_group_id) AS barrier_groups_touched
  FROM sessions JOIN matters m USING (matter_id) GROUP BY 1, 2, 3),
r AS (
  SELECT lawyer_id, year(activity_date) + CASE WHEN month(activity_date) >= 7 THEN 1 ELSE 0 END AS fy_year,
    ((month(activity_date) + 5) % 12) // 3 + 1 AS fy_quarter,
    count(*) FILTER (WHERE mandatory) AS mandatory_outputs,
    count(*) FILTER (WHERE mandatory AND reviewed) AS mandatory_reviewed
  FROM enriched GROUP BY 1, 2, 3),
screen AS (
  SELECT q.*, coalesce(mandatory_outputs, 0) AS mandatory_outputs, coalesce(mandatory_reviewed, 0) AS mandatory_reviewed,
    sensitive_sessions / sessions AS sensitive_session_rate,
    mandatory_reviewed / nullif(mandatory_outputs, 0) AS review_completion,
    coalesce(mandatory_outputs, 0) >= 25 AS is_screenable
  FROM q LEFT JOIN r USING (lawyer_id, fy_year, fy_quarter))
"""


@query(
    POLICY_SQL
    + SCREEN_CTE
    + """SELECT lawyer_id, CAST(fy_year AS INT) AS fy_year, CAST(fy_quarter AS INT) AS fy_quarter, sessions,
  sensitive_sessions, barrier_groups_touched, mandatory_outputs, mandatory_reviewed,
  round(sensitive_session_rate, 6) AS sensitive_session_rate, round(review_completion, 6) AS review_completion,
  is_screenable FROM screen"""
)
def governance_screen(spark: SparkSession, d: str) -> DataFrame:
    df = governance.governance_screen(
        b.sessions(spark, d), b.enriched(spark, d), b.matters(spark, d)
    )
    return rounded(df, "sensitive_session_rate", "review_completion")


@query(
    with_sql(SESSIONS_SQL, MATTERS_SQL)
    + """, act AS (SELECT DISTINCT lawyer_id, barrier_group_id, activity_date AS day
  FROM sessions JOIN matters USING (matter_id) WHERE barrier_group_id IS NOT NULL),
windows AS (SELECT a.lawyer_id, a.day, count(DISTINCT p.barrier_group_id) AS groups
  FROM act a JOIN act p ON p.lawyer_id = a.lawyer_id AND p.day BETWEEN a.day - 89 AND a.day GROUP BY 1, 2)
SELECT lawyer_id, max(groups) AS max_groups, min(day) FILTER (WHERE groups >= 2) AS first_crossing
FROM windows GROUP BY 1 HAVING max(groups) >= 2"""
)
def barrier_rolling_90d(spark: SparkSession, d: str) -> DataFrame:
    return governance.barrier_rolling(b.sessions(spark, d), b.matters(spark, d))


@query(
    with_sql(LINE_FEED_SQL)
    + """SELECT source, run_date, rows_loaded, rows_rejected, referential_failures,
  CASE WHEN rows_rejected > 0 AND rows_loaded = 0 THEN 'Failed' WHEN rows_rejected > 0 THEN 'Warning'
       ELSE 'Success' END AS run_status, live_from, is_expected_active, round(trailing_mean, 6) AS trailing_mean,
  last_good_run, round(referential_failure_rate, 6) AS referential_failure_rate,
  round(load_vs_trailing_mean, 6) AS load_vs_trailing_mean, CAST(hours_since_good_run AS INT) AS hours_since_good_run,
  is_unexpected_zero_load FROM health"""
)
def feed_health(spark: SparkSession, d: str) -> DataFrame:
    runs, live = b.line_feed(spark, d)
    return rounded(
        feeds.feed_health(runs, live),
        "trailing_mean",
        "referential_failure_rate",
        "load_vs_trailing_mean",
    )


ALERT_SQL = (
    "WITH "
    + STAR_SQL
    + SCREEN_CTE.rstrip()
    + """, latest_day AS (SELECT max(activity_date) AS d FROM sessions),
months_out AS (SELECT year(activity_date) * 100 + month(activity_date) AS ym,
  count(*) FILTER (WHERE accepted) / count(*) AS r FROM outputs GROUP BY 1),
money AS (SELECT last_day(activity_date) AS me, sum(cost) AS c FROM sessions GROUP BY 1
  UNION ALL SELECT last_day(month), sum(licence_cost) FROM seats GROUP BY 1),
mark AS (SELECT CASE WHEN max(run_date) = last_day(max(run_date)) THEN max(run_date)
  ELSE last_day(max(run_date) - INTERVAL 1 MONTH) END AS me FROM runs),
monthly AS (SELECT me, sum(c) AS c FROM money GROUP BY 1),
v(rule_name, value, affected) AS (
  SELECT 'p95 latency above 8s', max(p), count(*) FROM (
    SELECT quantile_cont(CAST(latency_ms AS DOUBLE), 0.95) AS p FROM sessions, latest_day
    WHERE activity_date = d AND status = 'Success' GROUP BY tool_id)
  UNION ALL SELECT 'Error rate above 5% over 24h', count(*) FILTER (WHERE status <> 'Success') / nullif(count(*), 0),
    count(*) FILTER (WHERE status <> 'Success') FROM sessions, latest_day WHERE activity_date = d
  UNION ALL SELECT 'Feed loaded zero rows', min(rows_loaded), count(*) FILTER (WHERE is_unexpected_zero_load)
    FROM health, latest_day WHERE is_expected_active AND run_date > d - 30
  UNION ALL SELECT 'Feed stale beyond 36 hours', max(hours_since_good_run), count(DISTINCT source)
    FROM health, latest_day WHERE run_date = d
  UNION ALL SELECT 'Referential failures above 1% of a source', max(r), count(*) FROM (
    SELECT sum(referential_failures) / nullif(sum(rows_loaded + rows_rejected), 0) AS r FROM health, latest_day
    WHERE run_date > d - 7 GROUP BY source)
  UNION ALL SELECT 'Median edit distance above 45%', max(m), count(*) FILTER (WHERE m > 45) FROM (
    SELECT quantile_cont(CAST(edit_distance_pct AS DOUBLE), 0.5) AS m FROM outputs, latest_day
    WHERE activity_date > d - 30 GROUP BY task_type_id)
  UNION ALL SELECT 'Acceptance rate falls 15pp month on month', min(x), count(*) FILTER (WHERE x < -0.15) FROM (
    SELECT r - lag(r) OVER (ORDER BY ym) AS x FROM months_out)
  UNION ALL SELECT 'Cost per accepted output above $12',
    CAST((SELECT sum(licence_cost) FROM seats) + (SELECT sum(cost) FROM sessions) AS DOUBLE)
      / nullif(count(*) FILTER (WHERE accepted), 0), count(*) FILTER (WHERE accepted) FROM outputs
  UNION ALL SELECT 'Idle seat share above 40% for a paid tool', max(i), count(*) FROM (
    SELECT count(*) FILTER (WHERE NOT used_in_month) / count(*) AS i FROM seats, latest_day
    WHERE month > d - INTERVAL 3 MONTH GROUP BY tool_id)
  UNION ALL SELECT 'Monthly cost 30% above trailing 3-month mean',
    CASE WHEN count(*) = 4 THEN 3 * CAST(sum(c) FILTER (WHERE monthly.me = mark.me) AS DOUBLE)
      / nullif(CAST(sum(c) FILTER (WHERE monthly.me < mark.me) AS DOUBLE), 0) - 1 END, NULL
    FROM monthly, mark WHERE monthly.me BETWEEN last_day(mark.me - INTERVAL 3 MONTH) AND mark.me
  UNION ALL SELECT 'Review coverage below 95% on Barrier matters', count(*) FILTER (WHERE reviewed) / nullif(count(*), 0),
    count(*) FROM enriched WHERE mandatory AND confidentiality_tier = 'Barrier'
  UNION ALL SELECT 'Any unreviewed output where review is Mandatory', count(*), count(*) FROM enriched, latest_day
    WHERE mandatory AND NOT reviewed AND activity_date > d - 30
  UNION ALL SELECT 'First use of a newly deployed tool on a Restricted matter', count(*), count(*) FROM (
    SELECT DISTINCT tool_id, lawyer_id FROM sessions JOIN matters USING (matter_id) JOIN tools USING (tool_id)
    WHERE confidentiality_tier IN ('Restricted', 'Barrier') AND activity_date <= deployment_date + 90)
  UNION ALL SELECT 'Lawyer active across two barrier groups in 90 days', max(barrier_groups_touched), count(*)
    FROM screen WHERE barrier_groups_touched >= 2
  UNION ALL SELECT 'Lawyer mandatory review completion below 70%', min(review_completion),
    count(*) FILTER (WHERE review_completion < 0.70) FROM screen WHERE is_screenable
  UNION ALL SELECT 'Restricted-tier session rate above 3x the firm median', max(r / nullif(m, 0)),
    count(*) FILTER (WHERE r / nullif(m, 0) > 3) FROM (
      SELECT r, quantile_cont(r, 0.5) OVER () AS m FROM (
        SELECT sum(sensitive_sessions) / sum(sessions) AS r FROM screen GROUP BY lawyer_id))),
rules(rule_id, rule_name, category, threshold_value, comparison, severity, owner_role) AS (VALUES """
    + ", ".join(
        f"({i}, '{r[0]}', '{r[1]}', CAST({r[2]} AS DOUBLE), '{r[3]}', '{r[4]}', '{r[5]}')" for i, r in enumerate(alerts.RULES, 1)
    )
    + """),
checked AS (SELECT rules.*, value, affected, CASE WHEN value IS NULL THEN NULL
  WHEN comparison = '>' THEN value > threshold_value WHEN comparison = '>=' THEN value >= threshold_value
  WHEN comparison = '<' THEN value < threshold_value WHEN comparison = '=' THEN value = threshold_value
  ELSE false END AS is_breached FROM rules LEFT JOIN v USING (rule_name))
SELECT rule_id, rule_name, category, threshold_value, comparison, severity, owner_role, round(CAST(value AS DOUBLE), 6) AS current_value, is_breached,
  CASE WHEN rule_name LIKE 'Monthly cost%' THEN CAST(is_breached AS BIGINT) ELSE CAST(affected AS BIGINT) END
    AS affected_count FROM checked"""
)


@query(ALERT_SQL)
def alert_status(spark: SparkSession, d: str) -> DataFrame:
    status = alerts.alert_status(b.star(spark, d), alerts.rule_catalogue(spark))
    return rounded(status, "current_value")


@query(
    """WITH money AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS me, sum(CAST(o_totalprice AS DECIMAL(24,6))) AS c
  FROM orders GROUP BY 1
  UNION ALL SELECT last_day(CAST(l_shipdate AS DATE)), sum(CAST(l_extendedprice AS DECIMAL(24,6))) FROM lineitem GROUP BY 1),
mark AS (SELECT CASE WHEN max(x) = last_day(max(x)) THEN max(x) ELSE last_day(max(x) - INTERVAL 1 MONTH) END AS me
  FROM (SELECT CAST(max(o_orderdate) AS DATE) AS x FROM orders)),
monthly AS (SELECT me, sum(c) AS c FROM money GROUP BY 1)
SELECT round(CASE WHEN count(*) = 4 THEN 3 * CAST(sum(c) FILTER (WHERE monthly.me = mark.me) AS DOUBLE)
      / nullif(CAST(sum(c) FILTER (WHERE monthly.me < mark.me) AS DOUBLE), 0) - 1 END, 6) AS change
FROM monthly, mark WHERE monthly.me BETWEEN last_day(mark.me - INTERVAL 3 MONTH) AND mark.me"""
)
def monthly_cost_change(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = b.table(spark, d, "orders"), b.table(spark, d, "lineitem")
    day = F.col("o_orderdate").cast("date")
    change = alerts.monthly_cost_change(
        orders.select(day.alias("activity_date"), F.col("o_totalprice").alias("cost")),
        lines.select(
            F.col("l_shipdate").cast("date").alias("month"),
            F.col("l_extendedprice").alias("licence_cost"),
        ),
        orders.select(day.alias("run_date")),
    )
    return rounded(change, "change")


@query(
    with_sql(SESSIONS_SQL, INCIDENTS_SQL)
    + """SELECT incident_type, severity, CAST(year(incident_date) * 100 + month(incident_date) AS INT) AS year_month,
  count(*) AS incidents, round(avg(days_to_resolve) FILTER (WHERE resolved), 6) AS mean_days_to_resolve,
  count(*) FILTER (WHERE NOT resolved) AS open_incidents FROM incidents GROUP BY 1, 2, 3"""
)
def incident_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.incident_profile(b.incidents(spark, d)), "mean_days_to_resolve")


@query(
    POLICY_SQL
    + ","
    + INCIDENTS_SQL
    + """, cov AS (SELECT lawyer_id, count(*) FILTER (WHERE reviewed) / count(*) AS coverage FROM enriched
  WHERE mandatory GROUP BY 1),
inc AS (SELECT lawyer_id, count(*) AS n FROM incidents GROUP BY 1),
edge AS (SELECT quantile_cont(coverage, 0.25) AS a, quantile_cont(coverage, 0.5) AS b,
  quantile_cont(coverage, 0.75) AS c FROM cov)
SELECT CAST(CASE WHEN coverage <= a THEN 1 WHEN coverage <= b THEN 2 WHEN coverage <= c THEN 3 ELSE 4 END AS INT)
    AS quartile, count(*) AS lawyers, CAST(sum(coalesce(n, 0)) AS BIGINT) AS incidents,
  round(avg(coverage), 6) AS mean_coverage, round(sum(coalesce(n, 0)) / count(*), 6) AS incidents_per_lawyer
FROM cov CROSS JOIN edge LEFT JOIN inc USING (lawyer_id) GROUP BY 1"""
)
def coverage_quartile_incidents(spark: SparkSession, d: str) -> DataFrame:
    df = quality.incidents_by_coverage_quartile(b.enriched(spark, d), b.incidents(spark, d))
    return rounded(df, "mean_coverage", "incidents_per_lawyer")


KPI_MONTH_METRICS = [
    "active_lawyers",
    "sessions",
    "token_cost",
    "licence_cost",
    "total_cost",
    "accepted_outputs",
    "lawyer_population",
    "adoption_rate",
    "cost_per_accepted_output",
    "acceptance_rate",
    "review_coverage",
    "sessions_per_active_lawyer",
    "p95_latency_ms",
    "error_rate",
    "median_edit_distance_pct",
    "review_gap",
    "retry_rate",
    "heavy_rework_share",
    "governance_exposure",
    "idle_seat_share",
    "idle_licence_cost",
]
KPI_EXACT = {
    "active_lawyers",
    "sessions",
    "accepted_outputs",
    "lawyer_population",
    "review_gap",
    "matters",
    "lawyers_never_adopted",
    "ai_matters",
    "screen_mandatory_outputs",
    "open_incidents",
    "breached_rules",
}


def _facts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    s = b.sessions(spark, d).join(
        b.matters(spark, d).select("matter_id", "confidentiality_tier"), "matter_id"
    )
    return {
        "sessions": s.withColumn("year_month", year_month("activity_date")),
        "outputs": b.enriched(spark, d).withColumn("year_month", year_month("activity_date")),
        "seats": b.seats(spark, d).withColumn("year_month", year_month("month")),
        "lawyers": b.lawyers(spark, d),
        "matters": b.matters(spark, d),
        "users": b.sessions(spark, d).select("lawyer_id").distinct(),
    }


def _evaluate(names, facts, by) -> DataFrame:
    known = metrics.catalogue()
    out = metrics.evaluate([known[n] for n in names], facts, by)
    return rounded(out, *[n for n in names if n not in KPI_EXACT])


@query(
    "WITH "
    + STAR_SQL
    + """, s AS (SELECT CAST(year(activity_date) * 100 + month(activity_date) AS INT) AS year_month,
  count(DISTINCT lawyer_id) AS active_lawyers, count(*) AS sessions, sum(cost) AS token,
  quantile_cont(CAST(latency_ms AS DOUBLE), 0.95) FILTER (WHERE status = 'Success') AS p95,
  count(*) FILTER (WHERE status <> 'Success') AS failed, count(*) FILTER (WHERE retry_count > 0) AS retried,
  count(*) FILTER (WHERE m.confidentiality_tier IN ('Restricted', 'Barrier')) AS sensitive
  FROM sessions JOIN matters m USING (matter_id) GROUP BY 1),
o AS (SELECT CAST(year(activity_date) * 100 + month(activity_date) AS INT) AS year_month, count(*) AS outputs,
  count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE mandatory) AS mandatory,
  count(*) FILTER (WHERE mandatory AND reviewed) AS reviewed, count(*) FILTER (WHERE mandatory AND NOT reviewed) AS gap,
  quantile_cont(CAST(edit_distance_pct AS DOUBLE), 0.5) AS med,
  count(*) FILTER (WHERE accepted AND edit_distance_pct > 40) AS heavy FROM enriched GROUP BY 1),
e AS (SELECT CAST(year(month) * 100 + month(month) AS INT) AS year_month, sum(licence_cost) AS licence, count(*) AS n,
  count(*) FILTER (WHERE NOT used_in_month) AS idle,
  coalesce(sum(licence_cost) FILTER (WHERE NOT used_in_month), 0) AS idle_cost FROM seats GROUP BY 1),
p AS (SELECT count(*) FILTER (WHERE is_active) AS population FROM lawyers)
SELECT year_month, active_lawyers, sessions, round(CAST(token AS DOUBLE), 6) AS token_cost,
  round(CAST(licence AS DOUBLE), 6) AS licence_cost, round(CAST(token + licence AS DOUBLE), 6) AS total_cost,
  accepted AS accepted_outputs, population AS lawyer_population, round(active_lawyers / population, 6) AS adoption_rate,
  round(CAST(token + licence AS DOUBLE) / accepted, 6) AS cost_per_accepted_output,
  round(accepted / outputs, 6) AS acceptance_rate, round(reviewed / mandatory, 6) AS review_coverage,
  round(sessions / active_lawyers, 6) AS sessions_per_active_lawyer, round(p95, 6) AS p95_latency_ms,
  round(failed / sessions, 6) AS error_rate, round(med, 6) AS median_edit_distance_pct, gap AS review_gap,
  round(retried / sessions, 6) AS retry_rate, round(heavy / accepted, 6) AS heavy_rework_share,
  round(sensitive / sessions, 6) AS governance_exposure, round(idle / n, 6) AS idle_seat_share,
  round(CAST(idle_cost AS DOUBLE), 6) AS idle_licence_cost
FROM s FULL JOIN o USING (year_month) FULL JOIN e USING (year_month) CROSS JOIN p"""
)
def kpi_by_month(spark: SparkSession, d: str) -> DataFrame:
    return _evaluate(KPI_MONTH_METRICS, _facts(spark, d), ["year_month"])


@query(
    with_sql(SESSIONS_SQL, LAWYERS_SQL, TIME_SQL, MATTERS_SQL, ESTIMATES_SQL)
    + """, priced AS (SELECT t.*, m.fee_arrangement,
    coalesce(CAST(hours AS DOUBLE) * -(estimate_pct / 100.0) / (1 + estimate_pct / 100.0) * CAST(rate AS DOUBLE), 0) AS capacity
  FROM time t JOIN matters m USING (matter_id) JOIN lawyers USING (lawyer_id) LEFT JOIN estimates USING (fee_arrangement))
SELECT round(CAST(sum(hours) FILTER (WHERE is_post_adoption) AS DOUBLE), 6) AS post_adoption_hours,
  round(sum(capacity) FILTER (WHERE is_post_adoption), 4) AS notional_capacity,
  round(sum(capacity) FILTER (WHERE is_post_adoption AND fee_arrangement = 'Hourly' AND billable), 4) AS hourly_revenue_at_risk,
  round(sum(capacity) FILTER (WHERE is_post_adoption AND fee_arrangement IN ('Fixed Fee', 'Capped')), 4) AS fixed_price_capacity,
  count(DISTINCT matter_id) FILTER (WHERE is_post_adoption) AS ai_matters,
  (SELECT count(*) FILTER (WHERE is_active) FROM lawyers) - (SELECT count(DISTINCT lawyer_id) FROM sessions) AS lawyers_never_adopted,
  round(((SELECT count(*) FILTER (WHERE is_active) FROM lawyers) - (SELECT count(DISTINCT lawyer_id) FROM sessions))
    / (SELECT count(*) FILTER (WHERE is_active) FROM lawyers), 6) AS never_adopted_share,
  (SELECT count(*) FROM matters) AS matters
FROM priced"""
)
def kpi_overall(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts(spark, d)
    facts["time"] = metrics.priced_time(
        b.time_entries(spark, d), b.matters(spark, d), b.lawyers(spark, d), b.estimates(spark)
    )
    names = [
        "post_adoption_hours",
        "notional_capacity",
        "hourly_revenue_at_risk",
        "fixed_price_capacity",
        "ai_matters",
        "lawyers_never_adopted",
        "never_adopted_share",
        "matters",
    ]
    out = _evaluate(names, facts, [])
    for name in ("notional_capacity", "hourly_revenue_at_risk", "fixed_price_capacity"):
        out = out.withColumn(name, F.round(name, 4))
    return out


@query(
    POLICY_SQL
    + SCREEN_CTE.rstrip()
    + """, e AS (SELECT lawyer_id FROM screen GROUP BY 1 HAVING sum(mandatory_outputs) >= 25)
SELECT CAST(fy_quarter AS INT) AS fy_quarter, CAST(sum(mandatory_outputs) AS BIGINT) AS screen_mandatory_outputs,
  round(sum(mandatory_reviewed) / sum(mandatory_outputs), 6) AS screen_completion,
  round(sum(sensitive_sessions) / sum(sessions), 6) AS screen_sensitive_rate
FROM screen WHERE lawyer_id IN (SELECT lawyer_id FROM e) GROUP BY 1"""
)
def screen_measures(spark: SparkSession, d: str) -> DataFrame:
    """Screen measures per fiscal quarter, of lawyers with enough outputs in all."""
    screen = governance.governance_screen(b.sessions(spark, d), b.enriched(spark, d), b.matters(spark, d))
    names = ["screen_mandatory_outputs", "screen_completion", "screen_sensitive_rate"]
    return _evaluate(names, {"screen": governance.eligible_screen(screen)}, ["fy_quarter"])


@query(
    with_sql(SESSIONS_SQL, b.INCIDENTS_SQL)
    + f"""SELECT count(*) FILTER (WHERE NOT resolved) AS open_incidents,
  (SELECT count(*) FILTER (WHERE is_breached) FROM ({ALERT_SQL})) AS breached_rules FROM incidents"""
)
def watch_list(spark: SparkSession, d: str) -> DataFrame:
    facts = {
        "incidents": b.incidents(spark, d),
        "alerts": alerts.alert_status(b.star(spark, d), alerts.rule_catalogue(spark)),
    }
    return _evaluate(["open_incidents", "breached_rules"], facts, [])


@query(
    """WITH m AS (SELECT c_mktsegment AS level, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
    count(DISTINCT o_custkey) / any_value(p.n) AS adoption_rate
  FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1) p ON p.seg = c_mktsegment GROUP BY 1, 2)
SELECT a.level, a.month, round(a.adoption_rate, 6) AS adoption_rate, round(b.adoption_rate, 6) AS previous,
  round(a.adoption_rate - b.adoption_rate, 6) AS change
FROM m a LEFT JOIN m b ON b.level = a.level AND b.month = a.month - INTERVAL 1 MONTH"""
)
def kpi_mom(spark: SparkSession, d: str) -> DataFrame:
    customers = b.table(spark, d, "customer").select(
        F.col("c_custkey").alias("actor"), F.col("c_mktsegment").alias("level")
    )
    active = (
        b.table(spark, d, "orders")
        .select(F.col("o_custkey").alias("actor"), F.trunc("o_orderdate", "month").alias("month"))
        .distinct()
    )
    size = customers.groupBy("level").agg(F.count(F.lit(1)).alias("population"))
    monthly = (
        active.join(customers, "actor")
        .groupBy("level", "month")
        .agg(F.count(F.lit(1)).alias("active"))
        .join(size, "level")
        .select("level", "month", (F.col("active") / F.col("population")).alias("adoption_rate"))
    )
    df = metrics.month_over_month(monthly, "adoption_rate", "month", ["level"])
    return rounded(df, "adoption_rate", "previous", "change")


@query(
    """WITH daily AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS cost
  FROM orders GROUP BY 1)
SELECT date, CAST(cost AS DOUBLE) AS cost,
  CAST(year(date) + CASE WHEN month(date) >= 7 THEN 1 ELSE 0 END AS INT) AS fy_year,
  CAST(sum(cost) OVER (PARTITION BY year(date) + CASE WHEN month(date) >= 7 THEN 1 ELSE 0 END ORDER BY date) AS DOUBLE)
    AS to_date FROM daily"""
)
def fytd_cost(spark: SparkSession, d: str) -> DataFrame:
    daily = (
        b.table(spark, d, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("cost"))
    )
    out = metrics.fiscal_year_to_date(daily, "cost")
    return out.withColumn("cost", F.col("cost").cast("double")).withColumn(
        "to_date", F.col("to_date").cast("double")
    )


@query(
    """WITH act AS (SELECT DISTINCT o_custkey AS u, CAST(o_orderdate AS DATE) AS day FROM orders),
days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS date FROM act),
p AS (SELECT count(*) FILTER (WHERE c_custkey % 25 <> 0) AS lawyers FROM customer)
SELECT date, count(DISTINCT u) AS active_lawyers, any_value(lawyers) AS lawyers,
  round(count(DISTINCT u) / any_value(lawyers), 6) AS adoption_rate
FROM days JOIN act ON act.day BETWEEN date - 83 AND date CROSS JOIN p GROUP BY 1"""
)
def rolling_12w_adoption(spark: SparkSession, d: str) -> DataFrame:
    activity = b.table(spark, d, "orders").select(
        F.col("o_custkey").alias("lawyer_id"),
        F.col("o_orderdate").cast("date").alias("activity_date"),
    )
    return rounded(adoption.rolling_reach(activity, b.lawyers(spark, d)), "adoption_rate")


@query(
    with_sql(SESSIONS_SQL, MATTERS_SQL)
    + """, s AS (SELECT m.practice_area, m.confidentiality_tier, count(*) AS sessions
  FROM sessions JOIN matters m USING (matter_id) GROUP BY 1, 2)
SELECT practice_area, confidentiality_tier, sessions,
  round(sessions / sum(sessions) OVER (PARTITION BY practice_area), 6) AS share FROM s"""
)
def share_of_sessions(spark: SparkSession, d: str) -> DataFrame:
    counts = (
        b.sessions(spark, d)
        .join(b.matters(spark, d), "matter_id")
        .groupBy("practice_area", "confidentiality_tier")
        .agg(F.count(F.lit(1)).alias("sessions"))
    )
    return rounded(
        metrics.share_of_total(counts, "sessions", "confidentiality_tier", ["practice_area"]), "share"
    )


@query(
    with_sql(SESSIONS_SQL, TIME_SQL, MATTERS_SQL, LAWYERS_SQL, ESTIMATES_SQL)
    + """, e AS (SELECT lawyer_id, matter_id, year(entry_date) * 100 + month(entry_date) AS year_month,
    year(entry_date) + CASE WHEN month(entry_date) >= 7 THEN 1 ELSE 0 END AS fy_year,
    CAST(sum(hours) AS DOUBLE) AS hours, CAST(coalesce(sum(hours) FILTER (WHERE billable), 0) AS DOUBLE) AS billable_hours,
    CAST(coalesce(sum(hours) FILTER (WHERE is_post_adoption), 0) AS DOUBLE) AS ph,
    CAST(coalesce(sum(hours) FILTER (WHERE is_post_adoption AND billable), 0) AS DOUBLE) AS pbh,
    any_value(ai_sessions) AS ai FROM time GROUP BY 1, 2, 3, 4)
SELECT lawyer_id, matter_id, CAST(year_month AS INT) AS year_month, CAST(fy_year AS INT) AS fy_year, fee_arrangement,
  practice_area, confidentiality_tier, level, practice_group, office, CAST(rate AS DOUBLE) AS rate, hours, billable_hours,
  ph AS post_adoption_hours, pbh AS post_adoption_billable_hours, coalesce(ai, 0) AS ai_sessions, ai IS NOT NULL AS is_ai_assisted,
  round(ph * -(estimate_pct / 100.0) / (1 + estimate_pct / 100.0), 6) AS implied_hours_released,
  round(ph * -(estimate_pct / 100.0) / (1 + estimate_pct / 100.0) * CAST(rate AS DOUBLE), 4) AS notional_capacity_released,
  CASE WHEN fee_arrangement = 'Hourly' THEN round(pbh * -(estimate_pct / 100.0) / (1 + estimate_pct / 100.0) * CAST(rate AS DOUBLE), 4) END
    AS hourly_revenue_exposure, estimate_pct, ci_low_pct, ci_high_pct
FROM e JOIN matters USING (matter_id) JOIN lawyers USING (lawyer_id) JOIN estimates USING (fee_arrangement)"""
)
def billable_impact(spark: SparkSession, d: str) -> DataFrame:
    df = cost.billable_impact(
        b.time_entries(spark, d),
        b.sessions(spark, d),
        b.matters(spark, d),
        b.lawyers(spark, d),
        b.estimates(spark),
    )
    df = rounded(
        df,
        "hours",
        "billable_hours",
        "post_adoption_hours",
        "post_adoption_billable_hours",
        "implied_hours_released",
        "rate",
    )
    for name in ("notional_capacity_released", "hourly_revenue_exposure"):
        df = df.withColumn(name, F.round(F.col(name).cast("double"), 4))
    return df


@query(
    with_sql(SESSIONS_SQL, TIME_SQL)
    + """SELECT lawyer_id, round(CAST(sum(hours) AS DOUBLE), 6) AS hours, count(DISTINCT matter_id) AS matters,
  round(CAST(sum(hours) AS DOUBLE) / count(DISTINCT matter_id), 6) AS hours_per_matter FROM time GROUP BY 1"""
)
def hours_per_matter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        cost.hours_per_matter(b.time_entries(spark, d), ["lawyer_id"]), "hours", "hours_per_matter"
    )


@query(
    with_sql(SESSIONS_SQL, TIME_SQL)
    + """, q AS (SELECT lawyer_id, year(entry_date) + CASE WHEN month(entry_date) >= 7 THEN 1 ELSE 0 END AS fy_year,
    ((month(entry_date) + 5) % 12) // 3 + 1 AS fy_quarter, CAST(sum(hours) AS DOUBLE) AS hours,
    CAST(coalesce(sum(hours) FILTER (WHERE ai_sessions IS NOT NULL), 0) AS DOUBLE) AS assisted FROM time GROUP BY 1, 2, 3),
c AS (SELECT *, hours - lag(hours) OVER w AS hc, assisted - lag(assisted) OVER w AS ac FROM q
  WINDOW w AS (PARTITION BY lawyer_id ORDER BY fy_year, fy_quarter))
SELECT lawyer_id, CAST(fy_year AS INT) AS fy_year, CAST(fy_quarter AS INT) AS fy_quarter, round(hours, 6) AS hours,
  round(assisted, 6) AS assisted_hours, round(hc, 6) AS hours_change, round(ac, 6) AS assisted_hours_change,
  round(hc / nullif(ac, 0), 4) AS reallocation_ratio FROM c"""
)
def reallocation_ratio(spark: SparkSession, d: str) -> DataFrame:
    df = rounded(
        cost.reallocation_ratio(b.time_entries(spark, d)),
        "hours",
        "assisted_hours",
        "hours_change",
        "assisted_hours_change",
    )
    return df.withColumn("reallocation_ratio", F.round("reallocation_ratio", 4))


@query(
    with_sql(SESSIONS_SQL, TIME_SQL)
    + """, p AS (SELECT lawyer_id, matter_id, ai_sessions IS NOT NULL AS assisted, sum(hours) AS hours, count(*) AS n,
  count(*) FILTER (WHERE is_post_adoption) AS post FROM time GROUP BY 1, 2, 3)
SELECT assisted, count(*) AS pairs, round(avg(CAST(hours AS DOUBLE)), 4) AS mean_hours,
  CASE WHEN assisted THEN round(count(*) FILTER (WHERE n = post) / count(*), 6) END AS share_without_before
FROM p GROUP BY 1"""
)
def naive_hours(spark: SparkSession, d: str) -> DataFrame:
    df = quality.naive_hours_comparison(b.time_entries(spark, d))
    return rounded(df, "share_without_before").withColumn(
        "mean_hours", F.round(F.col("mean_hours").cast("double"), 4)
    )


EFFECT_NAMES = {"y": "y", "group": "grp", "cell": "cell", "cluster": "cluster"}


@query(
    with_sql(EFFECT_SQL)
    + """SELECT grp, round((exp(b) - 1) * 100, 6) AS estimate_pct, round((exp(b - 1.96 * sqrt(v)) - 1) * 100, 6) AS ci_low_pct,
  round((exp(b + 1.96 * sqrt(v)) - 1) * 100, 6) AS ci_high_pct, round(sqrt(v) * 100, 6) AS se_pct,
  treated AS treated_entries, control AS control_entries, CAST((SELECT k FROM size) AS BIGINT) AS n_cells,
  CAST((SELECT cl FROM size) AS BIGINT) AS n_clusters
FROM beta JOIN cov ON ga = grp AND gb = grp"""
)
def fe_effect(spark: SparkSession, d: str) -> DataFrame:
    df = regression.fe_effect(b.effect_rows(spark, d), **EFFECT_NAMES)
    df = rounded(df, "estimate_pct", "ci_low_pct", "ci_high_pct", "se_pct")
    return df.withColumn("n_cells", F.col("n_cells").cast("long")).withColumn(
        "n_clusters", F.col("n_clusters").cast("long")
    )


@query(
    with_sql(EFFECT_SQL)
    + """, pairs AS (SELECT a.grp AS group_a, c.grp AS group_b, a.b - c.b AS diff,
    sqrt(va.v + vb.v - 2 * coalesce(vab.v, 0)) AS se
  FROM beta a JOIN beta c ON a.grp < c.grp JOIN cov va ON va.ga = a.grp AND va.gb = a.grp
  JOIN cov vb ON vb.ga = c.grp AND vb.gb = c.grp LEFT JOIN cov vab ON vab.ga = a.grp AND vab.gb = c.grp)
SELECT group_a, group_b, round((exp(diff) - 1) * 100, 6) AS difference_pct,
  round((exp(diff - 1.96 * se) - 1) * 100, 6) AS ci_low_pct, round((exp(diff + 1.96 * se) - 1) * 100, 6) AS ci_high_pct,
  (exp(diff - 1.96 * se) - 1) * (exp(diff + 1.96 * se) - 1) > 0 AS is_distinguishable FROM pairs"""
)
def fe_contrasts(spark: SparkSession, d: str) -> DataFrame:
    df = regression.pairwise_contrasts(b.effect_rows(spark, d), **EFFECT_NAMES)
    return rounded(df, "difference_pct", "ci_low_pct", "ci_high_pct")


@query(
    with_sql(SESSIONS_SQL, TIME_SQL)
    + """, n AS (SELECT lawyer_id, count(*) AS c FROM sessions GROUP BY 1)
SELECT CAST(CASE WHEN is_post_adoption THEN 1 WHEN ai_sessions IS NULL AND coalesce(c, 0) < 60 THEN 0 ELSE -1 END AS INT) AS arm,
  count(*) AS entries, count(DISTINCT lawyer_id) AS lawyers, round(CAST(sum(hours) AS DOUBLE), 6) AS hours
FROM time LEFT JOIN n USING (lawyer_id) GROUP BY 1"""
)
def treatment_arms(spark: SparkSession, d: str) -> DataFrame:
    arms = regression.assign_arms(b.time_entries(spark, d), b.sessions(spark, d), 60)
    df = arms.groupBy("arm").agg(
        F.count(F.lit(1)).alias("entries"),
        F.countDistinct("lawyer_id").alias("lawyers"),
        F.sum("hours").alias("hours"),
    )
    return rounded(df, "hours")


@query(
    POLICY_SQL
    + """, cov AS (SELECT lawyer_id, count(*) AS mandatory, count(*) FILTER (WHERE reviewed) / count(*) AS completion
  FROM enriched WHERE mandatory GROUP BY 1),
use AS (SELECT lawyer_id, count(*) AS sessions,
  count(*) FILTER (WHERE confidentiality_tier IN ('Restricted', 'Barrier')) AS sensitive
  FROM sessions JOIN matters USING (matter_id) GROUP BY 1),
f AS (SELECT lawyer_id, completion, sensitive, sensitive / sessions AS rate, CASE WHEN lawyer_id % 10 = 3 THEN 1 ELSE 0 END AS hit
  FROM cov LEFT JOIN use USING (lawyer_id) WHERE mandatory >= 25),
r AS (SELECT *, rank() OVER (ORDER BY completion) + (count(*) OVER (PARTITION BY completion) - 1) / 2.0 AS r1,
  rank() OVER (ORDER BY rate DESC) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0 AS r2 FROM f),
s AS (SELECT 'completion' AS screen, lawyer_id, hit, CAST(-completion AS DOUBLE) AS score FROM r
  UNION ALL SELECT 'sensitive_rate', lawyer_id, hit, CAST(rate AS DOUBLE) FROM r
  UNION ALL SELECT 'sensitive_count', lawyer_id, hit, CAST(sensitive AS DOUBLE) FROM r
  UNION ALL SELECT 'rank_sum', lawyer_id, hit, 1 / CAST(r1 + r2 AS DOUBLE) FROM r),
o AS (SELECT *, row_number() OVER w AS i, sum(hit) OVER w AS hits FROM s
  WINDOW w AS (PARTITION BY screen ORDER BY score DESC, lawyer_id)),
a AS (SELECT screen, avg(hits / i) FILTER (WHERE hit = 1) AS ap, sum(hit) AS positives FROM o GROUP BY 1),
k AS (SELECT screen, list_size, coalesce(sum(hit) FILTER (WHERE i <= list_size), 0) AS tp
  FROM o CROSS JOIN (SELECT unnest([10, 20, 30, 50]) AS list_size) GROUP BY 1, 2)
SELECT screen, CAST(list_size AS INT) AS list_size, CAST(tp AS BIGINT) AS true_positives, round(tp / list_size, 6) AS precision,
  round(tp / nullif(positives, 0), 6) AS recall_of_screenable,
  round(tp / (SELECT count(*) FROM customer WHERE c_custkey % 10 = 3), 6) AS recall_of_cohort, round(ap, 6) AS average_precision
FROM k JOIN a USING (screen)"""
)
def screen_evaluation(spark: SparkSession, d: str) -> DataFrame:
    features = screening.screen_features(
        b.sessions(spark, d), b.enriched(spark, d), b.matters(spark, d)
    )
    cohort = b.lawyers(spark, d).where(F.col("lawyer_id") % 10 == 3).select("lawyer_id")
    df = screening.evaluate_screens(screening.score_screens(features), cohort, cohort)
    return rounded(
        df, "precision", "recall_of_screenable", "recall_of_cohort", "average_precision"
    )


@query(
    POLICY_SQL
    + """, cov AS (SELECT lawyer_id, count(*) AS mandatory_outputs, count(*) FILTER (WHERE reviewed) / count(*) AS completion
  FROM enriched WHERE mandatory GROUP BY 1)
SELECT lawyer_id, mandatory_outputs, round(completion, 6) AS completion FROM cov WHERE mandatory_outputs >= 25
ORDER BY cov.completion, lawyer_id LIMIT 20"""
)
def review_top20(spark: SparkSession, d: str) -> DataFrame:
    features = screening.screen_features(
        b.sessions(spark, d), b.enriched(spark, d), b.matters(spark, d)
    ).where(F.col("mandatory_outputs") >= governance.MIN_MANDATORY)
    top = screening.top_list(features, "completion", 20)
    return rounded(top.select("lawyer_id", "mandatory_outputs", "completion"), "completion")


@query(
    """WITH c AS (SELECT c_mktsegment AS l, concat('g', c_nationkey % 5) AS g, count(*) AS n FROM customer GROUP BY 1, 2),
e AS (SELECT a.l, b.g, a.t * b.t / (SELECT sum(n) FROM c) AS e
  FROM (SELECT l, sum(n) AS t FROM c GROUP BY 1) a CROSS JOIN (SELECT g, sum(n) AS t FROM c GROUP BY 1) b)
SELECT round(sum(pow(coalesce(n, 0) - e, 2) / e), 6) AS chi_square,
  CAST((count(DISTINCT l) - 1) * (count(DISTINCT g) - 1) AS BIGINT) AS degrees_of_freedom
FROM e LEFT JOIN c USING (l, g)"""
)
def group_independence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(adoption.group_independence(b.lawyers(spark, d)), "chi_square")


@query(
    with_sql(SESSIONS_SQL, LAWYERS_SQL)
    + """, m AS (SELECT year(activity_date) * 100 + month(activity_date) AS ym, level, count(DISTINCT lawyer_id) AS a
  FROM sessions JOIN lawyers USING (lawyer_id) GROUP BY 1, 2),
p AS (SELECT level, count(*) AS lawyers FROM lawyers WHERE is_active GROUP BY 1)
SELECT level, any_value(lawyers) AS lawyers, round(avg(a), 6) AS mean_monthly_active,
  round(avg(a) / any_value(lawyers), 6) AS adoption FROM p LEFT JOIN m USING (level) GROUP BY 1"""
)
def adoption_plateau(spark: SparkSession, d: str) -> DataFrame:
    df = adoption.adoption_plateau(b.sessions(spark, d), b.lawyers(spark, d), "level")
    return rounded(df, "mean_monthly_active", "adoption")


EXPECTED_SQL = (
    "WITH "
    + STAR_SQL
    + """, acc AS (SELECT count(*) FILTER (WHERE accepted) AS n FROM outputs),
tok AS (SELECT CAST(sum(cost) AS DOUBLE) AS c FROM sessions), lic AS (SELECT CAST(sum(licence_cost) AS DOUBLE) AS c FROM seats),
mon AS (SELECT year(activity_date) * 100 + month(activity_date) AS ym, count(DISTINCT lawyer_id) AS a, count(*) AS n FROM sessions GROUP BY 1),
monl AS (SELECT year(activity_date) * 100 + month(activity_date) AS ym, level, count(DISTINCT lawyer_id) AS a
  FROM sessions JOIN lawyers USING (lawyer_id) GROUP BY 1, 2),
act AS (SELECT count(*) FILTER (WHERE is_active) AS n FROM lawyers),
pt AS (SELECT tool_name, (l + CAST(u.tok AS DOUBLE)) / nullif(u.acc, 0) AS cpa, idle FROM tools
  JOIN (SELECT tool_id, CAST(sum(licence_cost) AS DOUBLE) AS l, count(*) FILTER (WHERE NOT used_in_month) / count(*) AS idle FROM seats GROUP BY 1) USING (tool_id)
  JOIN (SELECT s.tool_id, sum(cost) AS tok, count(*) FILTER (WHERE accepted) AS acc
        FROM sessions s LEFT JOIN outputs USING (session_id) GROUP BY 1) u USING (tool_id)),
tier AS (SELECT m.confidentiality_tier AS t, count(*) AS n FROM sessions JOIN matters m USING (matter_id) GROUP BY 1),
never AS (SELECT level, practice_group, lawyer_id NOT IN (SELECT lawyer_id FROM sessions) AS nv FROM lawyers WHERE is_active),
firsts AS (SELECT lawyer_id, CAST(date_trunc('week', min(activity_date)) AS DATE) AS ws FROM sessions GROUP BY 1),
ret AS (SELECT f.lawyer_id, ws, max(CASE WHEN activity_date >= ws + 28 AND activity_date < ws + 35 THEN 1 ELSE 0 END) AS r
  FROM firsts f JOIN sessions USING (lawyer_id) JOIN lawyers USING (lawyer_id) GROUP BY 1, 2),
v(measure, scope, expected) AS (
  SELECT 'Lawyer Population', 'active lawyers', CAST(n AS DOUBLE) FROM act
  UNION ALL SELECT 'Active Lawyers', 'mean over months', avg(a) FROM mon
  UNION ALL SELECT 'Adoption Rate', 'firm-wide', avg(a) / (SELECT n FROM act) FROM mon
  UNION ALL SELECT 'Adoption Rate', concat('level = ', level), avg(a) / any_value(p.n) FROM monl
    JOIN (SELECT level, count(*) AS n FROM lawyers WHERE is_active GROUP BY 1) p USING (level) GROUP BY level
  UNION ALL SELECT 'Token Cost', 'all time', c FROM tok
  UNION ALL SELECT 'Error Rate', 'all time', count(*) FILTER (WHERE status <> 'Success') / count(*) FROM sessions
  UNION ALL SELECT 'Retry Rate', 'all time', count(*) FILTER (WHERE retry_count > 0) / count(*) FROM sessions
  UNION ALL SELECT 'Accepted Outputs', 'all time', n FROM acc
  UNION ALL SELECT 'Cost per Accepted Output', 'token only, for contrast', tok.c / n FROM tok, acc
  UNION ALL SELECT 'Cost per Accepted Output', 'licence + token', (tok.c + lic.c) / n FROM tok, lic, acc
  UNION ALL SELECT 'Mandatory Review Gap', 'all time', count(*) FROM enriched WHERE mandatory AND NOT reviewed
  UNION ALL SELECT 'Licence Cost', 'all time', c FROM lic
  UNION ALL SELECT 'Idle Licence Cost', 'all time', CAST(sum(licence_cost) AS DOUBLE) FROM seats WHERE NOT used_in_month
  UNION ALL SELECT 'Idle Seat Share', 'all time', count(*) FILTER (WHERE NOT used_in_month) / count(*) FROM seats
  UNION ALL SELECT 'Total AI Cost', 'licence + token', tok.c + lic.c FROM tok, lic
  UNION ALL SELECT 'Cost per Accepted Output', 'WRONG: sum of per-tool ratios', sum(cpa) FROM pt
  UNION ALL SELECT 'Cost per Accepted Output', 'WRONG: mean of per-tool ratios', avg(cpa) FROM pt
  UNION ALL SELECT 'Cost per Accepted Output', concat('tool = ', tool_name), cpa FROM pt
  UNION ALL SELECT 'Idle Seat Share', concat('tool = ', tool_name), idle FROM pt
  UNION ALL SELECT 'Review Coverage', 'mandatory', count(*) FILTER (WHERE reviewed) / count(*) FROM enriched WHERE mandatory
  UNION ALL SELECT 'Review Coverage', concat('tier = ', confidentiality_tier), count(*) FILTER (WHERE reviewed) / count(*)
    FROM enriched WHERE mandatory GROUP BY confidentiality_tier
  UNION ALL SELECT 'Review Coverage', concat('review type = ', review_type), count(*) FILTER (WHERE reviewed) / count(*)
    FROM enriched WHERE mandatory GROUP BY review_type
  UNION ALL SELECT 'p95 Latency', 'successful sessions', quantile_cont(CAST(latency_ms AS DOUBLE), 0.95) FROM sessions WHERE status = 'Success'
  UNION ALL SELECT 'p95 Latency', concat('tool = ', tool_name), quantile_cont(CAST(latency_ms AS DOUBLE), 0.95)
    FROM sessions JOIN tools USING (tool_id) WHERE status = 'Success' GROUP BY tool_name
  UNION ALL SELECT 'Median Edit Distance', concat('area = ', practice_area), quantile_cont(CAST(edit_distance_pct AS DOUBLE), 0.5)
    FROM enriched GROUP BY practice_area
  UNION ALL SELECT 'Governance Exposure', 'all time', sum(n) FILTER (WHERE t <> 'Standard') / sum(n) FROM tier
  UNION ALL SELECT 'Share of Sessions', concat('tier = ', t), n / (SELECT count(*) FROM sessions) FROM tier
  UNION ALL SELECT 'Share of Matters', concat('tier = ', confidentiality_tier), count(*) / (SELECT count(*) FROM matters)
    FROM matters GROUP BY confidentiality_tier
  UNION ALL SELECT 'Never Adopted', concat('level = ', level), count(*) FILTER (WHERE nv) / count(*) FROM never GROUP BY level
  UNION ALL SELECT 'Never Adopted', concat('group = ', practice_group), count(*) FILTER (WHERE nv) / count(*) FROM never GROUP BY practice_group
  UNION ALL SELECT 'Lawyers Never Adopted', 'all time', count(*) FILTER (WHERE nv) FROM never
  UNION ALL SELECT 'Week-4 Retention', 'complete cohorts', sum(r) / count(*) FROM ret WHERE ws + 34 <= (SELECT max(activity_date) FROM sessions)
  UNION ALL SELECT 'Heavy Rework Share', concat('task = ', task_name),
    count(*) FILTER (WHERE accepted AND edit_distance_pct > 40) / nullif(count(*) FILTER (WHERE accepted), 0)
    FROM enriched JOIN tasks USING (task_type_id) GROUP BY task_name
  UNION ALL SELECT 'Sessions per Active Lawyer', concat('month = ', ym), n / a FROM mon)
SELECT measure, scope, round(CAST(expected AS DOUBLE), 6) AS expected FROM v"""
)


@query(EXPECTED_SQL)
def expected_values(spark: SparkSession, d: str) -> DataFrame:
    return rounded(expected.expected_values(b.star(spark, d)), "expected")


@query(
    with_sql(SESSIONS_SQL, OUTPUTS_SQL, MATTERS_SQL, TASKS_SQL, INCIDENTS_SQL)
    + """, v(tbl, rule) AS (
  SELECT 'sessions', 'error_type_iff_not_success' FROM sessions WHERE (error_type IS NOT NULL) <> (status <> 'Success')
  UNION ALL SELECT 'sessions', 'status_domain' FROM sessions WHERE status NOT IN ('Success', 'Timeout', 'Error')
  UNION ALL SELECT 'sessions', 'latency_not_negative' FROM sessions WHERE latency_ms < 0
  UNION ALL SELECT 'matters', 'barrier_group_iff_barrier' FROM matters
    WHERE (barrier_group_id IS NOT NULL) <> (confidentiality_tier = 'Barrier')
  UNION ALL SELECT 'outputs', 'edit_distance_range' FROM outputs WHERE edit_distance_pct NOT BETWEEN 0 AND 100
  UNION ALL SELECT 'tasks', 'policy_domain' FROM tasks WHERE review_policy_base NOT IN ('Mandatory', 'Optional', 'None')
  UNION ALL SELECT 'incidents', 'days_iff_resolved' FROM incidents WHERE (days_to_resolve IS NOT NULL) <> resolved
  UNION ALL SELECT 'lineitem', 'unique_line' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
  UNION ALL SELECT 'lineitem', 'order_exists' FROM (SELECT DISTINCT l_orderkey FROM lineitem)
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'labels', 'document_exists' FROM (SELECT DISTINCT doc_id FROM labels)
    WHERE doc_id NOT IN (SELECT doc_id FROM documents))
SELECT tbl, rule, count(*) AS violations FROM v GROUP BY 1, 2"""
)
def quality_violations(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = b.table(spark, d, "lineitem"), b.table(spark, d, "orders")
    parts = [
        ("sessions", b.sessions(spark, d), checks.session_rules(), "session_id"),
        ("matters", b.matters(spark, d), checks.matter_rules(), "matter_id"),
        ("outputs", b.outputs(spark, d), checks.output_rules(), "output_id"),
        ("tasks", b.tasks(spark, d), checks.task_rules(), "task_type_id"),
        ("incidents", b.incidents(spark, d), checks.incident_rules(), "incident_id"),
    ]
    found = [
        checks.row_violations(df, rules, [key]).select(F.lit(name).alias("tbl"), "rule")
        for name, df, rules, key in parts
    ]
    found.append(
        checks.duplicate_keys(lines, ["l_orderkey", "l_linenumber"]).select(
            F.lit("lineitem").alias("tbl"), F.lit("unique_line").alias("rule")
        )
    )
    found.append(
        checks.missing_references(lines, orders, "l_orderkey", "o_orderkey").select(
            F.lit("lineitem").alias("tbl"), F.lit("order_exists").alias("rule")
        )
    )
    labels, docs = b.table(spark, d, "labels"), b.table(spark, d, "documents")
    found.append(
        checks.missing_references(labels, docs, "doc_id").select(
            F.lit("labels").alias("tbl"), F.lit("document_exists").alias("rule")
        )
    )
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.groupBy("tbl", "rule").agg(F.count(F.lit(1)).alias("violations"))


@query(
    """SELECT CAST(l_shipdate AS DATE) AS day, l_linestatus AS source, count(*) AS rows,
  count(*) FILTER (WHERE o_orderkey IS NULL) AS failures,
  round(count(*) FILTER (WHERE o_orderkey IS NULL) / count(*), 6) AS failure_rate
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT') ON o_orderkey = l_orderkey
GROUP BY 1, 2"""
)
def reference_failures_by_day(spark: SparkSession, d: str) -> DataFrame:
    lines = b.table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_shipdate").cast("date").alias("day"), F.col("l_linestatus").alias("source")
    )
    known = b.table(spark, d, "orders").where(F.col("o_orderpriority") != "1-URGENT")
    df = checks.reference_failure_rate(lines, known, "l_orderkey", ["day", "source"], "o_orderkey")
    return rounded(df, "failure_rate")


COMPARED = expectations.Compared(
    groups=("g1", "g3"), areas=("a1", "a2"), arrangements=("F", "O"), tool=0, long_review="Citation", source="src1"
)


def _expectations_sql() -> str:
    names = [r[0].replace("'", "''") for r in expectations.RANGES]
    one = ORACLES
    values = [
        f"SELECT chi_square FROM ({one['group_independence']})",
        """SELECT max(adoption) FILTER (WHERE practice_group = 'g1') / nullif(max(adoption) FILTER (WHERE practice_group = 'g3'), 0) FROM (
          SELECT practice_group, avg(a) / any_value(n) AS adoption FROM (SELECT year(activity_date) * 100 + month(activity_date) AS ym, practice_group, count(DISTINCT lawyer_id) AS a
            FROM sessions JOIN lawyers USING (lawyer_id) GROUP BY 1, 2) JOIN (SELECT practice_group, count(*) AS n FROM lawyers WHERE is_active GROUP BY 1) USING (practice_group) GROUP BY 1)""",
        "SELECT count(*) FROM enriched WHERE practice_area = 'a1'",
        """SELECT quantile_cont(CAST(edit_distance_pct AS DOUBLE), 0.5) FILTER (WHERE practice_area = 'a1')
          - quantile_cont(CAST(edit_distance_pct AS DOUBLE), 0.5) FILTER (WHERE practice_area = 'a2') FROM enriched""",
        f"SELECT max(estimate_pct) FROM ({one['fe_effect']})",
        f"SELECT max(ci_high_pct) FROM ({one['fe_effect']})",
        f"SELECT max(abs(difference_pct)) FROM ({one['fe_contrasts']}) WHERE group_a = 'F' AND group_b = 'O'",
        f"SELECT min(treated_entries) FROM ({one['fe_effect']})",
        """SELECT (count(*) FILTER (WHERE confidentiality_tier = 'Standard') / count(*)) /
          (SELECT count(*) FILTER (WHERE confidentiality_tier = 'Standard') / count(*) FROM matters) FROM sessions JOIN matters USING (matter_id)""",
        f"""SELECT max(incidents / lawyers) FILTER (WHERE quartile = 1) / greatest(max(incidents / lawyers) FILTER (WHERE quartile = 4), 0.01)
          FROM ({one['coverage_quartile_incidents']})""",
        """SELECT t / (t + l) FROM (
          SELECT CAST((SELECT sum(cost) FROM sessions) AS DOUBLE) AS t, CAST((SELECT sum(licence_cost) FROM seats) AS DOUBLE) AS l)""",
        """SELECT count(*) FROM (SELECT DISTINCT lawyer_id FROM seats WHERE tool_id = 0) h
          WHERE lawyer_id NOT IN (SELECT lawyer_id FROM sessions WHERE tool_id = 0)""",
        "SELECT count(*) FILTER (WHERE NOT used_in_month) / count(*) FROM seats",
        """SELECT quantile_cont(CAST(latency_ms AS DOUBLE), 0.95) FILTER (WHERE tool_id = 0) / quantile_cont(CAST(latency_ms AS DOUBLE), 0.95) FILTER (WHERE tool_id <> 0)
          FROM sessions JOIN tasks USING (task_type_id) WHERE status = 'Success' AND review_type = 'Citation'""",
        "SELECT sum(referential_failures) / nullif(sum(rows_loaded), 0) FROM health WHERE source = 'src1'",
        f"SELECT max(referential_failures / rows_loaded) FROM health WHERE source = 'src1' AND rows_loaded >= {expectations.BUSY}",
        "SELECT count(*) FROM sessions LEFT JOIN matters m USING (matter_id) WHERE m.matter_id IS NULL",
        "SELECT count(*) FILTER (WHERE confidentiality_tier <> 'Standard') / count(*) FROM sessions JOIN matters USING (matter_id)",
        "SELECT count(*) FILTER (WHERE status <> 'Success') / count(*) FROM sessions",
        """SELECT count(*) FILTER (WHERE n = post) / count(*) FROM (SELECT count(*) AS n, count(*) FILTER (WHERE is_post_adoption) AS post
          FROM time WHERE ai_sessions IS NOT NULL GROUP BY lawyer_id, matter_id)""",
    ]
    ends = [
        " AND ".join(
            [f"value {'>=' if closed else '>'} {low}"] * (low is not None) + [f"value {'<=' if closed else '<'} {high}"] * (high is not None)
        )
        for _, low, high, closed in expectations.RANGES
    ]
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, coalesce({e}, false) AS ok, value FROM (SELECT CAST(({v}) AS DOUBLE) AS value)"
        for n, e, v in zip(names, ends, values, strict=True)
    )
    return "WITH " + STAR_SQL + "," + TIME_SQL + f", c AS ({rows}) SELECT check_name, ok, round(value, 6) AS value FROM c"


@query(_expectations_sql())
def expectation_report(spark: SparkSession, d: str) -> DataFrame:
    """Whether the data holds what the reports rely on; several expectations are not met."""
    values = expectations.expectation_values(
        b.star(spark, d), b.time_entries(spark, d), b.incidents(spark, d), b.effect_rows(spark, d), COMPARED, EFFECT_NAMES
    )
    report = expectations.judged(values)
    return report.select(F.col("check").alias("check_name"), "ok", six("value").alias("value"))


@query(
    " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in b.TABLES)
)
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return checks.row_counts({n: b.table(spark, d, n) for n in b.TABLES})


@query(
    """WITH a AS (SELECT doc_id, n_chars AS chars, source FROM documents),
b AS (SELECT doc_id, length(text) AS chars, CASE WHEN lang = 'en' THEN source ELSE upper(source) END AS source FROM documents)
SELECT field, count(*) AS differences FROM (
  SELECT 'chars' AS field FROM a JOIN b USING (doc_id) WHERE a.chars <> b.chars
  UNION ALL SELECT 'source' FROM a JOIN b USING (doc_id) WHERE a.source <> b.source) GROUP BY 1"""
)
def reconcile_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = b.table(spark, d, "documents")
    left = docs.select("doc_id", F.col("n_chars").cast("long").alias("chars"), "source")
    shown = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.upper("source"))
    right = docs.select("doc_id", F.length("text").cast("long").alias("chars"), shown.alias("source"))
    diff = checks.reconcile(left, right, ["doc_id"])
    return diff.groupBy("field").agg(F.count(F.lit(1)).alias("differences"))
