"""Projections of the given tables onto the schemas the operators read, each with the
same projection in SQL for the side-by-side check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import enrich_outputs
from ..operators.adoption import month_spine, post_adoption_flag
from ..operators.alerts import Star
from ..operators.cost import seat_usage
from ..operators.feeds import feed_runs, feed_health


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, six(name))
    return df


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def sessions(spark: SparkSession, d: str, over_months: bool = False) -> DataFrame:
    """``over_months``: accepted work lies in the first two months, the rest in five."""
    n_matters = table(spark, d, "part").agg(F.count(F.lit(1))).scalar()
    k = props_k()
    rows = session_columns(table(spark, d, "events"), n_matters, k)
    if not over_months:
        return rows
    accepted = F.col("event_type").isin("purchase", "signup")
    months = F.when(accepted, F.col("session_id") % 2).otherwise(F.col("session_id") % 5)
    return rows.withColumn("activity_date", F.date_add("activity_date", (months * 31).cast("int")))


def over_months_sql(sql: str) -> str:
    """The same of a text that uses SESSIONS_SQL and MATTERS_SQL."""
    day, tier = "CAST(ts AS DATE) AS activity_date", "p_partkey % 20 IN (1, 2)"
    assert day in sql and tier in sql
    months = "CASE WHEN event_type IN ('purchase', 'signup') THEN event_id % 2 ELSE event_id % 5 END"
    spread = sql.replace(day, f"CAST(ts AS DATE) + CAST(31 * ({months}) AS INT) AS activity_date")
    return spread.replace(tier, "p_partkey % 20 BETWEEN 1 AND 5")


def session_columns(events: DataFrame, n_matters: Column, k: Column) -> DataFrame:
    error = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("session_id"),
        F.col("user_id").alias("lawyer_id"),
        F.pmod(F.col("user_id") * 7 + (F.col("event_id") % 5) * 30, n_matters).alias("matter_id"),
        (F.col("event_id") % 5).cast("int").alias("tool_id"),
        (F.col("event_id") % 25).cast("int").alias("task_type_id"),
        F.col("ts").cast("date").alias("activity_date"),
        F.col("ts").cast("timestamp").alias("started_at"),
        (F.col("value").cast("decimal(12,2)") * F.lit("0.001").cast("decimal(4,3)"))
        .cast("decimal(16,5)")
        .alias("cost"),
        F.round(F.col("value") * 100).cast("long").alias("latency_ms"),
        F.when(error, "Error").otherwise("Success").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("retry_count"),
        F.when(error & (k != 0), "ServiceError").alias("error_type"),
        "event_type",
        k.alias("k"),
    )


SESSIONS_SQL = """
sessions AS (
  SELECT event_id AS session_id, user_id AS lawyer_id,
    (user_id * 7 + (event_id % 5) * 30) % (SELECT count(*) FROM part) AS matter_id,
    CAST(event_id % 5 AS INT) AS tool_id, CAST(event_id % 25 AS INT) AS task_type_id,
    CAST(ts AS DATE) AS activity_date, ts AS started_at,
    CAST(value AS DECIMAL(12,2)) * CAST('0.001' AS DECIMAL(4,3)) AS cost,
    CAST(round(value * 100) AS BIGINT) AS latency_ms,
    CASE event_type WHEN 'error' THEN 'Error' ELSE 'Success' END AS status,
    CAST(event_id % 4 AS INT) AS retry_count,
    CASE WHEN event_type = 'error' AND CAST(regexp_extract(props, '[0-9]+') AS INT) <> 0
         THEN 'ServiceError' END AS error_type,
    event_type, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k
  FROM events)"""


def outputs(spark: SparkSession, d: str, over_months: bool = False) -> DataFrame:
    reviewed = (F.col("session_id") * 13 + F.col("lawyer_id") * F.col("lawyer_id")) % 100 < (
        30 + F.col("lawyer_id") % 60
    )
    return (
        sessions(spark, d, over_months)
        .where(F.col("status") == "Success")
        .select(
            F.col("session_id").alias("output_id"),
            "session_id",
            "lawyer_id",
            "matter_id",
            "tool_id",
            "task_type_id",
            "activity_date",
            F.col("event_type").isin("purchase", "signup").alias("accepted"),
            F.col("k").cast("decimal(5,1)").alias("edit_distance_pct"),
            (F.col("event_type") == "click").alias("is_client_facing"),
            reviewed.alias("reviewed"),
        )
    )


OUTPUTS_SQL = """
outputs AS (
  SELECT session_id AS output_id, session_id, lawyer_id, matter_id, tool_id, task_type_id,
    activity_date, event_type IN ('purchase', 'signup') AS accepted,
    CAST(k AS DECIMAL(5,1)) AS edit_distance_pct, event_type = 'click' AS is_client_facing,
    (session_id * 13 + lawyer_id * lawyer_id) % 100 < 30 + lawyer_id % 60 AS reviewed
  FROM sessions WHERE status = 'Success')"""


def lawyers(spark: SparkSession, d: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, d, "customer").select(
        key.alias("lawyer_id"),
        F.col("c_mktsegment").alias("level"),
        F.concat(F.lit("g"), (nation % 5).cast("string")).alias("practice_group"),
        F.concat(F.lit("o"), (nation % 4).cast("string")).alias("office"),
        (300 + key % 9 * 100).cast("decimal(9,2)").alias("rate"),
        (key % 25 != 0).alias("is_active"),
    )


LAWYERS_SQL = """
lawyers AS (
  SELECT c_custkey AS lawyer_id, c_mktsegment AS level, concat('g', c_nationkey % 5) AS practice_group,
    concat('o', c_nationkey % 4) AS office, CAST(300 + c_custkey % 9 * 100 AS DECIMAL(9,2)) AS rate,
    c_custkey % 25 <> 0 AS is_active
  FROM customer)"""


def matters(spark: SparkSession, d: str, over_months: bool = False) -> DataFrame:
    key = F.col("p_partkey")
    slot = key % 20
    restricted = slot.between(1, 5) if over_months else slot.isin(1, 2)
    tier = F.when(slot == 0, "Barrier").when(restricted, "Restricted").otherwise("Standard")
    fee = F.when(key % 3 == 0, "Hourly").when(key % 3 == 1, "Fixed Fee").otherwise("Capped")
    return table(spark, d, "part").select(
        key.alias("matter_id"),
        tier.alias("confidentiality_tier"),
        F.when(slot == 0, key % 8).alias("barrier_group_id"),
        F.concat(F.lit("a"), (key % 5).cast("string")).alias("practice_area"),
        fee.alias("fee_arrangement"),
    )


MATTERS_SQL = """
matters AS (
  SELECT p_partkey AS matter_id,
    CASE WHEN p_partkey % 20 = 0 THEN 'Barrier' WHEN p_partkey % 20 IN (1, 2) THEN 'Restricted'
         ELSE 'Standard' END AS confidentiality_tier,
    CASE WHEN p_partkey % 20 = 0 THEN p_partkey % 8 END AS barrier_group_id,
    concat('a', p_partkey % 5) AS practice_area,
    CASE p_partkey % 3 WHEN 0 THEN 'Hourly' WHEN 1 THEN 'Fixed Fee' ELSE 'Capped' END AS fee_arrangement
  FROM part)"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    region = F.col("n_regionkey")
    base = F.when(region == 0, "Mandatory").when(region == 1, "None").otherwise("Optional")
    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("task_type_id"),
        F.col("n_name").alias("task_name"),
        base.alias("review_policy_base"),
        F.when(region % 2 == 0, "Citation").otherwise("Full").alias("review_type"),
    )


TASKS_SQL = """
tasks AS (
  SELECT n_nationkey AS task_type_id, n_name AS task_name,
    CASE n_regionkey WHEN 0 THEN 'Mandatory' WHEN 1 THEN 'None' ELSE 'Optional' END AS review_policy_base,
    CASE WHEN n_regionkey % 2 = 0 THEN 'Citation' ELSE 'Full' END AS review_type
  FROM nation)"""


def tools(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("r_regionkey")
    return table(spark, d, "region").select(
        key.alias("tool_id"),
        F.col("r_name").alias("tool_name"),
        F.date_add(F.lit("2023-10-01").cast("date"), key * 10).alias("deployment_date"),
        (45 + key * 30).cast("decimal(9,2)").alias("licence_cost"),
    )


TOOLS_SQL = """
tools AS (
  SELECT r_regionkey AS tool_id, r_name AS tool_name,
    DATE '2023-10-01' + CAST(r_regionkey * 10 AS INT) AS deployment_date,
    CAST(45 + r_regionkey * 30 AS DECIMAL(9,2)) AS licence_cost
  FROM region)"""


def enriched(spark: SparkSession, d: str, over_months: bool = False) -> DataFrame:
    return enrich_outputs(outputs(spark, d, over_months), tasks(spark, d), matters(spark, d, over_months))


ENRICHED_SQL = """
enriched AS (
  SELECT *, driver <> 'Not required' AS mandatory FROM (
    SELECT o.*, t.review_type, m.confidentiality_tier, m.practice_area, m.barrier_group_id,
      CASE WHEN t.review_policy_base = 'Mandatory' THEN 'Task type'
           WHEN m.confidentiality_tier IN ('Restricted', 'Barrier') THEN 'Confidentiality tier'
           WHEN o.is_client_facing THEN 'Client-facing output' ELSE 'Not required' END AS driver
    FROM outputs o JOIN tasks t USING (task_type_id) JOIN matters m USING (matter_id)))"""


def seats(spark: SparkSession, d: str, over_months: bool = False) -> DataFrame:
    """Active lawyers x tools x months. The tool table is a fixed handful of rows."""
    tool_list = (
        tools(spark, d).agg(F.collect_list(F.struct("tool_id", "licence_cost"))).scalar()
    )
    used = sessions(spark, d, over_months)
    months = month_spine(used, "activity_date")
    allocated = (
        lawyers(spark, d)
        .where(F.col("is_active"))
        .select("lawyer_id", F.explode(tool_list).alias("t"))
        .select("lawyer_id", "t.*", F.explode(months).alias("m"))
        .select(
            "lawyer_id", "tool_id", "licence_cost", F.lit(1).alias("seats"), F.trunc("m", "month").alias("month")
        )
    )
    return seat_usage(allocated, used)


SEATS_SQL = """
months AS (
  SELECT DISTINCT CAST(date_trunc('month', activity_date) AS DATE) AS month FROM sessions),
seats AS (
  SELECT l.lawyer_id, t.tool_id, t.licence_cost, 1 AS seats, m.month,
    EXISTS (SELECT 1 FROM sessions s WHERE s.lawyer_id = l.lawyer_id AND s.tool_id = t.tool_id
            AND date_trunc('month', s.activity_date) = m.month) AS used_in_month
  FROM lawyers l CROSS JOIN tools t CROSS JOIN months m WHERE l.is_active)"""


def session_feed(spark: SparkSession, d: str, over_months: bool = False) -> tuple[DataFrame, DataFrame]:
    """Feed runs of the sessions per source, and the go-live day of each source."""
    source = F.concat(F.lit("src"), (F.col("tool_id") % 3).cast("string"))
    loads = sessions(spark, d, over_months).select(
        source.alias("source"), F.col("activity_date").alias("run_date"), "k"
    )
    return _feed(loads, F.col("k") >= 98)


def line_feed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Feed runs of order lines: a return of a large quantity counts as rejected."""
    loads = table(spark, d, "lineitem").select(
        F.concat(F.lit("src"), (F.col("l_suppkey") % 3).cast("string")).alias("source"),
        F.col("l_shipdate").cast("date").alias("run_date"),
        "l_returnflag",
        "l_quantity",
    )
    return _feed(loads, (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))


def _feed(loads: DataFrame, rejected: Column) -> tuple[DataFrame, DataFrame]:
    last = loads.agg(F.max("run_date")).scalar()
    first = loads.agg(F.min("run_date")).scalar()
    live = loads.groupBy("source").agg(F.min("run_date").alias("live_from"))
    spans = live.select("source", first.alias("first_day"), last.alias("last_day"))
    return feed_runs(loads, loads.where(rejected), spans), live


def feed_sql(loads: str, rejected: str) -> str:
    return f"""
loads AS ({loads}),
days AS (SELECT CAST(unnest(generate_series(min(run_date), max(run_date), INTERVAL 1 DAY)) AS DATE) AS run_date
         FROM loads),
live AS (SELECT source, min(run_date) AS live_from FROM loads GROUP BY source),
counted AS (SELECT source, run_date, count(*) AS n,
              count(*) FILTER (WHERE {rejected}) AS bad FROM loads GROUP BY 1, 2),
runs AS (
  SELECT l.source, d.run_date, coalesce(c.n, 0) - coalesce(c.bad, 0) AS rows_loaded,
    coalesce(c.bad, 0) AS rows_rejected, coalesce(c.bad, 0) AS referential_failures, l.live_from
  FROM live l CROSS JOIN days d LEFT JOIN counted c ON c.source = l.source AND c.run_date = d.run_date),
h1 AS (
  SELECT *, isodow(run_date) <= 5 AND run_date >= live_from AS is_expected_active,
    avg(rows_loaded) OVER (PARTITION BY source ORDER BY run_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
      AS trailing_mean,
    max(CASE WHEN rows_loaded > 0 THEN run_date END) OVER (PARTITION BY source ORDER BY run_date) AS last_good_run
  FROM runs),
health AS (
  SELECT *, referential_failures / nullif(rows_loaded + rows_rejected, 0) AS referential_failure_rate,
    rows_loaded / nullif(trailing_mean, 0) AS load_vs_trailing_mean,
    date_diff('day', last_good_run, (SELECT max(run_date) FROM runs)) * 24 AS hours_since_good_run,
    rows_loaded = 0 AND is_expected_active AND coalesce(trailing_mean, 0) >= 20 AS is_unexpected_zero_load
  FROM h1)"""


SESSION_FEED_SQL = feed_sql(
    "SELECT concat('src', tool_id % 3) AS source, activity_date AS run_date, k FROM sessions", "k >= 98"
)
LINE_FEED_SQL = feed_sql(
    "SELECT concat('src', l_suppkey % 3) AS source, CAST(l_shipdate AS DATE) AS run_date, "
    "l_returnflag, l_quantity FROM lineitem",
    "l_returnflag = 'R' AND l_quantity > 45",
)


def star(spark: SparkSession, d: str, over_months: bool = False) -> Star:
    runs, live = session_feed(spark, d, over_months)
    return Star(
        sessions=sessions(spark, d, over_months),
        outputs=enriched(spark, d, over_months),
        lawyers=lawyers(spark, d),
        matters=matters(spark, d, over_months),
        tools=tools(spark, d),
        tasks=tasks(spark, d),
        seats=seats(spark, d, over_months),
        health=feed_health(runs, live),
    )


STAR_SQL = ",".join(
    [
        SESSIONS_SQL,
        OUTPUTS_SQL,
        LAWYERS_SQL,
        MATTERS_SQL,
        TASKS_SQL,
        TOOLS_SQL,
        ENRICHED_SQL,
        SEATS_SQL,
        SESSION_FEED_SQL,
    ]
)


def with_sql(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def time_entries(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as time lines; positions 5 and 6 are matters without sessions."""
    n_matters = table(spark, d, "part").agg(F.count(F.lit(1))).scalar()
    lawyer = F.col("l_suppkey")
    lines = table(spark, d, "lineitem").select(
        lawyer.alias("lawyer_id"),
        F.pmod(lawyer * 7 + (F.col("l_linenumber") % 7) * 30, n_matters).alias("matter_id"),
        F.date_add(F.lit("2023-12-15").cast("date"), F.dayofmonth("l_shipdate")).alias("entry_date"),
        (F.col("l_quantity").cast("decimal(9,2)") * F.lit("0.1").cast("decimal(2,1)"))
        .cast("decimal(12,3)")
        .alias("hours"),
        (F.col("l_returnflag") != "R").alias("billable"),
    )
    return post_adoption_flag(lines, sessions(spark, d))


TIME_SQL = """
pairs AS (
  SELECT lawyer_id, matter_id, count(*) AS ai_sessions, min(activity_date) AS first_session
  FROM sessions GROUP BY 1, 2 HAVING count(*) >= 3),
lines AS (
  SELECT l_suppkey AS lawyer_id,
    (l_suppkey * 7 + (l_linenumber % 7) * 30) % (SELECT count(*) FROM part) AS matter_id,
    DATE '2023-12-15' + CAST(day(l_shipdate) AS INT) AS entry_date,
    CAST(l_quantity AS DECIMAL(9,2)) * CAST('0.1' AS DECIMAL(2,1)) AS hours,
    l_returnflag <> 'R' AS billable
  FROM lineitem),
time AS (
  SELECT l.*, p.ai_sessions, p.first_session, coalesce(l.entry_date >= p.first_session, false) AS is_post_adoption
  FROM lines l LEFT JOIN pairs p USING (lawyer_id, matter_id))"""

# Effect table used where a query needs given estimates.
ESTIMATES = [
    ("Capped", -8.94, -12.0, -5.8),
    ("Fixed Fee", -14.31, -17.0, -11.5),
    ("Hourly", -8.33, -11.0, -5.6),
]


def estimates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ESTIMATES, "fee_arrangement string, estimate_pct double, ci_low_pct double, ci_high_pct double"
    )


ESTIMATES_SQL = """
estimates(fee_arrangement, estimate_pct, ci_low_pct, ci_high_pct) AS (VALUES
  ('Capped', CAST(-8.94 AS DOUBLE), CAST(-12.0 AS DOUBLE), CAST(-5.8 AS DOUBLE)),
  ('Fixed Fee', CAST(-14.31 AS DOUBLE), CAST(-17.0 AS DOUBLE), CAST(-11.5 AS DOUBLE)),
  ('Hourly', CAST(-8.33 AS DOUBLE), CAST(-11.0 AS DOUBLE), CAST(-5.6 AS DOUBLE)))"""


def incidents(spark: SparkSession, d: str) -> DataFrame:
    resolved = F.col("k") % 2 == 0
    return (
        sessions(spark, d)
        .where((F.col("status") == "Error") & (F.col("k") >= 50))
        .select(
            F.col("session_id").alias("incident_id"),
            "lawyer_id",
            "matter_id",
            F.col("activity_date").alias("incident_date"),
            F.concat(F.lit("type"), (F.col("session_id") % 3).cast("string")).alias("incident_type"),
            (1 + F.col("session_id") % 4).cast("int").alias("severity"),
            resolved.alias("resolved"),
            F.when(resolved, F.col("k") % 10).alias("days_to_resolve"),
        )
    )


INCIDENTS_SQL = """
incidents AS (
  SELECT session_id AS incident_id, lawyer_id, matter_id, activity_date AS incident_date,
    concat('type', session_id % 3) AS incident_type, CAST(1 + session_id % 4 AS INT) AS severity,
    k % 2 = 0 AS resolved, CASE WHEN k % 2 = 0 THEN k % 10 END AS days_to_resolve
  FROM sessions WHERE status = 'Error' AND k >= 50)"""


def effect_rows(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as rows of the effect model."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"
    )
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_shipdate", "l_linestatus"
    )
    treated = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 60 days")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_extendedprice").alias("y"),
        treated.cast("int").alias("arm"),
        F.col("o_orderstatus").alias("grp"),
        F.concat_ws("/", "o_orderstatus", "o_orderpriority", "l_linestatus").alias("cell"),
        F.col("o_custkey").alias("cluster"),
    )


EFFECT_SQL = """
raw AS (
  SELECT l_extendedprice AS y, CASE WHEN l_shipdate > o_orderdate + INTERVAL 60 DAY THEN 1 ELSE 0 END AS arm,
    o_orderstatus AS grp, concat_ws('/', o_orderstatus, o_orderpriority, l_linestatus) AS cell,
    o_custkey AS cluster
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (
  SELECT ln(y) AS y, CAST(arm AS DOUBLE) AS t, grp, cell, cluster FROM raw
  WHERE y > 0 AND cell IN (SELECT cell FROM raw WHERE y > 0 GROUP BY cell
                           HAVING sum(arm) >= 40 AND count(*) - sum(arm) >= 40)),
c AS (
  SELECT *, t - avg(t) OVER (PARTITION BY cell) AS tc, y - avg(y) OVER (PARTITION BY cell) AS yc FROM d),
beta AS (
  SELECT grp, sum(tc * yc) / sum(tc * tc) AS b, sum(tc * tc) AS d2, CAST(sum(t) AS BIGINT) AS treated,
    CAST(sum(1 - t) AS BIGINT) AS control FROM c GROUP BY grp),
score AS (
  SELECT c.cluster, c.grp, sum(c.tc * (c.yc - beta.b * c.tc)) / any_value(beta.d2) AS u
  FROM c JOIN beta USING (grp) GROUP BY 1, 2),
size AS (
  SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT cell) AS DOUBLE) AS k,
    CAST(count(DISTINCT grp) AS DOUBLE) AS g, CAST(count(DISTINCT cluster) AS DOUBLE) AS cl FROM d),
cov AS (
  SELECT a.grp AS ga, b.grp AS gb,
    sum(a.u * b.u) * (any_value(cl) / (any_value(cl) - 1))
      * ((any_value(n) - 1) / (any_value(n) - any_value(k) - any_value(g))) AS v
  FROM score a JOIN score b USING (cluster) CROSS JOIN size GROUP BY 1, 2)"""
