"""Fixed-effects effect estimate with cluster-robust intervals, from grouped sums.

Model: log(y) ~ cell effects + treatment per group, where a cell lies in one group.
After centring inside the cells the treatment columns of different groups are
orthogonal, so every estimate and every cluster score follows from four sums per
(cell, cluster): no matrix, one pass over the rows, partial sums on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ..session import cut_lineage

Z95 = 1.96
MIN_CELL = 40
NON_ADOPTER_MAX = 20


def assign_arms(
    time: DataFrame, sessions: DataFrame, max_control_sessions: int = NON_ADOPTER_MAX
) -> DataFrame:
    """``arm`` 1 = post-adoption line, 0 = line outside assisted pairs of a lawyer with
    fewer than ``max_control_sessions`` sessions (none included), -1 = left out.

    ``time`` carries ``ai_sessions`` and ``is_post_adoption``.
    """
    counts = sessions.groupBy("lawyer_id").agg(F.count(F.lit(1)).alias("__sessions"))
    adopters = counts.where(F.col("__sessions") >= max_control_sessions).select(
        "lawyer_id", F.lit(True).alias("__adopter")
    )
    control = F.col("ai_sessions").isNull() & F.col("__adopter").isNull()
    return (
        time.join(adopters, "lawyer_id", "left")
        .withColumn("arm", F.when(F.col("is_post_adoption"), 1).when(control, 0).otherwise(-1))
        .drop("__adopter")
    )


def assign_contaminated_arms(time: DataFrame) -> DataFrame:
    """The control of the sensitivity check: every line outside assisted pairs."""
    return time.withColumn(
        "arm",
        F.when(F.col("is_post_adoption"), 1)
        .when(F.col("ai_sessions").isNull(), 0)
        .otherwise(-1),
    )


def _moments(df, y, arm, group, cell, cluster, min_cell) -> tuple[DataFrame, DataFrame]:
    """Sums per (cell, cluster) of the kept cells, and the cell means joined to them."""
    rows = df.where((F.col(arm) >= 0) & (F.col(y) > 0)).select(
        F.col(group).alias("group"),
        F.col(cell).alias("cell"),
        F.col(cluster).alias("cluster"),
        F.col(arm).cast("double").alias("t"),
        F.log(y).alias("y"),
    )
    sums = rows.groupBy("group", "cell", "cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("t").alias("st"),
        F.sum("y").alias("sy"),
        F.sum(F.col("t") * F.col("y")).alias("sty"),
    )
    # the estimate reads these sums several times; the rows behind them only once
    sums = cut_lineage(sums)
    # a group of cells is a function of the cell; a cell in two groups stops the job
    cells = (
        sums.groupBy("cell")
        .agg(
            F.sum("n").alias("cn"),
            F.sum("st").alias("ct"),
            F.sum("sy").alias("cy"),
            F.min("group").alias("g0"),
            F.max("group").alias("g1"),
        )
        .where((F.col("ct") >= min_cell) & (F.col("cn") - F.col("ct") >= min_cell))
        .withColumn(
            "mean_t",
            F.when(F.col("g0") == F.col("g1"), F.col("ct") / F.col("cn")).otherwise(
                F.raise_error(F.lit("a cell lies in more than one group")).cast("double")
            ),
        )
        .withColumn("mean_y", F.col("cy") / F.col("cn"))
        .select("cell", "mean_t", "mean_y")
    )
    n, mt, my = F.col("n"), F.col("mean_t"), F.col("mean_y")
    centred = (
        sums.join(cells, "cell")
        # t is 0/1, so its square is itself
        .withColumn("tt", F.col("st") * (1 - 2 * mt) + n * mt * mt)
        .withColumn("ty", F.col("sty") - mt * F.col("sy") - my * F.col("st") + n * mt * my)
    )
    return centred, cells


def fe_effect(
    df: DataFrame,
    y: str = "hours",
    arm: str = "arm",
    group: str = "fee_arrangement",
    cell: str = "cell",
    cluster: str = "lawyer_id",
    min_cell: int = MIN_CELL,
) -> DataFrame:
    """One row per group: effect in percent, 95% interval, standard error, counts."""
    centred, cells = _moments(df, y, arm, group, cell, cluster, min_cell)
    covariance = _covariance(centred, cells)
    own = covariance.where(F.col("group_a") == F.col("group_b")).select(
        F.col("group_a").alias("group"), "variance"
    )
    beta = _coefficients(centred)
    meta = _sizes(centred, cells)
    se = F.sqrt("variance")
    b = F.col("beta")

    def percent(value):
        return (F.exp(value) - 1) * 100

    return (
        beta.join(own, "group")
        .withColumn("meta", meta)
        .select(
            F.col("group").alias(group),
            percent(b).alias("estimate_pct"),
            percent(b - Z95 * se).alias("ci_low_pct"),
            percent(b + Z95 * se).alias("ci_high_pct"),
            (se * 100).alias("se_pct"),
            "treated_entries",
            "control_entries",
            F.col("meta.cells").alias("n_cells"),
            F.col("meta.clusters").alias("n_clusters"),
        )
    )


def _coefficients(centred: DataFrame) -> DataFrame:
    return centred.groupBy("group").agg(
        F.try_divide(F.sum("ty"), F.sum("tt")).alias("beta"),
        F.sum("tt").alias("d"),
        F.sum("st").cast("long").alias("treated_entries"),
        F.sum(F.col("n") - F.col("st")).cast("long").alias("control_entries"),
    )


def _sizes(centred: DataFrame, cells: DataFrame):
    return centred.agg(
        F.struct(
            F.sum("n").cast("double").alias("rows"),
            F.countDistinct("cell").cast("double").alias("cells"),
            F.countDistinct("group").cast("double").alias("groups"),
            F.countDistinct("cluster").cast("double").alias("clusters"),
        )
    ).scalar()


def _covariance(centred: DataFrame, cells: DataFrame) -> DataFrame:
    beta = _coefficients(centred).select("group", "beta", "d")
    scores = (
        centred.join(beta, "group")
        .groupBy("cluster", "group", "d")
        .agg(F.sum(F.col("ty") - F.col("beta") * F.col("tt")).alias("score"))
        .select("cluster", "group", (F.col("score") / F.col("d")).alias("u"))
    )
    # groups are the few categories of the model; a cluster has one row per group
    left = scores.select("cluster", F.col("group").alias("group_a"), F.col("u").alias("ua"))
    right = scores.select("cluster", F.col("group").alias("group_b"), F.col("u").alias("ub"))
    s = _sizes(centred, cells)
    factor = (s["clusters"] / (s["clusters"] - 1)) * (
        (s["rows"] - 1) / (s["rows"] - s["cells"] - s["groups"])
    )
    return (
        left.join(right, "cluster")
        .groupBy("group_a", "group_b")
        .agg(F.sum(F.col("ua") * F.col("ub")).alias("v"))
        .select("group_a", "group_b", (F.col("v") * factor).alias("variance"))
    )


def pairwise_contrasts(
    df: DataFrame,
    y: str = "hours",
    arm: str = "arm",
    group: str = "fee_arrangement",
    cell: str = "cell",
    cluster: str = "lawyer_id",
    min_cell: int = MIN_CELL,
) -> DataFrame:
    """exp(b_a - b_b) - 1 for every pair of groups; distinguishable when the interval
    leaves zero out."""
    centred, cells = _moments(df, y, arm, group, cell, cluster, min_cell)
    covariance = _covariance(centred, cells)
    beta = _coefficients(centred).select("group", "beta")
    a = beta.select(F.col("group").alias("group_a"), F.col("beta").alias("beta_a"))
    b = beta.select(F.col("group").alias("group_b"), F.col("beta").alias("beta_b"))
    var = covariance.where(F.col("group_a") == F.col("group_b"))
    var_a = var.select("group_a", F.col("variance").alias("va"))
    var_b = var.select("group_b", F.col("variance").alias("vb"))
    # the groups are the few categories of the model
    groups = beta.agg(F.array_sort(F.collect_set("group"))).scalar()
    pairs = (
        a.withColumn("group_b", F.explode(groups))
        .where(F.col("group_a") < F.col("group_b"))
        .join(covariance, ["group_a", "group_b"], "left")
        .fillna(0.0, ["variance"])
        .join(b, "group_b")
        .join(var_a, "group_a")
        .join(var_b, "group_b")
    )
    diff = F.col("beta_a") - F.col("beta_b")
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("va") + F.col("vb") - 2 * F.col("variance")))
    out = pairs.select(
        "group_a",
        "group_b",
        ((F.exp(diff) - 1) * 100).alias("difference_pct"),
        ((F.exp(diff - Z95 * se) - 1) * 100).alias("ci_low_pct"),
        ((F.exp(diff + Z95 * se) - 1) * 100).alias("ci_high_pct"),
    )
    return out.withColumn(
        "is_distinguishable", F.col("ci_low_pct") * F.col("ci_high_pct") > 0
    )


def control_sensitivity(
    time: DataFrame, sessions: DataFrame, max_control_sessions: int = NON_ADOPTER_MAX, **names
) -> DataFrame:
    """The same fit with the clean and with the contaminated control."""
    clean = fe_effect(assign_arms(time, sessions, max_control_sessions), **names).withColumn(
        "control", F.lit("never adopted")
    )
    mixed = fe_effect(assign_contaminated_arms(time), **names).withColumn(
        "control", F.lit("same lawyers")
    )
    return clean.unionByName(mixed)
