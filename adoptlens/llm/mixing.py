"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells, one for each combination of source, language and topic that
occurs. Raking multiplies the cells' token weights by one dimension after the other until
all three marginals meet their targets, and leaves the rest of the mix as it is. A cell's
raked over its natural weight is how much more of it the mix wants; documents are sampled
with probabilities in that proportion, the largest of them 1, so nothing is repeated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adoptlens.session import cut_lineage, release

DIMENSIONS = ("source", "lang", "topic")
#: Rounds end when no marginal is further from its target than this share of it. Targets
#: that the cells can't meet, as where a category occurs in one cell only, end by number.
TOLERANCE, MOST_ROUNDS = 1e-12, 500
#: A mix is on target when the error that was reached is no more than this.
ON_TARGET = 1e-6
#: Cells that are raked on the driver; more are raked on Spark, by the same steps.
DRIVER_CELLS = 100_000
DIGITS = 9


def words(text: Column) -> Column:
    """Words of a text, its weight in tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tempered(marginal: dict, power: float) -> dict:
    """Target shares in proportion to a power of the natural ones: 1 keeps them, 0 makes
    all that occur equal."""
    raised = {k: v**power if v else 0.0 for k, v in marginal.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()} if total else raised


def _error(now: np.ndarray, target: np.ndarray) -> float:
    wanted = target > 0
    return float(np.max(np.abs(now[wanted] / target[wanted] - 1), initial=0.0))


def rake(
    tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray],
    tolerance: float = TOLERANCE, most: int | None = None,
) -> tuple[np.ndarray, float]:
    """Weights of the cells, in sum 1, and the largest relative error of a marginal.
    ``codes`` has the category of each cell in each dimension, ``targets`` the shares of
    its categories."""
    weight, error = tokens / tokens.sum(), 1.0
    for _ in range(most or MOST_ROUNDS):
        for code, target in zip(codes, targets):
            now = np.bincount(code, weight, minlength=len(target))
            factor = np.divide(target, now, out=np.zeros(len(target)), where=now > 0)
            weight = weight * factor[code]
        error = max(_error(np.bincount(c, weight, minlength=len(t)), t) for c, t in zip(codes, targets))
        if error <= tolerance:
            break
    return weight, error


def cell_probabilities(cells: list, powers: dict[str, float], targets: dict[str, dict] | None = None) -> list[tuple]:
    """(source, lang, topic, probability, on_target) from (source, lang, topic, tokens).
    ``targets`` has shares by category for dimensions that don't follow a power of the
    natural ones; a category that they don't name gets none."""
    tokens = np.array([c[3] for c in cells], dtype=float)
    if not tokens.sum():
        return [(*c[:3], 1.0, True) for c in cells]
    codes, shares = [], []
    for d, name in enumerate(DIMENSIONS):
        marginal: dict = {}
        for c in cells:
            marginal[c[d]] = marginal.get(c[d], 0) + c[3]
        wanted = (targets or {}).get(name) or tempered(marginal, powers.get(name, 1.0))
        number = {k: i for i, k in enumerate(marginal)}
        share = np.array([wanted.get(k, 0.0) if marginal[k] else 0.0 for k in marginal])
        codes.append(np.array([number[c[d]] for c in cells]))
        shares.append(share / share.sum() if share.sum() else share)
    weight, error = rake(tokens, codes, shares)
    ratio = np.divide(weight, tokens, out=np.zeros(len(cells)), where=tokens > 0)
    chance = np.where(tokens > 0, ratio / ratio.max() if ratio.max() else 0.0, 1.0)
    met = error <= ON_TARGET
    return [(*c[:3], float(round(p, DIGITS)), met) for c, p in zip(cells, chance)]


def _meet(cells: DataFrame, dimension: str, side: DataFrame) -> DataFrame:
    """Cells with the columns of ``side``, one row per category ``__k``; null meets null."""
    return cells.join(side, F.col(dimension).eqNullSafe(F.col("__k"))).drop("__k")


def cell_probabilities_on_spark(cells: DataFrame, powers: dict[str, float], targets: dict[str, dict] | None = None) -> DataFrame:
    """The same from a table of cells, for any number of them. A round is written; the
    driver sees its error."""
    spark = cells.sparkSession
    shares = {}
    for name in DIMENSIONS:
        marginal = cells.groupBy(F.col(name).alias("__k")).agg(F.sum("tokens").cast("double").alias("n"))
        if (targets or {}).get(name):
            wanted = spark.createDataFrame(list(targets[name].items()), "__c string, share double")
            marginal = marginal.join(wanted, F.col("__k").eqNullSafe(F.col("__c")), "left")
            marginal = marginal.select("__k", F.when(F.col("n") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("share"))
        else:
            marginal = marginal.select("__k", F.when(F.col("n") > 0, F.pow("n", F.lit(powers.get(name, 1.0)))).otherwise(0.0).alias("share"))
        whole = marginal.agg(F.sum("share").alias("s")).first()["s"] or 1.0
        shares[name] = cut_lineage(marginal.withColumn("share", F.col("share") / F.lit(whole)))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.select(*DIMENSIONS, F.lit(1.0).alias("probability"), F.lit(True).alias("met"))
    now, error = cut_lineage(cells.withColumn("w", F.col("tokens") / F.lit(total))), 1.0
    for _ in range(MOST_ROUNDS):
        step = now
        for name in DIMENSIONS:
            sums = step.groupBy(F.col(name).alias("__own")).agg(F.sum("w").alias("now"))
            both = sums.join(shares[name], F.col("__own").eqNullSafe(F.col("__k")))
            factor = F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0)
            step = _meet(step, name, both.select("__k", factor.alias("factor"))).withColumn("w", F.col("w") * F.col("factor")).drop("factor")
        before, now = now, cut_lineage(step)
        release(before)
        errors = []
        for name in DIMENSIONS:
            sums = now.groupBy(F.col(name).alias("__own")).agg(F.sum("w").alias("now"))
            both = sums.join(shares[name], F.col("__own").eqNullSafe(F.col("__k"))).where("share > 0")
            errors.append(both.agg(F.max(F.abs(F.col("now") / F.col("share") - 1)).alias("e")))
        error = errors[0].union(errors[1]).union(errors[2]).agg(F.max("e")).first()[0] or 0.0
        if error <= TOLERANCE:
            break
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))
    largest = now.agg(F.max(ratio)).first()[0] or 1.0
    chance = F.coalesce(F.round(ratio / F.lit(largest), DIGITS), F.lit(1.0))
    return now.select(*DIMENSIONS, chance.alias("probability"), F.lit(error <= ON_TARGET).alias("met"))


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that belongs to a document: from its id, or its text without one."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def mix(
    documents: DataFrame,
    source: Column,
    lang: Column,
    topic: Column,
    tokens: Column,
    number: Column,
    powers: dict[str, float] | None = None,
    targets: dict[str, dict] | None = None,
) -> DataFrame:
    """The documents with a struct ``mix``: source, lang, topic, tokens, probability, kept,
    on_target (whether all marginals of the weights are met).

    ``number`` is each document's place in [0, 1), such as ``draw``: it is kept when that
    is below its probability. Null is a category like any other. Cells without tokens are
    kept whole, for they don't weigh. Repeated rows are kept or left together. An empty
    table gives an empty result. The driver sees one sum for each cell, DRIVER_CELLS at
    most; more cells stay on Spark. Spark broadcasts their probabilities if they are small.
    """
    rows = documents.withColumn(
        "mix",
        F.struct(
            source.cast("string").alias("source"),
            lang.cast("string").alias("lang"),
            topic.cast("string").alias("topic"),
            tokens.alias("tokens"),
            number.alias("number"),
        ),
    )
    cells = rows.groupBy(*(F.col(f"mix.{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("mix.tokens").alias("tokens"))
    few = [tuple(r) for r in cells.orderBy(*DIMENSIONS).limit(DRIVER_CELLS + 1).collect()]
    names = ("__s", "__l", "__t", "__p", "__met")
    if len(few) > DRIVER_CELLS:
        chances = cell_probabilities_on_spark(cut_lineage(cells), powers or {}, targets).toDF(*names)
    else:
        found = cell_probabilities(few, powers or {}, targets)
        chances = documents.sparkSession.createDataFrame(found, "__s string, __l string, __t string, __p double, __met boolean")
    same = [F.col(f"mix.{d}").eqNullSafe(F.col(c)) for d, c in zip(DIMENSIONS, names)]
    rows = rows.join(chances, same[0] & same[1] & same[2])
    kept = F.struct("mix.source", "mix.lang", "mix.topic", "mix.tokens", F.col("__p").alias("probability"),
                    (F.col("mix.number") < F.col("__p")).alias("kept"), F.col("__met").alias("on_target"))
    return rows.withColumn("mix", kept).drop(*names)


def topics(labels: DataFrame) -> DataFrame:
    """(__label_id, __topic) from (doc_id, quality, toxic): what the labels say of a
    document, one row each; the worst label where there are several."""
    return (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").alias("__label_id"))
        .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
        .select("__label_id", F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'plain' END").alias("__topic"))
    )


def with_topic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with ``__topic``, 'none' without a label."""
    found = documents.join(topics(labels), F.col("doc_id") == F.col("__label_id"), "left").drop("__label_id")
    return found.withColumn("__topic", F.coalesce("__topic", F.lit("none")))


#: How far sources and languages are flattened; topics keep their shares.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
