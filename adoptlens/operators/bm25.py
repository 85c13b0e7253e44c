"""Okapi BM25 with every document as its own corpus of chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..session import cut_lineage
from .intervals import BUCKET

K1, B, EPSILON = 1.5, 0.75, 0.25
# Contributions are rounded to this many decimals and added as decimals: the total
# then does not depend on the order in which partitions deliver them.
EXACT = "decimal(24,12)"


def chunk_terms(chunks: DataFrame, term_map: DataFrame | None = None) -> DataFrame:
    """Chunks with ``tokens``; with ``term_map(raw, norm)`` every term is replaced."""
    listed = chunks.withColumn("tokens", tokens("chunk_text"))
    if term_map is None:
        return listed
    return normalize_terms(listed, ["document_id", "chunk_no"], term_map)


def normalize_terms(listed: DataFrame, keys: Sequence[str], term_map: DataFrame) -> DataFrame:
    """Replaces terms in the array column ``tokens``, keeping order and copies.

    Rows meet only the entries that change a term. A term without an entry stays as it is.
    """
    keys = list(keys)
    rest = [c for c in listed.columns if c not in ("tokens", *keys)]
    spread = listed.select(*keys, F.posexplode("tokens").alias("__pos", "raw"))
    # written, so that both sides of the join are plain and a frequent term can be split
    changed = cut_lineage(term_map.select("raw", "norm").where(F.col("norm") != F.col("raw")))
    back = (
        spread.join(changed, "raw", "left")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("__pos", F.coalesce("norm", "raw").alias("t")))).alias("__t"))
        .select(*keys, F.col("__t.t").alias("tokens"))
    )
    base = listed.select(*keys, *rest)
    return base.join(back, keys, "left").withColumn(
        "tokens", F.coalesce("tokens", F.array().cast("array<string>"))
    )


def bm25_hits(
    chunks: DataFrame,
    queries: DataFrame,
    k1: float = K1,
    b: float = B,
    epsilon: float = EPSILON,
    term_map: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(hits, places). Hits: case_id, document_id, chunk_no, start, end, score of every
    chunk of the queried document that has a query term; all others score 0. Places:
    document_id, chunk_no, start, end of all chunks of queried documents.
    ``queries``: case_id, document_id, query.

    idf = ln(N - n + 0.5) - ln(n + 0.5); a negative idf becomes epsilon times the mean
    idf of the document's vocabulary, taken before any replacement. A query term
    counts as often as it occurs; a term the document lacks adds nothing.

    A posting list per (document, term) meets the queries that ask for the term, so rows
    grow with hits and not with cases times chunks.
    """
    asked = queries.select("document_id").distinct()
    wanted = chunks.join(asked, "document_id", "left_semi")
    # read for lengths, term counts and places, so tokens are cut once
    listed = cut_lineage(chunk_terms(wanted, term_map).drop("chunk_text"))
    sized = listed.withColumn("length", F.size("tokens"))

    corpus = sized.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg("length").alias("avg_length")
    )
    # the shuffle key holds document and term, so a long document spreads
    tf = (
        sized.select("document_id", "chunk_no", "start", "end", "length", F.explode("tokens").alias("term"))
        .groupBy("document_id", "term", "chunk_no", "start", "end", "length")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighted = df.join(corpus, "document_id").withColumn("raw_idf", weight)
    floor = weighted.groupBy("document_id").agg(
        F.sum(F.round("raw_idf", 12).cast(EXACT)).cast("double").alias("s"),
        F.count(F.lit(1)).alias("v"),
    )
    asked_terms = query_terms(queries, term_map)
    # only the terms that are asked for go on
    terms = (
        asked_terms.join(weighted, ["document_id", "term"])
        .join(floor, "document_id")
        .withColumn(
            "idf",
            F.when(F.col("raw_idf") < 0, F.lit(epsilon) * F.col("s") / F.col("v")).otherwise(
                F.col("raw_idf")
            ),
        )
        .select("case_id", "document_id", "term", "qtf", "idf", "avg_length")
    )
    saturation = F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length"))
    )
    hits = (
        terms.join(tf, ["document_id", "term"])
        .groupBy("case_id", "document_id", "chunk_no", "start", "end")
        .agg(
            F.sum(F.round(F.col("qtf") * F.col("idf") * saturation, 12).cast(EXACT))
            .cast("double")
            .alias("score")
        )
    )
    return hits, listed.select("document_id", "chunk_no", "start", "end")


def bm25_scores(chunks: DataFrame, queries: DataFrame, **settings) -> DataFrame:
    """Score of every chunk of the queried document, those without a hit included: one row
    per case and chunk. See ``bm25_hits``."""
    hits, places = bm25_hits(chunks, queries, **settings)
    every = queries.select("case_id", "document_id").distinct().join(places, "document_id")
    keys = ["case_id", "document_id", "chunk_no", "start", "end"]
    return every.join(hits, keys, "left").fillna(0.0, ["score"])


def leading_chunks(hits: DataFrame, places: DataFrame, queries: DataFrame, chunks: int = 0, characters: int = 0) -> DataFrame:
    """The hits, and of the chunks without one as many as can rank among the first
    ``chunks`` or be reached within a budget of ``characters``.

    Chunks without a hit rank in source order between positive and negative scores. The
    first ``chunks`` of them lie among as many first chunks as that and the hits. Positive
    ones and those that start within the budget, longer by what negative ones cover, hold
    that many characters or the whole document.
    """
    negative = F.col("score") < 0
    told = hits.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("__hits"), F.sum(F.when(negative, F.col("end") - F.col("start")).otherwise(0)).alias("__lost")
    )
    cases = queries.select("case_id", "document_id").distinct().join(told, "case_id", "left").fillna(0, ["__hits", "__lost"])
    keys = ["case_id", "document_id", "chunk_no"]
    wanted = []
    if chunks:
        first = F.explode(F.sequence(F.lit(0), (F.lit(chunks - 1) + F.col("__hits")).cast("int"))).alias("chunk_no")
        wanted.append(cases.select("case_id", "document_id", first).join(places, ["document_id", "chunk_no"]))
    if characters:
        span = F.lit(characters) + F.col("__lost")
        near = cases.select("case_id", "document_id", span.alias("__span"))
        near = near.withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.col("__span") - 1) / BUCKET).cast("int"))))
        there = places.withColumn("__b", F.floor(F.col("start") / BUCKET).cast("int"))
        wanted.append(near.join(there, ["document_id", "__b"]).where(F.col("start") < F.col("__span")))
    rows = [w.select(*keys, "start", "end") for w in wanted]
    for more in rows[1:]:
        rows[0] = rows[0].unionByName(more).distinct()
    empty = rows[0].join(hits.select(*keys), keys, "left_anti").withColumn("score", F.lit(0.0))
    return hits.unionByName(empty)


def query_terms(queries: DataFrame, term_map: DataFrame | None = None) -> DataFrame:
    listed = queries.select("case_id", "document_id", tokens("query").alias("tokens"))
    if term_map is not None:
        listed = normalize_terms(listed, ["case_id", "document_id"], term_map)
    return (
        listed.select("case_id", "document_id", F.explode("tokens").alias("term"))
        .groupBy("case_id", "document_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def rank_chunks(scores: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """``rank`` by score, then start; zero and negative scores are ranked too."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("start"))
    return scores.withColumn("rank", F.row_number().over(order))


def topk_context(scores: DataFrame, k: int, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    return rank_chunks(scores, keys).where(F.col("rank") <= k)


def with_preamble(
    ranked: DataFrame, docs: DataFrame, tasks: DataFrame, characters: int, categories: Sequence[str]
) -> DataFrame:
    """Adds the first ``characters`` of the document as rank 0 for some categories."""
    chosen = tasks.where(F.col("category").isin(*categories)) if categories else tasks.limit(0)
    opening = chosen.join(docs.select("document_id", F.length("text").alias("__n")), "document_id")
    head = opening.where(F.col("__n") > 0).select(
        "case_id",
        "document_id",
        F.lit(0).alias("rank"),
        F.lit(0).alias("start"),
        F.least(F.lit(characters), F.col("__n")).alias("end"),
    )
    return ranked.select("case_id", "document_id", "rank", "start", "end").unionByName(head)
