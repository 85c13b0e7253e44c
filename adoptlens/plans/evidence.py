"""Registered queries over documents, passages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import (
    MARKERS,
    PREVIEW_AFTER,
    PREVIEW_BEFORE,
    PREVIEW_HITS,
    PREVIEW_MARKERS,
    edit_ratio,
    mask_contacts,
    normalized,
)
from ..operators import bm25, chunking, corpus, diagnostics, intervals, metrics, scoring
from ..operators.passages import passage_occurrences, passage_spans
from ..session import cut_lineage
from . import bindings as b
from .bindings import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Whitespace as code points, for the SQL side.
SPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Chunk settings and budget of the registered queries.
WORDS, OVERLAP = 60, 15
NARROW_WORDS, NARROW_OVERLAP = 40, 0
BUDGET = 600
PREAMBLE = 120
PREAMBLE_CATEGORIES = ["c0", "c1"]


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def documents(spark: SparkSession, d: str) -> DataFrame:
    docs = b.table(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), "text", "lang", "source"
    )
    return docs


def passage_matches(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, document_id, passage, answer_start) for every document that contains the
    passage verbatim, with its first place."""
    found = passage_occurrences(passages, docs)
    return found.groupBy("item_id", "document_id", "passage").agg(F.min("start").alias("answer_start"))


def damaged(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Some documents without a passage lost their words, some their letters."""
    held = found.select("document_id", F.lit(True).alias("__held")).distinct()
    lost = F.when(F.col("__held"), F.col("text")).when(F.col("document_id") % 7 == 3, F.lit("  \n")).when(F.col("document_id") % 7 == 5, F.lit("-- .. !"))
    joined = docs.join(held, "document_id", "left")
    return joined.withColumn("text", F.coalesce(lost, F.col("text"))).drop("__held")


def questions(spark: SparkSession, d: str, faults: bool = False) -> tuple[DataFrame, DataFrame]:
    """(questions, documents): every passage asked of each document that holds it
    (answerable) and of the document after it (unanswerable unless it holds the passage
    too)."""
    docs = documents(spark, d)
    found = cut_lineage(passage_matches(b.table(spark, d, "benchmark"), docs))
    if faults:
        docs = damaged(docs, found)
    n = docs.agg(F.max("document_id") + 1).scalar()
    here = found.select("item_id", "document_id")
    after = found.select("item_id", F.pmod(F.col("document_id") + 1, n).alias("document_id"))
    asked = here.unionByName(after).distinct()
    answer = F.struct(
        F.col("answer_start").cast("int").alias("answer_start"), F.col("passage").alias("text")
    )
    chars = F.col("__chars")
    band = F.when(chars <= 1000, 1).when(chars <= 2000, 2).when(chars <= 4000, 3).otherwise(4)
    passages = b.table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    rows = (
        asked.join(found.drop("passage"), ["item_id", "document_id"], "left")
        .join(passages, "item_id")
        .withColumn("passage", F.col("query"))
        .join(docs.select("document_id", F.length("text").alias("__chars")), "document_id")
        .select(
            F.concat_ws("-", F.col("item_id").cast("string"), F.col("document_id").cast("string")).alias(
                "case_id"
            ),
            "document_id",
            F.concat(F.lit("c"), (F.col("item_id") % 4).cast("string")).alias("category"),
            F.col("query").alias("question"),
            "query",
            F.col("item_id").cast("string").alias("source_qa_id"),
            F.col("answer_start").isNull().alias("is_impossible"),
            F.when(F.col("answer_start").isNotNull(), F.array(answer))
            .otherwise(F.array().cast("array<struct<answer_start:int,text:string>>"))
            .alias("answers"),
            band.alias("length_quartile"),
            chars.alias("document_characters"),
        )
    )
    return rows, docs


QUESTIONS_SQL = """
found AS (SELECT item_id, doc_id AS document_id, b.text AS passage, instr(d.text, b.text) - 1 AS answer_start
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
docs AS (SELECT doc_id AS document_id, text, lang, source FROM documents),
asked AS (SELECT item_id, document_id FROM found
  UNION SELECT item_id, (document_id + 1) % (SELECT max(document_id) + 1 FROM docs) FROM found),
questions AS (
  SELECT concat(item_id, '-', document_id) AS case_id, document_id, concat('c', item_id % 4) AS category, b.text AS query,
    f.answer_start IS NULL AS is_impossible, f.answer_start, f.answer_start + length(b.text) AS answer_end,
    CASE WHEN length(d.text) <= 1000 THEN 1 WHEN length(d.text) <= 2000 THEN 2 WHEN length(d.text) <= 4000 THEN 3 ELSE 4 END
      AS length_quartile, length(d.text) AS document_characters, item_id
  FROM asked JOIN benchmark b USING (item_id) JOIN docs d USING (document_id)
    LEFT JOIN found f USING (item_id, document_id))"""


def chunk_sql(name: str, words: int, overlap: int, docs: str = "docs") -> str:
    step = words - overlap
    return f"""
{name}_w AS (SELECT document_id, len, lead, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS i, len(p) AS n FROM (
  SELECT document_id, length(text) AS len, length(regexp_extract(text, '^[{SPACE}]*')) AS lead,
    regexp_extract_all(text, '[^{SPACE}]+[{SPACE}]*') AS p FROM {docs})),
{name}_s AS (SELECT *, lead + coalesce(sum(length(piece)) OVER (PARTITION BY document_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM {name}_w),
{name} AS (SELECT a.document_id, CAST(a.i // {step} AS INT) AS chunk_no,
    CASE WHEN a.i = 0 THEN 0 ELSE a.at END AS "start",
    CASE WHEN a.i + {words} >= a.n THEN a.len ELSE e.at END AS "end"
  FROM {name}_s a LEFT JOIN {name}_s e ON e.document_id = a.document_id AND e.i = a.i + {words}
  WHERE a.i % {step} = 0 AND (a.i = 0 OR a.i - {step} + {words} < a.n))"""


def bm25_sql(chunks: str) -> str:
    return f"""
{chunks}_tok AS (SELECT document_id, chunk_no, "start", "end", regexp_extract_all(replace(lower(
    substr(text, CAST("start" AS BIGINT) + 1, CAST("end" - "start" AS BIGINT))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+') AS toks
  FROM {chunks} JOIN docs USING (document_id)),
{chunks}_c AS (SELECT document_id, count(*) AS n, avg(len(toks)) AS al FROM {chunks}_tok GROUP BY 1),
{chunks}_tf AS (SELECT document_id, chunk_no, l, term, count(*) AS tf FROM (
  SELECT document_id, chunk_no, len(toks) AS l, unnest(toks) AS term FROM {chunks}_tok) GROUP BY 1, 2, 3, 4),
{chunks}_df AS (SELECT document_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (
  SELECT document_id, term, count(*) AS df FROM {chunks}_tf GROUP BY 1, 2) JOIN {chunks}_c USING (document_id)),
{chunks}_fl AS (SELECT document_id, avg(raw) AS mean FROM {chunks}_df GROUP BY 1),
{chunks}_q AS (SELECT case_id, document_id, term, count(*) AS qtf FROM (
  SELECT case_id, document_id, unnest(regexp_extract_all(replace(lower(query), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')) AS term
  FROM questions) GROUP BY 1, 2, 3),
{chunks}_h AS (SELECT case_id, document_id, chunk_no, CAST(sum(CAST(qtf * CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END
    * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al)) AS DECIMAL(24,12))) AS DOUBLE) AS score
  FROM {chunks}_q JOIN {chunks}_df USING (document_id, term) JOIN {chunks}_fl USING (document_id)
    JOIN {chunks}_c USING (document_id) JOIN {chunks}_tf USING (document_id, term) GROUP BY 1, 2, 3),
{chunks}_r AS (SELECT case_id, document_id, chunk_no, "start", "end", coalesce(score, 0.0) AS score,
    row_number() OVER (PARTITION BY case_id ORDER BY coalesce(score, 0.0) DESC, "start") AS rank
  FROM questions JOIN {chunks} USING (document_id) LEFT JOIN {chunks}_h USING (case_id, document_id, chunk_no))"""


def context_sql(name: str, ranked: str, preamble: bool) -> str:
    """Brute force: one row per character, owned by its best rank."""
    head = (
        f""" UNION ALL SELECT case_id, 0, 0, least({PREAMBLE}, document_characters) FROM questions
  WHERE category IN ('c0', 'c1')"""
        if preamble
        else ""
    )
    return f"""
{name}_p(case_id, rank, s, e) AS (SELECT case_id, rank, "start", "end" FROM {ranked}{head}),
{name}_o AS (SELECT case_id, pos, min(rank) AS rank FROM (
  SELECT case_id, rank, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT))) AS pos FROM {name}_p) GROUP BY 1, 2),
{name} AS (SELECT case_id, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank, pos) AS i FROM {name}_o)
  WHERE i <= {BUDGET})"""


def score_sql(name: str, context: str, config: str) -> str:
    return f"""
{name} AS (SELECT q.case_id, '{config}' AS config_id, q.document_id, category, length_quartile, is_impossible,
    document_characters, count(c.pos) AS retrieved_characters,
    count(c.pos) FILTER (WHERE c.pos >= answer_start AND c.pos < answer_end) AS hit, any_value(answer_end - answer_start) AS gold
  FROM questions q LEFT JOIN {context} c USING (case_id) GROUP BY ALL)"""


BASE_SQL = (
    "WITH "
    + QUESTIONS_SQL
    + ","
    + chunk_sql("wide", WORDS, OVERLAP)
    + ","
    + bm25_sql("wide")
    + ","
)


def scores_sql(state: str) -> str:
    return (
        BASE_SQL
        + chunk_sql("narrow", NARROW_WORDS, NARROW_OVERLAP)
        + ","
        + bm25_sql("narrow")
        + ","
        + context_sql("ctx_a", "narrow_r", False)
        + ","
        + context_sql("ctx_b", "wide_r", True)
        + ","
        + score_sql("sc_a", "ctx_a", "baseline")
        + ","
        + score_sql("sc_b", "ctx_b", "candidate")
        + f""", told AS (SELECT u.*, {state} AS state FROM (SELECT * FROM sc_a UNION ALL SELECT * FROM sc_b) u JOIN docs USING (document_id)),
kept AS (SELECT * REPLACE (CASE WHEN state = 'ok' THEN retrieved_characters ELSE 0 END AS retrieved_characters,
  CASE WHEN state = 'ok' THEN hit ELSE 0 END AS hit) FROM told),
scores AS (SELECT *, CASE WHEN NOT is_impossible THEN hit / gold END AS recall,
  CASE WHEN NOT is_impossible THEN hit > 0 END AS any_hit, CASE WHEN NOT is_impossible THEN hit = gold END AS full_hit,
  CASE WHEN NOT is_impossible THEN coalesce(hit / nullif(retrieved_characters, 0), 0) END AS prec FROM kept)
"""
    )


SCORES_SQL = scores_sql("'ok'")
# a run with damaged documents that stopped before some cases of one configuration
FAULTS_SQL = scores_sql(
    f"""CASE WHEN config_id = 'candidate' AND CAST(split_part(case_id, '-', 1) AS INT) % 9 = 4 THEN 'missing'
    WHEN NOT regexp_matches(text, '[^{SPACE}]') OR NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') THEN 'error' ELSE 'ok' END"""
).replace(
    "docs AS (SELECT doc_id AS document_id, text, lang, source FROM documents),",
    """docs AS (SELECT doc_id AS document_id, CASE WHEN doc_id IN (SELECT document_id FROM found) THEN text
  WHEN doc_id % 7 = 3 THEN '  ' || chr(10) WHEN doc_id % 7 = 5 THEN '-- .. !' ELSE text END AS text, lang, source FROM documents),""",
    1,
)

TOP = 3


def ranked_windows(docs: DataFrame, tasks: DataFrame, words: int, overlap: int, reach: str) -> DataFrame:
    """Ranked chunks of each task: those that the ``budget`` or the ``top`` ones can need,
    or ``all``."""
    chunks = chunking.chunk(docs, words, overlap)
    if reach == "all":
        return bm25.rank_chunks(bm25.bm25_scores(chunks, tasks))
    hits, places = bm25.bm25_hits(chunks, tasks)
    # read for their number and their lengths, and then as rows
    hits = cut_lineage(hits)
    few = {"chunks": TOP} if reach == "top" else {"characters": BUDGET}
    return bm25.rank_chunks(bm25.leading_chunks(hits, places, tasks, **few))


def retrieval(
    spark: SparkSession, d: str, narrow: bool = True, reach: str = "budget", faults: bool = False
) -> dict[str, DataFrame]:
    """Tasks, references and the ranked chunks of the wide and, if asked, the narrow windows."""
    asked, docs = questions(spark, d, faults)
    asked = cut_lineage(asked)
    tasks, references = corpus.split_gold(asked)
    tasks = corpus.require_no_gold(tasks)
    docs = docs.join(tasks.select("document_id").distinct(), "document_id", "left_semi")
    docs = cut_lineage(docs)
    wide_ranked = ranked_windows(docs, tasks, WORDS, OVERLAP, reach)
    run = {
        "questions": asked,
        "tasks": tasks,
        "references": references,
        "docs": docs,
        "wide": wide_ranked,
        "proposals": bm25.with_preamble(wide_ranked, docs, tasks, PREAMBLE, PREAMBLE_CATEGORIES),
    }
    if narrow:
        run["narrow"] = ranked_windows(docs, tasks, NARROW_WORDS, NARROW_OVERLAP, reach)
    return run


def contexts(run: dict[str, DataFrame]) -> DataFrame:
    """Equal-budget contexts of both configurations, written out before any gold is read."""
    baseline = intervals.budget_context(
        run["narrow"], ["case_id"], BUDGET
    ).withColumn("config_id", F.lit("baseline"))
    candidate = intervals.budget_context(
        run["proposals"], ["case_id"], BUDGET
    ).withColumn("config_id", F.lit("candidate"))
    # one after the other: a plan of both is as large to plan as to run
    return cut_lineage(baseline).unionByName(cut_lineage(candidate))


def scored(spark: SparkSession, d: str, faults: bool = False) -> DataFrame:
    run = retrieval(spark, d, faults=faults)
    context = contexts(run)
    # the second configuration stopped before some cases
    item = F.split("case_id", "-")[0].cast("int")
    lost = (F.col("config_id") == "candidate") & (item % 9 == 4) if faults else F.lit(False)
    return score(run, context, ["baseline", "candidate"], lost)


def score(run: dict[str, DataFrame], context: DataFrame, configs: list[str], lost: Column | None = None) -> DataFrame:
    cases = run["questions"].select(
        "case_id",
        "document_id",
        "category",
        "length_quartile",
        "is_impossible",
        "document_characters",
    )
    grid = cases.withColumn("config_id", F.explode(F.array(*[F.lit(c) for c in configs])))
    states = scoring.retrieval_states(run["tasks"], run["docs"])
    predictions = grid.select("case_id", "config_id").join(states.select("case_id", "status"), "case_id")
    if lost is not None:
        predictions = predictions.where(~lost)
    gold = scoring.gold_spans(run["references"], run["docs"])
    return scoring.score_retrieval(grid, predictions, context, gold)


# --- chunks and ranking -----------------------------------------------------


@query(
    "WITH docs AS (SELECT doc_id AS document_id, text FROM documents),"
    + chunk_sql("wide", WORDS, OVERLAP)
    + """SELECT document_id, chunk_no, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end",
  sha256(substr(text, CAST("start" AS BIGINT) + 1, CAST("end" - "start" AS BIGINT))) AS text_hash
FROM wide JOIN docs USING (document_id)"""
)
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.chunk(documents(spark, d), WORDS, OVERLAP)
    return chunks.withColumn("text_hash", F.sha2("chunk_text", 256)).drop("chunk_text")


UNIT_SQL = f"""
unit_w AS (SELECT document_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
  SELECT document_id, regexp_extract_all(text, '[^.!?\\n]*(?:[.!?\\n]+[{SPACE}]*|\\z)') AS p FROM docs)),
units AS (SELECT document_id, "end" - n AS "start", "end" FROM (
  SELECT document_id, length(piece) AS n, sum(length(piece)) OVER (PARTITION BY document_id ORDER BY i) AS "end"
  FROM unit_w WHERE length(piece) > 0))"""


@query(
    "WITH docs AS (SELECT doc_id AS document_id, text FROM documents),"
    + UNIT_SQL
    + """SELECT document_id, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM units"""
)
def sentence_units(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_units(documents(spark, d))


@query(
    "WITH docs AS (SELECT doc_id AS document_id, text FROM documents),"
    + UNIT_SQL
    + """, kept AS (SELECT *, lag("end") OVER w AS p, lead("start") OVER w AS nx FROM units WHERE "end" - "start" < 200
  WINDOW w AS (PARTITION BY document_id ORDER BY "start")),
v AS (SELECT document_id, "start", "end", CASE WHEN "start" > coalesce(p, 0) THEN 'gap'
    WHEN nx IS NULL AND "end" < length(text) THEN 'unsegmented_tail' END AS violation FROM kept JOIN docs USING (document_id))
SELECT document_id, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", violation FROM v WHERE violation IS NOT NULL
UNION ALL SELECT document_id, NULL, NULL, 'no_units' FROM docs WHERE document_id NOT IN (SELECT document_id FROM kept)"""
)
def unit_violations(spark: SparkSession, d: str) -> DataFrame:
    """A unit table that lost its long sentences no longer partitions the texts."""
    docs = documents(spark, d)
    units = chunking.sentence_units(docs).where(F.col("end") - F.col("start") < 200)
    return chunking.unit_violations(units, docs)


@query(
    BASE_SQL.rstrip(",")
    + """SELECT case_id, document_id, chunk_no, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end",
  round(score, 6) AS score, CAST(rank AS INT) AS rank FROM wide_r WHERE rank <= 3"""
)
def bm25_top3(spark: SparkSession, d: str) -> DataFrame:
    run = retrieval(spark, d, narrow=False, reach="top")
    top = bm25.topk_context(run["wide"].drop("rank"), TOP)
    return rounded(top, "score")


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS term FROM documents),
m AS (SELECT DISTINCT term, regexp_replace(term, '(tion|s)$', '') AS norm FROM t)
SELECT doc_id AS document_id, count(*) AS tokens, count(DISTINCT norm) AS distinct_terms
FROM t JOIN m USING (term) GROUP BY 1"""
)
def normalized_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(
        "document_id", F.lit(0).alias("chunk_no"), F.col("text").alias("chunk_text")
    )
    listed = cut_lineage(bm25.chunk_terms(docs).select("document_id", "tokens"))
    vocabulary = listed.select(F.explode("tokens").alias("raw")).distinct()
    term_map = vocabulary.withColumn("norm", F.regexp_replace("raw", "(tion|s)$", ""))
    mapped = bm25.normalize_terms(listed, ["document_id"], term_map)
    return mapped.select(
        "document_id",
        F.size("tokens").cast("long").alias("tokens"),
        F.size(F.array_distinct("tokens")).cast("long").alias("distinct_terms"),
    ).where(F.col("tokens") > 0)


# --- contexts and scores ----------------------------------------------------


@query(
    FAULTS_SQL
    + """SELECT case_id, config_id, document_id, category, CAST(length_quartile AS INT) AS length_quartile, is_impossible,
  state AS response_state, document_characters, retrieved_characters, round(recall, 6) AS gold_character_recall, any_hit AS any_gold_hit, full_hit AS all_gold_covered,
  round(prec, 6) AS context_precision FROM scores"""
)
def budget_context_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a run with failures: errors and missing rows retrieve nothing and count 0."""
    # pieces of a budget don't overlap
    df = scored(spark, d, faults=True).drop("retrieved_characters_with_overlap")
    return rounded(df, "gold_character_recall", "context_precision")


RANKED_UNITS_SQL = (
    BASE_SQL
    + UNIT_SQL
    + f""", hits AS (SELECT q.case_id, u."start" AS s, u."end" AS e, min(r.rank) AS rank
  FROM questions q JOIN wide_r r USING (case_id) JOIN units u ON u.document_id = q.document_id
    AND u."start" < r."end" AND r."start" < u."end" GROUP BY 1, 2, 3),
ordered AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank, s) AS i FROM hits),
walk AS (
  SELECT case_id, i, CASE WHEN e - s <= {BUDGET} THEN e - s ELSE 0 END AS used, e - s <= {BUDGET} AS ok FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.case_id, o.i, w.used + CASE WHEN w.used + o.e - o.s <= {BUDGET} THEN o.e - o.s ELSE 0 END,
    w.used + o.e - o.s <= {BUDGET} FROM walk w JOIN ordered o ON o.case_id = w.case_id AND o.i = w.i + 1),
taken AS (SELECT o.* FROM ordered o JOIN walk w USING (case_id, i) WHERE w.ok)
"""
).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    RANKED_UNITS_SQL
    + """SELECT q.case_id, q.is_impossible, CAST(coalesce(sum(e - s), 0) AS BIGINT) AS retrieved_characters,
  CASE WHEN NOT q.is_impossible THEN round(coalesce(sum(greatest(0, least(e, answer_end) - greatest(s, answer_start))), 0)
    / any_value(answer_end - answer_start), 6) END AS gold_character_recall
FROM questions q LEFT JOIN taken t USING (case_id) GROUP BY 1, 2"""
)
def unit_context_scores(spark: SparkSession, d: str) -> DataFrame:
    run = retrieval(spark, d, narrow=False, reach="all")
    units = chunking.sentence_units(run["docs"])
    taken = intervals.unit_context(run["wide"], units, ["case_id"], "document_id", BUDGET)
    context = cut_lineage(taken.withColumn("config_id", F.lit("units")))
    df = score(run, context, ["units"]).select(
        "case_id", "is_impossible", "retrieved_characters", "gold_character_recall"
    )
    return rounded(df, "gold_character_recall")


@query(
    RANKED_UNITS_SQL.rstrip()
    + f""", size AS (SELECT case_id, CAST(sum(e - s) AS BIGINT) AS lim FROM taken GROUP BY 1),
ctl_o AS (SELECT case_id, pos, min(rank) AS rank FROM (
  SELECT case_id, rank, unnest(range(CAST("start" AS BIGINT), CAST("end" AS BIGINT))) AS pos FROM wide_r) GROUP BY 1, 2),
ctl AS (SELECT case_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank, pos) AS i FROM ctl_o)
  JOIN size USING (case_id) WHERE i <= lim)
SELECT case_id, count(*) AS characters, CAST(sum(pos) AS BIGINT) AS position_sum FROM ctl GROUP BY 1"""
)
def matched_control(spark: SparkSession, d: str) -> DataFrame:
    """Windows again, with the size of each case's unit context as its budget."""
    run = retrieval(spark, d, narrow=False, reach="all")
    units = chunking.sentence_units(run["docs"])
    taken = intervals.unit_context(run["wide"], units, ["case_id"], "document_id", BUDGET)
    size = intervals.context_size(taken, ["case_id"])
    control = intervals.budget_context(
        run["wide"].join(size, "case_id"), ["case_id"], "characters"
    )
    length = F.col("end") - F.col("start")
    return control.groupBy("case_id").agg(
        F.sum(length).alias("characters"),
        F.sum((F.col("start") + F.col("end") - 1) * length / 2).cast("long").alias("position_sum"),
    )


@query(
    SCORES_SQL
    + """SELECT a.case_id, a.category, round(a.recall, 6) AS before, round(c.recall, 6) AS after, a.full_hit AS full_before,
  c.full_hit AS full_after, round(c.recall - a.recall, 6) AS recall_delta, NOT a.full_hit AND c.full_hit AS full_gained,
  a.full_hit AND NOT c.full_hit AS full_lost,
  CASE WHEN c.recall > a.recall THEN 'improved' WHEN c.recall < a.recall THEN 'regressed' ELSE 'unchanged' END AS change
FROM scores a JOIN scores c USING (case_id) WHERE a.config_id = 'baseline' AND c.config_id = 'candidate' AND NOT a.is_impossible"""
)
def paired_changes(spark: SparkSession, d: str) -> DataFrame:
    df = scoring.paired_changes(scored(spark, d), "baseline", "candidate")
    return rounded(df, "before", "after", "recall_delta")


SUMMARY_COLUMNS_SQL = """count(DISTINCT document_id) AS documents, count(*) AS tasks,
  count(*) FILTER (WHERE NOT is_impossible) AS answerable, count(*) FILTER (WHERE is_impossible) AS unanswerable,
  round(avg(recall), 6) AS macro_gold_character_recall, round(avg(CAST(any_hit AS INT)), 6) AS any_gold_hit_rate,
  round(avg(CAST(full_hit AS INT)), 6) AS all_gold_covered_rate, round(avg(prec), 6) AS macro_context_precision,
  round(avg(retrieved_characters), 6) AS mean_retrieved_characters, round(avg(retrieved_characters), 6) AS mean_retrieved_characters_with_overlap,
  round(avg(retrieved_characters) FILTER (WHERE is_impossible), 6) AS unanswerable_mean_retrieved_characters,
  count(*) FILTER (WHERE state = 'ok') AS successful_queries, count(*) FILTER (WHERE state = 'error') AS failed_queries,
  count(*) FILTER (WHERE state = 'missing') AS missing_queries,
  CAST(quantile_disc(document_characters, 0.5) FILTER (WHERE state = 'ok') AS DOUBLE) AS latency_p50,
  CAST(quantile_disc(document_characters, 0.95) FILTER (WHERE state = 'ok') AS DOUBLE) AS latency_p95"""


@query(
    FAULTS_SQL
    + f"""SELECT 'config_id' AS grouping, config_id, NULL AS category, NULL AS length_quartile, {SUMMARY_COLUMNS_SQL} FROM scores GROUP BY config_id
UNION ALL SELECT 'config_id+category', config_id, category, NULL, {SUMMARY_COLUMNS_SQL} FROM scores GROUP BY config_id, category
UNION ALL SELECT 'config_id+length_quartile', config_id, NULL, CAST(length_quartile AS INT), {SUMMARY_COLUMNS_SQL} FROM scores GROUP BY config_id, length_quartile"""
)
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """A run with failures; the size of a document stands for the time of its queries."""
    df = scoring.eval_summary(cut_lineage(scored(spark, d, faults=True)), latency="document_characters")
    return rounded(
        df,
        "macro_gold_character_recall",
        "any_gold_hit_rate",
        "all_gold_covered_rate",
        "macro_context_precision",
        "mean_retrieved_characters",
        "mean_retrieved_characters_with_overlap",
        "unanswerable_mean_retrieved_characters",
    )


@query(
    FAULTS_SQL.rstrip()
    + """, s AS (SELECT config_id, avg(recall) AS r, avg(CAST(full_hit AS INT)) AS f FROM scores GROUP BY 1),
p AS (SELECT count(*) AS lost FROM scores a JOIN scores c USING (case_id) WHERE a.config_id = 'baseline'
  AND c.config_id = 'candidate' AND a.full_hit AND NOT c.full_hit),
t AS (SELECT coalesce(c.f > a.f, false) AS full_coverage_strictly_improves, coalesce(c.r >= a.r, false) AS mean_recall_not_lower,
  (SELECT count(*) = 0 FROM scores WHERE state <> 'ok') AS all_arms_complete, lost = 0 AS no_complete_task_lost
  FROM s a, s c, p WHERE a.config_id = 'baseline' AND c.config_id = 'candidate')
SELECT *, full_coverage_strictly_improves AND mean_recall_not_lower AND all_arms_complete AND no_complete_task_lost AS qualifies FROM t"""
)
def acceptance_decision(spark: SparkSession, d: str) -> DataFrame:
    """A run with failures can't qualify."""
    return scoring.acceptance_decision(cut_lineage(scored(spark, d, faults=True)), "baseline", "candidate")


@query(
    SCORES_SQL
    + """SELECT config_id, round(avg(recall), 6) AS macro_gold_character_recall, round(avg(CAST(full_hit AS INT)), 6) AS all_gold_covered_rate
FROM scores WHERE config_id <> 'baseline' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1"""
)
def choose_candidate(spark: SparkSession, d: str) -> DataFrame:
    best = scoring.choose_candidate(cut_lineage(scored(spark, d)), "baseline")
    names = ["macro_gold_character_recall", "all_gold_covered_rate"]
    return rounded(best.select("config_id", *names), *names)


@query(
    SCORES_SQL
    + """SELECT 'r1' AS run_id, 'development' AS "partition", round(avg(recall) FILTER (WHERE config_id = 'baseline'), 6) AS baseline_recall,
  round(avg(recall) FILTER (WHERE config_id = 'candidate'), 6) AS candidate_recall,
  round(100 * (avg(recall) FILTER (WHERE config_id = 'candidate') - avg(recall) FILTER (WHERE config_id = 'baseline')), 6) AS recall_gain_pp
FROM scores"""
)
def recall_gain(spark: SparkSession, d: str) -> DataFrame:
    df = metrics.recall_gain(_evaluation_rows(spark, d))
    return rounded(df, "baseline_recall", "candidate_recall", "recall_gain_pp")


def _evaluation_rows(spark: SparkSession, d: str, faults: bool = False) -> DataFrame:
    return scored(spark, d, faults).select(
        F.lit("r1").alias("run_id"),
        F.lit("development").alias("partition"),
        F.col("config_id").alias("config_role"),
        (~F.col("is_impossible")).alias("is_answerable"),
        "*",
    )


@query(
    FAULTS_SQL
    + """SELECT 'r1' AS run_id, 'development' AS "partition", config_id, config_id AS config_role, count(*) AS query_rows,
  count(DISTINCT case_id) AS questions, count(DISTINCT document_id) AS documents,
  count(*) FILTER (WHERE NOT is_impossible) AS answerable, count(*) FILTER (WHERE is_impossible) AS unanswerable,
  count(*) FILTER (WHERE state = 'error') AS failed_queries, count(*) FILTER (WHERE state = 'missing') AS missing_queries, round(avg(recall), 6) AS macro_gold_character_recall,
  round(avg(CAST(full_hit AS INT)), 6) AS all_gold_covered_rate, round(avg(CAST(any_hit AS INT)), 6) AS any_gold_hit_rate,
  round(avg(prec), 6) AS macro_context_precision, round(avg(retrieved_characters), 6) AS mean_retrieved_characters
FROM scores GROUP BY config_id"""
)
def config_summary(spark: SparkSession, d: str) -> DataFrame:
    df = scoring.config_summary(_evaluation_rows(spark, d, faults=True))
    return rounded(
        df,
        "macro_gold_character_recall",
        "all_gold_covered_rate",
        "any_gold_hit_rate",
        "macro_context_precision",
        "mean_retrieved_characters",
    )


@query(
    FAULTS_SQL
    + """SELECT config_id, count(DISTINCT document_id) AS documents, count(DISTINCT case_id) AS questions,
  count(DISTINCT case_id) FILTER (WHERE NOT is_impossible) AS answerable_questions,
  count(DISTINCT case_id) FILTER (WHERE is_impossible) AS unanswerable_questions, count(*) AS query_rows,
  count(*) FILTER (WHERE state = 'error') AS failed_queries, count(*) FILTER (WHERE state = 'missing') AS missing_queries, round(avg(recall), 6) AS evidence_recall,
  round(avg(CAST(full_hit AS INT)), 6) AS full_evidence_rate, round(avg(retrieved_characters), 6) AS mean_context_characters
FROM scores GROUP BY 1"""
)
def evaluation_kpis(spark: SparkSession, d: str) -> DataFrame:
    cases = cut_lineage(_evaluation_rows(spark, d, faults=True))
    chosen = list(metrics.evaluation_catalogue().values())
    df = metrics.evaluate(chosen, {"cases": cases}, ["config_id"])
    return rounded(df, "evidence_recall", "full_evidence_rate", "mean_context_characters")


# --- intervals over the given tables ----------------------------------------

SPANS_SQL = """
spans AS (SELECT l_suppkey AS k, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 10 AS s,
  date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 10 + CAST(l_quantity AS INT) AS e, l_linestatus FROM lineitem),
pos AS (SELECT DISTINCT k, l_linestatus, unnest(range(s, e)) AS p FROM spans)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as intervals per supplier."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return b.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("k"),
        (day * 10).cast("long").alias("start"),
        (day * 10 + F.col("l_quantity").cast("int")).cast("long").alias("end"),
        "l_linestatus",
    )


@query(
    "WITH "
    + SPANS_SQL
    + """, allpos AS (SELECT DISTINCT k, p FROM pos),
isl AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM allpos)
SELECT k, min(p) AS "start", max(p) + 1 AS "end" FROM isl GROUP BY k, g"""
)
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return intervals.interval_union(_spans(spark, d).select("k", "start", "end"), ["k"])


@query(
    "WITH "
    + SPANS_SQL
    + """SELECT a.k, count(*) AS overlap FROM pos a JOIN pos b ON a.k = b.k AND a.p = b.p
WHERE a.l_linestatus = 'O' AND b.l_linestatus = 'F' GROUP BY 1"""
)
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d)
    left = spans.where(F.col("l_linestatus") == "O").select("k", "start", "end")
    right = spans.where(F.col("l_linestatus") == "F").select("k", "start", "end")
    return intervals.interval_overlap(left, right, ["k"])


@query(
    "WITH "
    + SPANS_SQL
    + """, free AS (SELECT k, p FROM pos WHERE l_linestatus = 'O' EXCEPT SELECT k, p FROM pos WHERE l_linestatus = 'F')
SELECT k, count(*) AS uncovered, CAST(sum(p) AS BIGINT) AS position_sum FROM free GROUP BY 1"""
)
def interval_difference(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d)
    left = spans.where(F.col("l_linestatus") == "O").select("k", "start", "end")
    right = spans.where(F.col("l_linestatus") == "F").select("k", "start", "end")
    gaps = intervals.interval_difference(intervals.interval_union(left, ["k"]), right, ["k"])
    length = F.col("end") - F.col("start")
    return gaps.groupBy("k").agg(
        F.sum(length).alias("uncovered"),
        F.sum((F.col("start") + F.col("end") - 1) * length / 2).cast("long").alias("position_sum"),
    )


# --- corpus ----------------------------------------------------------------

NORMAL_SQL = f"sha256(replace(lower(trim(regexp_replace(text, '[{SPACE}]+', ' ', 'g'))), 'ß', 'ss'))"


@query(
    f"""WITH h AS (SELECT doc_id, {NORMAL_SQL} AS h FROM documents),
g AS (SELECT h, count(*) AS n FROM h GROUP BY 1)
SELECT count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS documents_excluded FROM g"""
)
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return corpus.duplicate_groups(documents(spark, d))


QUOTAS = {"en": [3, 3, 3, 3], "de": [2, 2, 2, 2], "fr": [2, 2, 2, 2], "es": [1, 1, 1, 1]}


@query(
    f"""WITH h AS (SELECT doc_id, lang, length(text) AS n, {NORMAL_SQL} AS h FROM documents),
u AS (SELECT * FROM h WHERE h IN (SELECT h FROM h GROUP BY 1 HAVING count(*) = 1) AND lang IN ('en', 'de', 'fr', 'es')),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n, sha256(CAST(doc_id AS VARCHAR))) AS rn,
  count(*) OVER (PARTITION BY lang) AS eligible FROM u),
z AS (SELECT *, CAST(ceil(4.0 * rn / eligible) AS INT) AS band FROM q),
p AS (SELECT *, sha256(concat('seed-1', chr(10), doc_id)) AS s FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, band ORDER BY s) AS position FROM p)
SELECT doc_id AS document_id, lang, CAST(n AS INT) AS n_characters, eligible, band, CAST(position AS INT) AS position, s AS selection_hash
FROM r WHERE position <= CASE lang WHEN 'en' THEN 3 WHEN 'es' THEN 1 ELSE 2 END"""
)
def stratified_selection(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stratified_select(
        documents(spark, d), QUOTAS, "seed-1", partition="lang"
    ).drop("text_hash")


PLAIN_MARKERS = [n for n in MARKERS if n not in ("phone_like", "ssn_like")]


@query(
    "SELECT doc_id AS document_id, "
    + ", ".join(
        f"CAST(len(regexp_extract_all(text, '(?i){MARKERS[n]}')) AS INT) AS {n}" for n in PLAIN_MARKERS
    )
    + " FROM documents"
)
def triage_markers(spark: SparkSession, d: str) -> DataFrame:
    return corpus.triage_markers(documents(spark, d), PLAIN_MARKERS)


# The SQL engine's patterns lack look-around. With every character but digits written
# twice, a pattern may take half of a neighbour and leave the other half to the next match.
TWICE_SQL = "regexp_replace(text, '([^0-9])', '\\1\\1', 'g')"
GAP_SQL = r"(?:--|\.\.|\s\s)"
CONTACT_SQL = {
    "phone_like": rf"(?:(?:\+\+)?1(?:{GAP_SQL})?)?(?:\(\([0-9]{{3}}\)\)|[0-9]{{3}}){GAP_SQL}[0-9]{{3}}{GAP_SQL}[0-9]{{4}}",
    "ssn_like": r"[0-9]{3}--[0-9]{2}--[0-9]{4}",
}


@query(
    "WITH t AS (SELECT doc_id, "
    + TWICE_SQL
    + " AS twice FROM documents) SELECT doc_id AS document_id, "
    + ", ".join(
        f"CAST(len(regexp_extract_all(twice, '(?:^|[^0-9]){p}(?:$|[^0-9])')) AS INT) AS {n}" for n, p in CONTACT_SQL.items()
    )
    + " FROM t"
)
def triage_contacts(spark: SparkSession, d: str) -> DataFrame:
    """The families that need look-around, which the SQL engine's patterns lack."""
    return corpus.triage_markers(documents(spark, d), ["phone_like", "ssn_like"])


def _masked_sql(text: str) -> str:
    """``mask_contacts`` in SQL; a tag is a private sign until all patterns have run."""
    out = f"regexp_replace({text}, '(?i){MARKERS['email']}', chr(57344), 'g')"
    out = f"regexp_replace({out}, '([^0-9' || chr(57344) || '])', '\\1\\1', 'g')"
    for sign, pattern in ((57345, CONTACT_SQL["phone_like"]), (57346, CONTACT_SQL["ssn_like"])):
        out = f"regexp_replace({out}, '(^|[^0-9]){pattern}($|[^0-9])', '\\1' || chr({sign}) || '\\2', 'g')"
    tags = "' || chr(57344) || chr(57345) || chr(57346) || '"
    out = f"regexp_replace({out}, '([^0-9{tags}])[^0-9{tags}]', '\\1', 'g')"
    for sign, name in ((57344, "EMAIL"), (57345, "PHONE_LIKE"), (57346, "SSN_LIKE")):
        out = f"replace({out}, chr({sign}), '[{name}]')"
    return out


def _previews_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id AS document_id, '{n}' AS kind, text, "
        f"list_transform(regexp_extract_all(text, '(?i){MARKERS[n]}'), lambda x: length(x)) AS h, "
        f"list_transform(string_split_regex(text, '(?i){MARKERS[n]}'), lambda x: length(x)) AS g FROM documents"
        for n in PREVIEW_MARKERS
    )
    return f"""WITH f AS ({found}),
u AS (SELECT *, unnest(range(least(len(h), {PREVIEW_HITS}))) AS hit FROM f),
p AS (SELECT *, list_sum(g[1:hit + 1]) + coalesce(list_sum(h[1:hit]), 0) AS found FROM u),
w AS (SELECT *, greatest(0, found - {PREVIEW_BEFORE}) AS a, least(length(text), found + h[hit + 1] + {PREVIEW_AFTER}) AS b FROM p)
SELECT document_id, kind, CAST(hit AS INT) AS hit, CAST(a AS INT) AS "start", CAST(b AS INT) AS "end",
  {_masked_sql("substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT))")} AS preview FROM w"""


@query(_previews_sql())
def triage_previews(spark: SparkSession, d: str) -> DataFrame:
    return corpus.triage_previews(documents(spark, d))


@query(
    f"""WITH m AS (SELECT doc_id AS document_id, text, {_masked_sql("text")} AS masked FROM documents)
SELECT document_id, sha256(masked) AS masked_hash, CAST(length(masked) AS INT) AS characters FROM m WHERE masked <> text"""
)
def masked_contacts(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    masked = mask_contacts("text")
    return docs.where(masked != F.col("text")).select(
        "document_id", F.sha2(masked, 256).alias("masked_hash"), F.length(masked).alias("characters")
    )


@query(
    f"""WITH m AS MATERIALIZED (SELECT doc_id, b.text AS passage, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
o AS (SELECT doc_id, text, passage, unnest(range(length(text) - length(passage) + 1)) AS s FROM m),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + length(passage))) AS pos FROM o WHERE substr(text, s + 1, length(passage)) = passage),
ch AS (SELECT doc_id, unnest(range(length(text))) AS pos, text FROM (SELECT DISTINCT doc_id, text FROM m)),
x AS (SELECT ch.doc_id, pos, substr(text, pos + 1, 1) AS c, c.pos IS NOT NULL AS gone FROM ch LEFT JOIN c USING (doc_id, pos))
SELECT doc_id AS document_id, CAST(count(*) AS INT) AS characters,
  sha256(string_agg(CASE WHEN gone AND NOT regexp_matches(c, '[{SPACE}]') THEN 'X' ELSE c END, '' ORDER BY pos)) AS masked_hash
FROM x GROUP BY doc_id"""
)
def masked_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every place of every passage masked."""
    docs = documents(spark, d)
    masks = cut_lineage(passage_spans(passage_occurrences(b.table(spark, d, "benchmark"), docs)))
    held = docs.join(masks.select("document_id"), "document_id", "left_semi")
    return corpus.mask_spans(held, masks).select(
        "document_id",
        F.length("text").alias("characters"),
        F.sha2("text", 256).alias("masked_hash"),
    )


# The SQL engine's edit distance works on bytes. So every letter beyond ASCII becomes a
# control character that does not occur, a byte of its own.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüÀàâáÁôîû"
CONTROLS = [*range(1, 9), 11, 12, *range(14, 32), 127]
ONE_BYTE_SQL = f"translate(text, '{LETTERS}', {' || '.join(f'chr({c})' for c, _ in zip(CONTROLS, LETTERS))})"


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, {ONE_BYTE_SQL} AS text FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN greatest(length(a.text), length(b.text)) = 0 THEN 0.0
  ELSE levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)) END, 6) AS edit_ratio
FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"""
)
def edit_ratio_by_conversation(spark: SparkSession, d: str) -> DataFrame:
    """Each answer against its question."""
    turns = b.table(spark, d, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("a"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")
    )
    out = asked.join(answered, ["conv_id", "turn"]).select(
        "conv_id", "turn", edit_ratio("a", "b").alias("edit_ratio")
    )
    return rounded(out, "edit_ratio")


@query(
    """SELECT page_id, sha256(concat('{"html":', to_json(html), ',"page_id":', page_id, ',"url":', to_json(url), '}')) AS record_hash
FROM pages"""
)
def canonical_hashes(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import canonical_hash, sorted_struct

    pages = b.table(spark, d, "pages")
    return pages.select("page_id", canonical_hash(sorted_struct("url", "page_id", "html")).alias("record_hash"))


# --- evidence answers --------------------------------------------------------


def _responses(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Scripted answers in every state: exact, shifted, abstaining, failed, misquoted."""
    item = F.col("source_qa_id").cast("int")
    n = F.length("text")
    start = F.when(F.col("is_impossible"), F.lit(0)).otherwise(F.get("answers", 0)["answer_start"])
    size = F.length("query")
    shift = F.when(item % 5 == 1, 7).when(item % 5 == 2, 25).otherwise(0)
    begin = F.least(start + shift, n - 1)
    finish = F.least(begin + size, n)
    quote = F.substring(F.col("text"), begin + 1, finish - begin)
    misquoted = item % 7 == 3
    span = F.struct(
        begin.cast("int").alias("start"),
        finish.cast("int").alias("end"),
        F.when(misquoted, F.concat(quote, F.lit("!"))).otherwise(quote).alias("quote"),
    )
    silent = F.col("is_impossible") & (item % 2 == 0)
    failed = item % 11 == 5
    none = F.array().cast("array<struct<start:int,end:int,quote:string>>")
    return (
        asked.where(item % 13 != 6)
        .join(docs.select("document_id", "text"), "document_id")
        .select(
            "case_id",
            "document_id",
            F.when(failed, "error").otherwise("ok").alias("status"),
            F.when(~failed, silent).alias("abstain"),
            F.when(failed | silent, none).otherwise(F.array(span)).alias("spans"),
        )
    )


GRADE_SQL = (
    "WITH "
    + QUESTIONS_SQL
    + """, shown AS (SELECT q.*, d.text, item_id % 13 <> 6 AS sent, item_id % 11 = 5 AS failed,
    is_impossible AND item_id % 2 = 0 AS silent, item_id % 7 = 3 AS misquoted,
    least(coalesce(answer_start, 0) + CASE item_id % 5 WHEN 1 THEN 7 WHEN 2 THEN 25 ELSE 0 END, document_characters - 1) AS bg,
    length(query) AS size FROM questions q JOIN docs d USING (document_id)),
g AS (SELECT *, least(bg + size, document_characters) AS fin,
  CASE WHEN NOT sent THEN 'missing' WHEN failed THEN 'error' WHEN silent THEN 'valid'
       WHEN misquoted OR NOT regexp_matches(substr(text, CAST(bg AS BIGINT) + 1, CAST(least(bg + size, document_characters) - bg AS BIGINT)), '[^"""
    + SPACE
    + """]') THEN 'invalid' ELSE 'valid' END AS state FROM shown),
h AS (SELECT *, CASE WHEN state = 'valid' AND NOT silent AND NOT is_impossible THEN
    greatest(0, least(fin, answer_end) - greatest(bg, answer_start)) ELSE 0 END AS hit FROM g),
graded AS (SELECT case_id, document_id, category, is_impossible, state AS response_state,
  CASE WHEN state <> 'valid' THEN state WHEN is_impossible THEN CASE WHEN silent THEN 'correct_abstention' ELSE 'false_answer' END
    WHEN hit = fin - bg AND hit = answer_end - answer_start THEN 'exact_evidence' WHEN hit > 0 THEN 'partial_evidence'
    ELSE 'off_target_evidence' END AS outcome,
  is_impossible AND state = 'valid' AND silent AS correct_abstention, false AS incorrect_abstention,
  is_impossible AND state = 'valid' AND NOT silent AS false_answer,
  CASE WHEN NOT is_impossible THEN CASE WHEN state = 'valid' THEN hit / (fin - bg) ELSE 0 END END AS p,
  CASE WHEN NOT is_impossible THEN hit / (answer_end - answer_start) END AS r,
  CASE WHEN NOT is_impossible THEN hit = answer_end - answer_start END AS covered,
  CASE WHEN NOT is_impossible THEN hit > 0 AND hit = fin - bg AND hit = answer_end - answer_start END AS exact FROM h)
"""
)


def _graded(spark: SparkSession, d: str) -> DataFrame:
    asked = cut_lineage(questions(spark, d)[0])
    docs = documents(spark, d).join(
        asked.select("document_id").distinct(), "document_id", "left_semi"
    )
    cases = asked.select("case_id", "document_id", "category", "is_impossible", "answers")
    return scoring.grade_evidence(cases, _responses(asked, docs), docs)


@query(
    GRADE_SQL
    + """SELECT case_id, document_id, category, is_impossible, response_state, outcome, correct_abstention, incorrect_abstention,
  false_answer, round(p, 6) AS evidence_precision, round(r, 6) AS evidence_recall,
  CASE WHEN NOT is_impossible THEN round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) END AS evidence_f1,
  covered AS all_gold_covered, exact AS exact_evidence_union FROM graded"""
)
def evidence_grades(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_graded(spark, d), "evidence_precision", "evidence_recall", "evidence_f1")


@query(
    GRADE_SQL.rstrip()
    + """, s AS (SELECT category, count(*) AS expected, count(*) FILTER (WHERE response_state = 'valid') AS valid,
  count(*) FILTER (WHERE response_state = 'missing') AS missing, count(*) FILTER (WHERE response_state = 'invalid') AS invalid,
  count(*) FILTER (WHERE response_state = 'error') AS error, count(*) FILTER (WHERE NOT is_impossible) AS answerable,
  round(avg(r), 6) AS evidence_recall_macro, round(avg(CAST(exact AS INT)), 6) AS exact_evidence_union_rate,
  count(*) FILTER (WHERE is_impossible) AS unanswerable, count(*) FILTER (WHERE false_answer) AS false_answer_count,
  round(avg(CAST(false_answer AS INT)) FILTER (WHERE is_impossible), 6) AS false_answer_rate
  FROM graded GROUP BY GROUPING SETS ((), (category)))
SELECT *, category IS NULL AS is_overall FROM s"""
)
def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    df = scoring.summarize_evidence(cut_lineage(_graded(spark, d)))
    names = [
        "category",
        "is_overall",
        "expected",
        "valid",
        "missing",
        "invalid",
        "error",
        "answerable",
        "evidence_recall_macro",
        "exact_evidence_union_rate",
        "unanswerable",
        "false_answer_count",
        "false_answer_rate",
    ]
    return rounded(
        df.select(*names), "evidence_recall_macro", "exact_evidence_union_rate", "false_answer_rate"
    )


@query(
    "WITH "
    + QUESTIONS_SQL
    + """, moved AS (SELECT *, answer_start + (item_id % 3) * 700 AS s FROM questions WHERE NOT is_impossible)
SELECT case_id, CAST(s AS INT) AS "start", CASE WHEN s + length(query) > document_characters THEN 'invalid_offsets'
  ELSE 'quote_mismatch' END AS reason FROM moved JOIN docs USING (document_id)
WHERE s + length(query) > document_characters OR substr(text, CAST(s AS BIGINT) + 1, length(query)) <> query
UNION ALL SELECT case_id, NULL, 'invalid_reference' FROM questions WHERE is_impossible AND item_id % 2 = 0"""
)
def gold_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Offsets moved by 0, 700 or 1400 characters, and flags that contradict the answers."""
    item = F.col("source_qa_id").cast("int")
    moved = F.transform(
        "answers",
        lambda a: F.struct(
            (a["answer_start"] + item % 3 * 700).cast("int").alias("answer_start"),
            a["text"].alias("text"),
        ),
    )
    wrong = F.col("is_impossible") & (item % 2 == 0)
    asked = questions(spark, d)[0].withColumn("answers", moved)
    asked = asked.withColumn("is_impossible", F.col("is_impossible") & ~wrong)
    return scoring.gold_mismatches(asked, documents(spark, d))


# --- diagnostics -------------------------------------------------------------


def _diagnosis(spark: SparkSession, d: str) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    run = retrieval(spark, d, reach="all")
    run |= {name: cut_lineage(run[name]) for name in ("proposals", "narrow")}
    context = contexts(run)
    chosen = context.where(F.col("config_id") == "candidate").drop("config_id")
    gold = scoring.gold_spans(run["references"], run["docs"])
    return run, context, chosen, gold


DIAGNOSIS_SQL = (
    SCORES_SQL.rstrip()
    + f""", cutp AS (SELECT case_id, max(rank) AS last_rank FROM ctx_b GROUP BY 1 HAVING count(*) >= {BUDGET}),
deferred AS (SELECT o.case_id, count(*) AS cut FROM ctx_b_p p JOIN cutp USING (case_id)
  JOIN (SELECT DISTINCT case_id, pos FROM ctx_b_o) o ON o.case_id = p.case_id AND o.pos >= p.s AND o.pos < p.e
  JOIN questions q ON q.case_id = o.case_id AND o.pos >= answer_start AND o.pos < answer_end
  LEFT JOIN ctx_b c ON c.case_id = o.case_id AND c.pos = o.pos
  WHERE p.rank = cutp.last_rank AND c.pos IS NULL GROUP BY 1)
"""
)


REGIONS_SQL = (
    DIAGNOSIS_SQL.rstrip()
    + f""", reg AS (SELECT case_id, query, answer_start AS s, answer_end AS e FROM questions WHERE NOT is_impossible),
inc AS (SELECT r.*, hit AS covered FROM reg r JOIN sc_b USING (case_id) WHERE hit < gold),
used AS (SELECT case_id, count(*) AS used, max(rank) AS last_rank FROM ctx_b GROUP BY 1),
touch AS (SELECT i.case_id, min(w.rank) AS best,
    bool_or((coalesce(used, 0) < {BUDGET} OR w.rank <= last_rank) AND (("start" > s AND "start" < e) OR ("end" > s AND "end" < e))) AS edge
  FROM inc i JOIN wide_r w ON w.case_id = i.case_id AND "start" < e AND s < "end" LEFT JOIN used u ON u.case_id = i.case_id GROUP BY 1),
gone AS (SELECT case_id, pos, pos - row_number() OVER (PARTITION BY case_id ORDER BY pos) AS g
  FROM (SELECT case_id, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT))) AS pos FROM inc) ANTI JOIN ctx_b USING (case_id, pos)),
frag AS (SELECT case_id, count(DISTINCT g) AS missing_fragments, count(*) AS missing_characters FROM gone GROUP BY 1),
toks AS (SELECT i.case_id, list_sort(list_distinct(list_intersect(regexp_extract_all(replace(lower(i.query), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+'),
    regexp_extract_all(replace(lower(substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')))) AS terms
  FROM inc i JOIN questions USING (case_id) JOIN docs USING (document_id)),
regions AS (SELECT i.case_id, i.s, i.e, covered, best, coalesce(edge, false) AND covered > 0 AS shares, terms, missing_fragments, missing_characters
  FROM inc i LEFT JOIN touch USING (case_id) LEFT JOIN frag USING (case_id) LEFT JOIN toks USING (case_id)),
cases AS (SELECT s.case_id, s.document_id, s.category, NOT s.is_impossible AS is_answerable, coalesce(gold, 0) AS gold_characters,
  CAST(CASE WHEN s.is_impossible THEN 0 ELSE 1 END AS BIGINT) AS gold_regions, s.retrieved_characters AS context_characters,
  coalesce(gold - hit, 0) AS missing_gold_characters, coalesce(cut, 0) AS missing_in_budget_cut,
  coalesce(gold - hit, 0) - coalesce(cut, 0) AS missing_elsewhere,
  coalesce(gold, 0) > least({BUDGET}, s.document_characters) AS gold_exceeds_budget,
  CAST(CASE WHEN r.case_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS incomplete_regions, coalesce(covered > 0, false) AS partially_covered_region,
  coalesce(shares, false) AS partial_region_shares_window_boundary, coalesce(covered = 0 AND len(terms) = 0, false) AS missed_without_query_term
FROM sc_b s LEFT JOIN deferred USING (case_id) LEFT JOIN regions r USING (case_id))
"""
)


@query(REGIONS_SQL + "SELECT * FROM cases")
def failure_cases(spark: SparkSession, d: str) -> DataFrame:
    run, _, chosen, gold = _diagnosis(spark, d)
    return diagnostics.case_diagnostics(gold, chosen, run["proposals"], run["tasks"], run["docs"], BUDGET)


@query(
    REGIONS_SQL
    + """SELECT case_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", covered AS covered_characters,
  CAST(best AS INT) AS best_overlapping_chunk_rank, array_to_string(terms, ' ') AS query_terms_in_region, missing_fragments,
  missing_characters, shares AS shares_reached_window_boundary FROM regions"""
)
def failure_regions(spark: SparkSession, d: str) -> DataFrame:
    """Gold regions that the candidate's context covers in part or not at all."""
    run, _, chosen, gold = _diagnosis(spark, d)
    df = diagnostics.region_diagnostics(gold, chosen, run["proposals"], run["tasks"], run["docs"], BUDGET)
    return df.withColumn("query_terms_in_region", F.array_join("query_terms_in_region", " "))


@query(
    REGIONS_SQL
    + """, f AS (SELECT *, is_answerable AND missing_gold_characters > 0 AS failed FROM cases)
SELECT count(*) AS tasks, count(*) FILTER (WHERE is_answerable) AS answerable, count(*) FILTER (WHERE failed) AS incomplete,
  count(*) FILTER (WHERE failed AND gold_regions > 1) AS multiple_gold_regions,
  count(*) FILTER (WHERE failed AND gold_exceeds_budget) AS gold_exceeds_budget,
  count(*) FILTER (WHERE failed AND missing_in_budget_cut > 0) AS budget_cut_meets_gold,
  count(*) FILTER (WHERE failed AND partially_covered_region) AS partially_covered_region,
  count(*) FILTER (WHERE failed AND partial_region_shares_window_boundary) AS partial_region_shares_window_boundary,
  count(*) FILTER (WHERE failed AND missed_without_query_term) AS missed_without_query_term,
  count(*) FILTER (WHERE NOT is_answerable AND context_characters > 0) AS negative_contexts_returned FROM f"""
)
def failure_features(spark: SparkSession, d: str) -> DataFrame:
    run, _, chosen, gold = _diagnosis(spark, d)
    return diagnostics.failure_features(
        diagnostics.case_diagnostics(gold, chosen, run["proposals"], run["tasks"], run["docs"], BUDGET)
    )


@query(
    SCORES_SQL.rstrip()
    + """, ch AS (SELECT c.case_id, CASE WHEN c.recall > a.recall THEN 'improved' WHEN c.recall < a.recall THEN 'regressed'
    ELSE 'unchanged' END AS change FROM scores a JOIN scores c USING (case_id)
  WHERE a.config_id = 'baseline' AND c.config_id = 'candidate' AND NOT a.is_impossible),
m AS (SELECT s.case_id, s.category, change, CASE WHEN is_impossible THEN 'negative' WHEN hit < gold THEN 'failure' ELSE 'control' END AS pool
  FROM sc_b s LEFT JOIN ch USING (case_id)),
f AS (SELECT pool, category, min(case_id) AS case_id FROM m WHERE pool <> 'failure' GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY category) AS i FROM f)
SELECT CAST(CASE pool WHEN 'failure' THEN CASE WHEN change = 'regressed' THEN 0 ELSE 1 END WHEN 'negative' THEN 2 ELSE 3 END AS INT) AS stage,
  pool, category, case_id, change FROM m WHERE pool = 'failure' OR case_id IN (SELECT case_id FROM k WHERE i <= 3)"""
)
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    run, context, chosen, gold = _diagnosis(spark, d)
    cases = diagnostics.case_diagnostics(
        gold, chosen, run["proposals"], run["tasks"], run["docs"], BUDGET
    )
    changes = scoring.paired_changes(
        score(run, context, ["baseline", "candidate"]), "baseline", "candidate"
    )
    return diagnostics.review_queue(cut_lineage(cases), changes)


@query(
    """SELECT doc_id AS document_id, sha256(replace(lower(trim(regexp_replace(text, '["""
    + SPACE
    + """]+', ' ', 'g'))), 'ß', 'ss')) AS text_hash FROM documents"""
)
def normalized_hashes(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(
        "document_id", F.sha2(normalized("text"), 256).alias("text_hash")
    )
