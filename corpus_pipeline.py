"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that ``run`` writes as Parquet
to the shared folder and reads again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adoptlens.llm import mixing
from adoptlens.llm.common import ascii_lower, table, whole_text
from adoptlens.llm.exact_dedup import exact_groups
from adoptlens.llm.language import UNDETERMINED, learn, with_language
from adoptlens.llm.near_dedup import near_duplicates, survivors, text_key
from adoptlens.llm.packing import pack
from adoptlens.session import shared_dir

WORDS, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts and texts without a letter, and nothing else. The model learns from
    all labelled rows; where ``lang`` is null it becomes the language found, and stays null
    if there is no label to learn from."""
    told = with_language(docs, learn(docs, hold_out=False))
    found = F.col("__language.lang_pred")
    found = F.when(found != UNDETERMINED, found)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    told = told.filter(found.isNotNull() | has_letter)
    return told.withColumn("lang", F.coalesce("lang", found)).drop("__language")


def _row(doc_id: str, key: Column) -> Column:
    """One key without nulls for an id and what tells its texts apart: rows that meet by it
    and are counted by it move once."""
    return F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), key.cast("string"))


def _kept_once(docs: DataFrame, row: Column, kept: DataFrame) -> DataFrame:
    """The rows whose key is in ``kept`` (a column ``__kept``), each key once."""
    rows = docs.withColumn("__row", row)
    return rows.join(kept, F.col("__row") == F.col("__kept"), "left_semi").dropDuplicates(["__row"]).drop("__row")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays, once."""
    kept = exact_groups(docs).filter("kept").select(_row("doc_id", F.col("text_sha256")).alias("__kept"))
    return _kept_once(docs, _row("doc_id", F.sha2(ascii_lower(whole_text("text")), 256)), kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, once; a
    row without an id only where its group has none. Texts without words all stay."""
    kept = survivors(near_duplicates(docs, WORDS, PERCENT)).select(_row("doc_id", F.col("text_key")).alias("__kept"))
    return _kept_once(docs, _row("doc_id", text_key(F.col("text"))), kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics meet their target weights.
    ``lang`` is the language given or, without one, found."""
    # weights and draws are taken before labels are joined: what the cells need moves without texts
    weighed = docs.withColumns({"__tokens": mixing.words(F.col("text")), "__draw": mixing.draw(F.col("doc_id"), F.col("text"))})
    rows = mixing.with_topic(weighed, table(spark, sf_dir, "labels"))
    rows = mixing.mix(
        rows.withColumnRenamed("mix", "__own") if "mix" in docs.columns else rows,
        F.col("source"), F.col("lang"), F.col("__topic"), F.col("__tokens"), F.col("__draw"), mixing.POWERS,
    ).filter("mix.kept").drop("mix", "__topic", "__tokens", "__draw")
    return rows.withColumnRenamed("__own", "mix").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Languages, near duplicates and tokens are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path, out = shared_dir(spark, f"stage-{name}"), stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
