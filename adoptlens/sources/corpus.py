"""Nested question-answer files -> documents, tasks and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QA_SCHEMA = (
    "data array<struct<title:string,paragraphs:array<struct<context:string,"
    "qas:array<struct<id:string,question:string,is_impossible:boolean,"
    "answers:array<struct<answer_start:int,text:string>>>>>>>>"
)


def document_id(title: Column | str) -> Column:
    title = F.col(title) if isinstance(title, str) else title
    return F.concat(F.lit("doc-"), F.substring(F.sha2(title, 256), 1, 12))


def read_qa_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, questions). Questions hold gold and are split by ``split_gold``."""
    raw = spark.read.schema(QA_SCHEMA).option("multiLine", True).json(path)
    docs = raw.select(F.explode("data").alias("d")).select(
        F.col("d.title").alias("title"), F.posexplode("d.paragraphs").alias("paragraph", "p")
    )
    base = docs.select(
        "title",
        document_id("title").alias("document_id"),
        "paragraph",
        F.col("p.context").alias("text"),
        F.col("p.qas").alias("qas"),
    )
    documents = base.select("document_id", "title", "paragraph", "text")
    questions = base.select("document_id", F.explode("qas").alias("q")).select(
        "document_id",
        F.concat_ws("-", "document_id", F.substring(F.sha2("q.id", 256), 1, 24)).alias("case_id"),
        F.col("q.id").alias("source_qa_id"),
        F.element_at(F.split("q.id", "__"), -1).alias("category"),
        F.col("q.question").alias("question"),
        F.col("q.question").alias("query"),
        F.col("q.is_impossible").alias("is_impossible"),
        F.col("q.answers").alias("answers"),
    )
    return documents, questions


def corpus_violations(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """Structure errors: more than one paragraph, repeated titles or question ids,
    answers that contradict the flag, empty answers or negative offsets."""
    paragraphs = documents.where(F.col("paragraph") > 0).select(
        "document_id", F.lit("several_paragraphs").alias("problem")
    )
    titles = (
        documents.where(F.col("paragraph") == 0)
        .groupBy("document_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("document_id", F.lit("repeated_title").alias("problem"))
    )
    ids = (
        questions.groupBy("document_id", "source_qa_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("document_id", F.lit("repeated_question").alias("problem"))
    )
    flags = questions.where(F.col("is_impossible") != (F.size("answers") == 0)).select(
        "document_id", F.lit("answers_contradict_flag").alias("problem")
    )
    answers = questions.where(
        F.exists(
            "answers",
            lambda a: (F.coalesce(F.length(a["text"]), F.lit(0)) == 0)
            | F.coalesce(a["answer_start"] < 0, F.lit(True)),
        )
    ).select("document_id", F.lit("invalid_answer").alias("problem"))
    out = paragraphs
    for part in (titles, ids, flags, answers):
        out = out.unionByName(part)
    return out.distinct()


def partition_mismatches(
    full: DataFrame, parts: dict[str, DataFrame], key: str = "title", text: str = "text"
) -> DataFrame:
    """Documents in two partitions, in none, unknown to the full set, or with another text."""
    tagged = None
    for name, df in parts.items():
        part = df.select(key, F.sha2(text, 256).alias("__h"), F.lit(name).alias("__p"))
        tagged = part if tagged is None else tagged.unionByName(part)
    members = tagged.groupBy(key).agg(
        F.countDistinct("__p").alias("__parts"),
        F.min("__h").alias("__h0"),
        F.max("__h").alias("__h1"),
    )
    canonical = full.select(key, F.sha2(text, 256).alias("__h"))
    problem = (
        F.when(F.col("__h").isNull(), "unknown_document")
        .when(F.col("__parts").isNull(), "in_no_partition")
        .when(F.col("__parts") > 1, "in_two_partitions")
        .when((F.col("__h0") != F.col("__h")) | (F.col("__h1") != F.col("__h")), "text_differs")
    )
    return (
        canonical.join(members, key, "full")
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
        .select(key, "problem")
    )
