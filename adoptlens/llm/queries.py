"""One query per corpus operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adoptlens.session import cut_lineage, shared_dir

from . import mixing, sharding, sql, warc
from .common import table, whole_text
from .exact_dedup import exact_groups
from .fingerprints import fingerprint, fingerprints, with_likeness
from .language import held_out, learn, predict
from .lexical import build_index, search
from .lines import drop_lines
from .near_dedup import near_duplicates
from .packing import pack
from .repeats import remove_repeats
from .sharding import LAW
from .token_files import read_tokens, write_tokens
from .vector_codes import codebooks_sha256, vector_codes, with_label_error


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(table(spark, sf_dir, "documents")).withColumn("following", F.struct("next.anchors.hash"))
    rows = with_likeness(with_likeness(rows, "anchors", "edited_anchors", "near_edited"), "anchors", "following", "near_next")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = predict(documents, learn(documents))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        "score",
        F.array_join(F.transform("langs", lambda x: x["lang"]), ",").alias("lang_set"),
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", mixing.words(F.col("text")).alias("n"), mixing.draw(F.col("doc_id"), F.col("text")).alias("number")
    )
    rows = mixing.with_topic(documents, table(spark, sf_dir, "labels"))
    found = mixing.mix(
        rows, F.col("source"), F.col("lang"), F.col("__topic"), F.col("n"), F.col("number"), mixing.POWERS
    )
    return found.select("doc_id", "source", "lang", "mix.topic", F.col("n").alias("n_tokens"), "mix.probability", "mix.kept", "mix.on_target")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    # read several times; archives are parsed once
    records = cut_lineage(warc.read_records(spark, path, whole=False))
    found = warc.transactions(records).drop("http", "request", "payload")
    return warc.with_referred_page(found, records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to")
    )


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    old, new = shared_dir(spark, "shards-old"), shared_dir(spark, "shards-new")
    sharding.write_shards(documents, sharding.by_content(whole_text("text")), old)
    stored = sharding.read_shards(spark, old, documents.schema)
    placed = cut_lineage(sharding.reshard(stored, F.col("shard")))
    affected = sharding.rewrite_affected(sharding.with_file_row(stored).drop("shard"), placed, new)
    rows = sharding.layout(spark, documents.schema, old, new, affected)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes(table(spark, sf_dir, "embeddings"))
    return with_label_error(found.rows).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(codebooks_sha256(found.codebooks)).alias("codebooks_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 50)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_repeats": op2_repeats,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_language": op5_language,
    "op6_token_files": op6_token_files,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_resharding": op9_resharding,
    "op10_packing": op10_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_lexical_search": op12_lexical_search,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES = {
    "op2_repeats": sql.REPEATS,
    "op3_exact_dedup": sql.EXACT_DEDUP,
    "op4_near_dedup": sql.NEAR_DEDUP,
    "op7_mixing": sql.MIXING,
    "op8_warc": sql.WARC,
    "op11_vector_codes": sql.VECTOR_CODES,
    "op12_lexical_search": sql.LEXICAL_SEARCH,
    "op13_line_dedup": sql.LINE_DEDUP,
}
