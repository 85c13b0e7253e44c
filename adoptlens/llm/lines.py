"""Lines that many documents share, dropped from all of them but one.

Lines are exploded as 16-byte hashes of their keys, with the document and the place in it;
distinct documents are counted per hash, and the places of a frequent line come back to
their documents as lists. Only hashes move by line. The texts move once, by document, and
are put together again from the places that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adoptlens.session import cut_lineage

from .common import ascii_lower, whole_text

BLANK = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCUMENTS = 40, 5


def lines_of(text: Column) -> Column:
    """The lines of a text; an empty text has one empty line."""
    return F.split(text, "\n", -1)


def key_hash(key: Column) -> Column:
    """Half of the key's SHA-256: it alone decides that two keys are equal."""
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def row_hash(text: Column) -> Column:
    """Tells apart texts whose rows have one id; equal rows lose the same lines."""
    return F.xxhash64(text)


def long_lines(texts: DataFrame, least_chars: int) -> DataFrame:
    """(hash, doc_id, row, place) of each line of (doc_id, row, text) whose key, the line
    without blanks at its ends and with A-Z lower-cased, has ``least_chars`` code points."""
    line = F.posexplode(lines_of(ascii_lower(F.col("text")))).alias("place", "line")
    found = texts.select("doc_id", "row", line).withColumn("key", F.btrim(F.col("line"), F.lit(BLANK)))
    found = found.filter(F.char_length("key") >= least_chars)
    return found.select(key_hash(F.col("key")).alias("hash"), "doc_id", "row", "place")


def frequent_lines(lines: DataFrame, least_documents: int) -> DataFrame:
    """(hash, n_documents, keep_id) of the lines in ``least_documents`` documents; keep_id is
    the largest of them. Documents are counted apart from lines, so a line that a third of
    all documents hold is added up in part on each task."""
    documents = lines.select("hash", "doc_id").distinct()
    # a null id is one document
    counted = documents.groupBy("hash").agg(F.count("*").alias("n_documents"), F.max("doc_id").alias("keep_id"))
    return counted.filter(F.col("n_documents") >= least_documents)


def drop_lines(
    documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_lines (before), n_dropped, kept_text.

    Null counts as empty, one empty line. Keys of at least ``least_chars`` code points found
    in at least ``least_documents`` documents lose all their lines, repeats in one document
    included, but those of the largest doc_id that holds them. Rows with one id are one
    document when documents are counted, and each loses its own lines; all rows without an
    id are one document, smaller than any other. Other columns are ignored. An empty table
    gives an empty result.
    """
    texts = documents.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    texts = texts.withColumn("row", row_hash(F.col("text")))
    lines = cut_lineage(long_lines(texts, least_chars))
    # written, so that a line that a third of all documents hold can be split in the join
    frequent = cut_lineage(frequent_lines(lines, least_documents).select("hash", "keep_id"))
    gone = lines.join(frequent, "hash").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    places = gone.groupBy("doc_id", "row").agg(F.collect_set("place").alias("gone"))
    places = places.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))
    found = texts.join(places, same, "left").withColumn("lines", lines_of(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept_text = F.array_join(F.transform(kept, lambda place: F.col("lines")[place]), "\n")
    return found.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept_text).alias("kept_text"),
    )
