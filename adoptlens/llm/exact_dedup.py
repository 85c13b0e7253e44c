"""Exact duplicates by content-defined chunk recipes.

A text is cut where its own bytes say so: one chosen bit of each of ten bytes makes a
rolling ten-bit hash, and a cut follows where it has a chosen value. The ten are the last
bytes, every second or every third, so that scripts whose letters share their first bytes
are cut as well, with or without blanks; at the earliest after ``least`` bytes, at the
latest after ``most``. Equal texts have equal cuts, and an edit moves only the cuts near it. A chunk's
identifier is its SHA-256; the distinct chunks are compared byte by byte once, so that one
identifier stands for one chunk. From then on a document is its recipe, the ordered list of
its identifiers, and no long text moves again: texts are equal when their recipes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adoptlens.session import cut_lineage

from .common import ascii_lower, whole_text

LEAST, MOST = 256, 8192
#: Steps between the bytes that count, and the (bit, value) that each of them must have
#: before a cut, oldest first.
STEPS = (1, 2, 3)
ROLLING = ((0, 1), (0, 0), (1, 1), (0, 1), (0, 0), (0, 0), (2, 1), (0, 1), (1, 0), (0, 1))


def _cut_pattern(least: int, most: int) -> str:
    """The next chunk of a text with one character per byte."""
    bits = ["[" + "".join(f"\\x{c:02X}" for c in range(256) if c >> bit & 1 == value) + "]" for bit, value in ROLLING]
    windows = "|".join(("." * (step - 1)).join(bits) for step in STEPS)
    longest = STEPS[-1] * (len(ROLLING) - 1) + 1
    return rf"(?s).{{{max(least - len(ROLLING), 0)},{most - longest}}}?(?:{windows})|.{{1,{most}}}"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order, as bytes; together they are the whole text. None for
    an empty one."""
    latin = F.decode(text.cast("binary"), "ISO-8859-1")
    pieces = F.regexp_extract_all(latin, F.lit(_cut_pattern(least, most)), F.lit(0))
    return F.transform(pieces, lambda piece: F.encode(piece, "ISO-8859-1"))


def identifier(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


def recipe(parts: Column) -> Column:
    """The identifiers of the chunks, one after the other, 32 bytes each."""
    return F.unhex(F.array_join(F.transform(parts, identifier), ""))


def verify_identifiers(texts: DataFrame, text: str) -> None:
    """Raises ValueError if one identifier stands for two different chunks.

    The distinct chunks meet by identifier and content; copies are dropped before the
    shuffle, so a chunk that a third of all documents share arrives once per task.
    """
    found = texts.select(F.explode(chunks(F.col(text))).alias("chunk"))
    distinct = found.select(F.unhex(identifier(F.col("chunk"))).alias("id"), "chunk").distinct()
    if not distinct.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("two different chunks have the same SHA-256")


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z only; null counts as
    empty. Of equal texts the row with the largest id stays. Rows that repeat an id are
    counted one by one and share the verdict of that id; a null id is smaller than any
    other and stays only in a group of nulls. Other columns are ignored. An empty table
    gives an empty result.
    """
    texts = documents.select(
        F.col(id_col).alias("doc_id"), ascii_lower(whole_text(F.col(text_col))).alias("norm")
    )
    verify_identifiers(texts, "norm")
    recipes = cut_lineage(
        texts.select(
            "doc_id",
            recipe(chunks(F.col("norm"))).alias("recipe"),
            F.sha2("norm", 256).alias("text_sha256"),
        )
    )
    # written, so that both sides of the join are plain shuffles and a recipe that a third of
    # all documents have can be split
    groups = cut_lineage(
        recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return recipes.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
