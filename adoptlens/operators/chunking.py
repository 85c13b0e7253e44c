"""Document units: overlapping word windows and sentence-like units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import with_running_sums
from ..functions.text import NONSPACE, SPACE


def chunk(
    docs: DataFrame,
    words: int,
    overlap: int,
    doc: str = "document_id",
    text: str = "text",
) -> DataFrame:
    """Windows of ``words`` words, ``words - overlap`` apart, as (doc, chunk_no, start,
    end, chunk_text). A window ends where the next unseen word starts, the first one
    starts at 0 and the last one ends with the text, so windows leave no gap. A text
    without words has no chunk (see ``empty_documents``).

    Works inside the document's row: the text is cut once into blocks of
    gcd(step, words) words, and windows are slices of the block list.
    """
    if not 1 <= words or not 0 <= overlap < words:
        raise ValueError("chunk needs words >= 1 and 0 <= overlap < words")
    step = words - overlap
    size = _gcd(step, words)
    per_step, per_window = step // size, words // size
    block = rf"(?U)(?:{NONSPACE}++{SPACE}*+){{1,{size}}}+"
    lead = F.length(F.regexp_extract(text, f"(?U)^{SPACE}*", 0))
    cut = F.struct(
        F.length(text).alias("__len"),
        lead.alias("__lead"),
        F.regexp_extract_all(text, F.lit(block), F.lit(0)).alias("__blocks"),
    )
    # one-element generators: each step is computed once, not once per use
    parts = docs.select(doc, F.inline(F.array(cut))).where(F.size("__blocks") > 0)
    blocks = F.size("__blocks")
    last = F.greatest(F.lit(0), F.ceil((blocks - per_window) / F.lit(per_step))).cast("int")

    def window(i: Column) -> Column:
        first, after = i * per_step, i * per_step + per_window
        start = F.when(i == 0, F.lit(0)).otherwise(F.get("__starts", first))
        end = F.when(i == last, F.col("__len")).otherwise(F.get("__starts", after))
        body = F.array_join(F.slice("__blocks", first + 1, F.lit(per_window)), "")
        return F.struct(
            i.alias("chunk_no"), start.alias("start"), end.alias("end"), body.alias("chunk_text")
        )

    windows = F.transform(F.sequence(F.lit(0), last), window)
    return (
        with_running_sums(parts, F.transform("__blocks", F.length), F.col("__lead"), "__starts")
        .select(doc, F.explode(windows).alias("__w"))
        .select(doc, "__w.chunk_no", "__w.start", "__w.end", "__w.chunk_text")
    )


def empty_documents(docs: DataFrame, doc: str = "document_id", text: str = "text") -> DataFrame:
    """Documents that cannot be indexed: error rows for the caller's report."""
    return docs.where(~F.col(text).rlike(f"(?U){NONSPACE}")).select(
        doc, F.lit("error").alias("status"), F.lit("empty_document").alias("error_type")
    )


def sentence_units(docs: DataFrame, doc: str = "document_id", text: str = "text") -> DataFrame:
    """A partition of the text into units that end with sentence punctuation or a line
    break, whitespace kept with the unit before it."""
    piece = rf"(?U)[^.!?\n]*+(?:[.!?\n]++{SPACE}*+|\z)"
    lengths = F.transform(
        F.filter(F.regexp_extract_all(text, F.lit(piece), F.lit(0)), lambda s: F.length(s) > 0),
        F.length,
    )
    # sums inside the row: no unit moves or is sorted
    ends = with_running_sums(docs.select(doc, text), lengths, F.lit(0), "__at")
    unit = F.arrays_zip(F.slice("__at", F.lit(1), F.size("__at") - 1).alias("start"), F.slice("__at", F.lit(2), F.size("__at") - 1).alias("end"))
    return ends.select(doc, F.inline(unit).alias("start", "end")).select(doc, F.col("start").cast("long"), F.col("end").cast("long"))


def unit_violations(
    units: DataFrame, docs: DataFrame, doc: str = "document_id", text: str = "text"
) -> DataFrame:
    """Units that do not partition their text: out of range, gap or overlap, missing end."""
    order = Window.partitionBy(doc).orderBy("start", "end")
    sizes = docs.select(doc, F.length(text).alias("__len"))
    checked = (
        units.withColumn("__prev", F.coalesce(F.lag("end").over(order), F.lit(0)))
        .withColumn("__next", F.lead("start").over(order))
        .join(sizes, doc)
    )
    problem = (
        F.when(
            (F.col("start") < 0) | (F.col("end") > F.col("__len")) | (F.col("start") >= F.col("end")),
            "out_of_range",
        )
        .when(F.col("start") < F.col("__prev"), "overlap")
        .when(F.col("start") > F.col("__prev"), "gap")
        .when(F.col("__next").isNull() & (F.col("end") < F.col("__len")), "unsegmented_tail")
    )
    found = checked.withColumn("violation", problem).where(F.col("violation").isNotNull())
    missing = (
        docs.join(units.select(doc).distinct(), doc, "left_anti")
        .where(F.length(text) > 0)
        .select(
            doc,
            F.lit(None).cast("int").alias("start"),
            F.lit(None).cast("int").alias("end"),
            F.lit("no_units").alias("violation"),
        )
    )
    return found.select(doc, "start", "end", "violation").unionByName(missing)


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a
