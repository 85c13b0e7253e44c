"""Verbatim passages in documents: every occurrence of many passages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once, with_running_sums
from ..session import cut_lineage
from .intervals import interval_union

#: Inner words of a passage that make its key, and characters where it has none.
ANCHOR, CHARACTERS = 4, 8


def _words(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__at``, the place of each word; texts without words are left out."""
    lead = F.length(F.regexp_extract(text, r"^\s*", 0))
    pieces = F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0))
    return with_running_sums(df, F.transform(pieces, F.length), lead, "__at")


def _key(kind: str, size: int, *values: Column) -> Column:
    return F.xxhash64(F.lit(kind), F.lit(size), *values)


def _grams(docs: DataFrame, size: int) -> DataFrame:
    """(document_id, key, at): every run of ``size`` words and the number of its first word.
    Words are zipped with those after them, which Spark compiles, unlike a function per run."""
    n = F.size("__words")
    shifted = [F.slice("__words", F.lit(k + 1), n) for k in range(size)]
    runs = docs.where(n >= size).select("document_id", n.alias("__n"), F.posexplode(F.arrays_zip(*shifted)).alias("at", "__g"))
    key = _key("words", size, *[F.col("__g").getField(str(k)) for k in range(size)])
    return runs.where(F.col("at") <= F.col("__n") - size).select("document_id", key.alias("key"), "at")


def _pieces(docs: DataFrame, size: int) -> DataFrame:
    """The same for every run of ``size`` characters."""
    letters = F.split("text", "")
    runs = F.sequence(F.lit(0), F.length("text") - size)
    listed = once(docs.where(F.length("text") >= size), "__letters", letters)
    piece = F.transform(
        runs,
        lambda i: F.struct(_key("characters", size, F.array_join(F.slice("__letters", i + 1, F.lit(size)), "")).alias("key"), i.alias("at")),
    )
    return listed.select("document_id", F.inline(piece))


def passage_occurrences(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, document_id, passage, start) for every place where a document holds a
    passage verbatim; occurrences may overlap. Empty passages occur nowhere.

    A passage brings its inner words along, so up to ANCHOR of them are an equality key,
    hashed, that documents have wherever those words stand; a passage of fewer than three
    words is found by its first characters instead, and only documents' runs of those
    lengths are made that passages need. Places that share a key are then compared.
    """
    named = passages.where(F.length("text") > 0).select("item_id", F.col("text").alias("passage"))
    words = F.regexp_extract_all("passage", F.lit(r"\S+"), F.lit(0))
    size = F.least(F.lit(ANCHOR), F.size(words) - 2)
    inner = F.size(words) > 2
    # the first inner word stands after the first word and the blanks around it
    before = F.length(F.regexp_extract("passage", r"^\s*\S+\s+", 0))
    short = F.least(F.lit(CHARACTERS), F.length("passage"))
    keyed = named.select(
        "item_id",
        F.when(inner, size).otherwise(-short).alias("__size"),
        F.when(inner, F.xxhash64(F.lit("words"), size, F.slice(words, F.lit(2), size)))
        .otherwise(F.xxhash64(F.lit("characters"), short, F.expr("substring(passage, 1, least(8, length(passage)))")))
        .alias("key"),
        F.when(inner, before).otherwise(0).alias("__before"),
        F.length("passage").alias("__n"),
    )
    sizes = sorted(r[0] for r in keyed.select("__size").distinct().collect())
    held = docs.select("document_id", "text")
    cut = once(held, "__words", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).drop("text") if any(k > 0 for k in sizes) else None
    runs = [_grams(cut, k) if k > 0 else _pieces(held, -k) for k in sizes]
    if not runs:
        runs = [_pieces(held, 1)]
    found = runs[0]
    for more in runs[1:]:
        found = found.unionByName(more)
    met = found.join(keyed, "key").select("document_id", "item_id", "at", "__size", "__before", "__n").distinct()
    # written, so that its size decides whether texts move to it or it moves to the texts
    met = cut_lineage(met)

    def listed(some: Column) -> DataFrame:
        """A document meets its places once."""
        place = F.struct("item_id", "at", "__before", "__n")
        grouped = met.where(some).groupBy("document_id").agg(F.collect_list(place).alias("__p"))
        return held.join(grouped, "document_id")

    def quotes(rows: DataFrame, start: str) -> DataFrame:
        at = f"transform(__p, p -> named_struct('item_id', p.item_id, 'start', {start} - p.__before, 'n', p.__n))"
        placed = once(rows, "__q", F.filter(F.expr(at), lambda q: q["start"] >= 0))
        quote = F.transform("__q", lambda q: F.struct(q["item_id"].alias("item_id"), q["start"].alias("start"), F.substring(F.col("text"), q["start"] + 1, q["n"]).alias("quote")))
        return placed.select("document_id", F.inline(quote))

    # only texts with such a place need the places of their words
    quoted = quotes(_words(listed(F.col("__size") > 0), "text"), "get(__at, p.at)")
    quoted = quoted.unionByName(quotes(listed(F.col("__size") < 0), "p.at"))
    return quoted.join(named, "item_id").where(F.col("quote") == F.col("passage")).select("item_id", "document_id", "passage", "start")


def passage_spans(occurrences: DataFrame) -> DataFrame:
    """(document_id, start, end) of what passages cover, overlapping ones merged."""
    end = F.col("start") + F.length("passage")
    return interval_union(occurrences.select("document_id", "start", end.alias("end")), ["document_id"])
