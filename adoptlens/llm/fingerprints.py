"""Document fingerprints by closed syncmers, in column expressions only.

Tokens are lower-cased runs without white space, of at most 24 code points, and single
signs of scripts that are written without spaces. A k-mer of ``K`` tokens is an anchor
when the smallest hash among its ``K - S + 1`` inner s-mers is that of its first or its
last one. Whether it is depends on the k-mer alone, not on its neighbours, so two texts
that share a stretch share its anchors, in the same order. About one k-mer in three is one.

A fingerprint is the list of the distinct anchors of a text, as 32-bit hashes in the order
in which they first occur. Two texts are matched by position: of the anchors that both
have, taken as the first text has them, those count that the second has in the same order,
each after the one before it. The likeness is their share of all anchors of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

#: The steps of ``with_anchors`` are laid out for these two.
K, S = 7, 2
#: Thai, Lao, Myanmar, Khmer, Japanese, Han. Ranges: a script would be looked up sign by sign.
SIGNS = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
TOKEN = rf"[{SIGNS}]|[^\s{SIGNS}]{{1,24}}"


def _shifted(values: str, by: int, n: Column) -> Column:
    """``values`` from its element ``by`` (from 0) on, ``n`` of them."""
    return F.slice(values, F.lit(by + 1), n)


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: struct<pos, hash>, two lists: where the anchors of ``text`` are, in
    tokens, and their hashes.

    A text that has tokens but no k-mer that is an anchor (any with fewer than K tokens, and
    some of K to K + 3) has one anchor, the hash of all its tokens; one without tokens has
    none. Each step is a column of its own, because Spark would evaluate an
    expression again for every element of an array that it is applied to.
    """
    keep = df.columns
    inner = K - S + 1

    def add(frame: DataFrame, **columns: Column) -> DataFrame:
        return frame.withColumns({f"__{name}": c for name, c in columns.items()})

    step = add(df, t=F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0)))
    step = add(step, h=F.transform("__t", lambda w: F.xxhash64(w)), n=F.size("__t"))
    pairs = F.greatest(F.col("__n") - (S - 1), F.lit(0))
    step = add(
        step,
        s=F.zip_with(_shifted("__h", 0, pairs), _shifted("__h", 1, pairs), lambda a, b: F.xxhash64(a, b)),
        m=F.greatest(F.col("__n") - (K - 1), F.lit(0)),
    )
    # the smallest of six s-mers: of two, of four, of both
    two = F.greatest(F.size("__s") - 1, F.lit(0))
    step = add(step, two=F.zip_with(_shifted("__s", 0, two), _shifted("__s", 1, two), lambda a, b: F.least(a, b)))
    four = F.greatest(F.size("__two") - 2, F.lit(0))
    step = add(step, four=F.zip_with(_shifted("__two", 0, four), _shifted("__two", 2, four), lambda a, b: F.least(a, b)))
    m = F.col("__m")
    step = add(
        step,
        low=F.zip_with(_shifted("__four", 0, m), _shifted("__two", inner - 2, m), lambda a, b: F.least(a, b)),
        edge=F.zip_with(_shifted("__s", 0, m), _shifted("__s", inner - 1, m), lambda a, b: F.least(a, b)),
        first=F.zip_with(_shifted("__s", 0, m), _shifted("__s", 2, m), lambda a, b: F.xxhash64(a, b)),
        rest=F.zip_with(_shifted("__s", 4, m), _shifted("__h", K - 1, m), lambda a, b: F.xxhash64(a, b)),
    )
    kmer = F.zip_with("__first", "__rest", lambda a, b: F.xxhash64(a, b))
    chosen = F.zip_with("__low", "__edge", lambda a, b: a == b)
    chosen = F.zip_with(kmer, chosen, lambda x, c: F.when(c, x))
    whole = F.shiftright(F.xxhash64(F.array_join("__t", " ")), 32).cast("int")
    found = F.filter(
        F.transform(
            chosen,
            lambda x, i: F.struct(i.alias("pos"), F.shiftright(x, 32).cast("int").alias("hash")),
        ),
        lambda a: a["hash"].isNotNull(),
    )
    short = F.filter(F.array(F.struct(F.lit(0).alias("pos"), whole.alias("hash"))), lambda a: F.col("__n") > 0)
    step = add(step, found=found)
    step = add(step, found=F.when(F.size("__found") > 0, F.col("__found")).otherwise(short))
    # two lists of numbers take a quarter of the room that a list of pairs takes
    anchors = F.struct(F.col("__found")["pos"].alias("pos"), F.col("__found")["hash"].alias("hash"))
    return step.select(*keep, anchors.alias(out))


def fingerprint(anchors: Column) -> Column:
    """The distinct anchors in order as a string, eight hexadecimal digits each."""
    digits = F.transform(F.array_distinct(anchors["hash"]), lambda h: F.lpad(F.lower(F.hex(_unsigned(h))), 8, "0"))
    return F.array_join(digits, "")


def _unsigned(h: Column) -> Column:
    return h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


#: Places of an anchor in its fingerprint, below its hash in one number.
PLACE = 30


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: the likeness of the anchors (a struct with ``hash``) in two columns,
    from 0 to 1; 1 for two texts without any. Each step is a column of its own.

    Hash, side and place of an anchor make one number, so sorting brings the two places of
    a shared anchor together; sorted again by the first, the second ones tell the order.
    """
    keep, low = df.columns, F.lit((1 << PLACE) - 1)

    def numbers(column: str, side: int) -> Column:
        base = lambda h: F.shiftleft(_unsigned(h), PLACE + 1)
        return F.transform(column, lambda h, i: base(h) + F.lit(side << PLACE) + i)

    def neighbours(column: str, with_next) -> Column:
        n = F.greatest(F.size(column) - 1, F.lit(0))
        return F.zip_with(_shifted(column, 0, n), _shifted(column, 1, n), with_next)

    step = df.withColumns({"__x": F.array_distinct(F.col(f"{a}.hash")), "__y": F.array_distinct(F.col(f"{b}.hash"))})
    step = step.withColumn("__both", F.sort_array(F.concat(numbers("__x", 0), numbers("__y", 1))))

    def met(one: Column, two: Column) -> Column:
        same = F.shiftright(one, PLACE + 1) == F.shiftright(two, PLACE + 1)
        return F.when(same, F.shiftleft(one.bitwiseAND(low), PLACE) + two.bitwiseAND(low))

    step = step.withColumn("__met", F.sort_array(F.array_compact(neighbours("__both", met))))
    after = neighbours("__met", lambda one, two: one.bitwiseAND(low) < two.bitwiseAND(low))
    step = step.withColumn("__after", after)
    in_order = F.size(F.filter("__after", lambda x: x)) + F.least(F.size("__met"), F.lit(1))
    union = F.size("__x") + F.size("__y") - F.size("__met")
    return step.select(*keep, F.when(union == 0, F.lit(1.0)).otherwise(in_order / union).alias(out))


#: Ranges of ids per task; they are dealt by hash, and this many even out.
RANGES = 8


def _edges(documents: DataFrame) -> list[float]:
    """Where to cut the ids into RANGES ranges per task, from the ids alone."""
    n = RANGES * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = documents.select(F.col("doc_id").cast("double").alias("doc_id"))
    shares = [k / n for k in range(1, n)]
    return sorted(set(ids.approxQuantile("doc_id", shares, min(0.01, 0.25 / n)))) if shares else []


def with_next(documents: DataFrame, order_text: str, carried: list[str]) -> DataFrame:
    """Adds ``next``, a struct of the ``carried`` columns of the next row by descending
    doc_id; the first row follows the last.

    Rows are dealt out by ranges of doc_id. A range also gets a copy of the row that its
    successor begins with. The driver sees the edges and one id per range, RANGES for
    each task. Rows that share a doc_id, and those without one, which come last, are
    ordered by ``order_text``.
    """
    edges = _edges(documents)
    upper = F.array(*map(F.lit, edges)).cast("array<double>")
    number = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    ranged = documents.withColumn("__range", F.size(F.filter(upper, lambda e: e >= number)))
    first = ranged.groupBy("__range").agg(F.max("doc_id").alias("head")).orderBy("__range").collect()
    if not first:
        return documents.withColumn("next", F.struct(*carried))
    row = lambda r, before: F.struct(
        F.lit(r["__range"]).alias("__range"), F.lit(r["head"]).cast("long").alias("__head"), F.lit(before).alias("__before")
    )
    heads = F.array(*(row(r, first[k - 1]["__range"]) for k, r in enumerate(first)))
    heads = documents.sparkSession.range(1).select(F.inline(heads))
    here = F.struct(F.col("__range").alias("range"), F.lit(0).alias("copy"))
    there = F.struct(F.col("__before").alias("range"), F.lit(1).alias("copy"))
    is_head = F.col("doc_id").eqNullSafe(F.col("__head"))
    rows = ranged.join(F.broadcast(heads), "__range").withColumn(
        "__at", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here)))
    )
    along = Window.partitionBy("__at.range").orderBy("__at.copy", F.desc_nulls_last("doc_id"), order_text)
    rows = rows.withColumn("next", F.lead(F.struct(*carried)).over(along))
    return rows.filter("__at.copy = 0").drop("__range", "__head", "__before", "__at")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many of the
    following text (all, if it has fewer)."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_positions: bool = False
) -> DataFrame:
    """One row per document: doc_id, text, anchors, next (text and anchors of the next
    document by descending doc_id; see ``with_next``), edited, edited_anchors. ``anchors`` and
    next.anchors move with their texts, so they have positions only if asked for.

    A null text is empty; texts without tokens have no anchors and are like each other.
    Equal texts have equal anchors. Repeated rows are rows of their own. Other columns are
    ignored. An empty table gives an empty result.
    """
    texts = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text")
    )
    rows = with_anchors(texts, "text", "anchors")
    if not with_positions:
        rows = rows.withColumn("anchors", F.struct(F.col("anchors.hash").alias("hash")))
    rows = with_next(rows, "text", ["text", "anchors"])
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next.text")))
    return with_anchors(rows, "edited", "edited_anchors")
