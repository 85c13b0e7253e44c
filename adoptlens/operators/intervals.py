"""Half-open intervals: union, overlap, difference, and equal-budget selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = 4096
#: Units of a block of the unit walk.
FOLD = 256


def _merge(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= reach, 0).otherwise(1)
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("__new", opens)
        .withColumn("__island", island)
        .groupBy(*keys, "__island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("__island")
    )


def interval_union(df: DataFrame, keys: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """Merged intervals per key; touching ones merge.

    Copies shrink on the map side, then intervals merge inside position buckets, so a
    hot key is spread over its buckets. Across buckets only one number each is carried:
    how far the buckets before it reach. With it, what a bucket's pieces lose to, and
    what they join with, is settled inside the bucket: the pieces that begin within that
    reach belong to the run that is open there, and a run is named by the bucket and
    piece in which it opened. Only the edge pieces of a run meet by that name.
    """
    keys = list(keys)
    longest = df.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    local = _merge(longest.withColumn("__b", F.floor(F.col("start") / bucket)), [*keys, "__b"])
    by_bucket = Window.partitionBy(*keys).orderBy("__b")
    reaches = (
        local.groupBy(*keys, "__b")
        .agg(F.max("end").alias("__max"), F.min("start").alias("__min"), F.max("start").alias("__last"))
        .withColumn("__reach", F.max("__max").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)))
        # a run that passes through opened in the last bucket whose last piece nothing before reaches
        .withColumn("__free", F.coalesce(F.col("__last") > F.col("__reach"), F.lit(True)))
        .withColumn(
            "__open",
            F.last(F.when(F.col("__free"), F.col("__last")), True).over(
                by_bucket.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb"), "__reach", "__open")
    )
    same = F.col("__b") == F.col("__kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = F.coalesce(F.col("start") <= F.col("__reach"), F.lit(False))
    return (
        local.join(reaches, same)
        .withColumn("__run", F.when(joined, F.col("__open")).otherwise(F.col("start")))
        .groupBy(*keys, "__run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("__run")
    )


def _in_buckets(df: DataFrame, bucket: int) -> DataFrame:
    first = F.floor(F.col("start") / bucket)
    last = F.floor((F.col("end") - 1) / bucket)
    return df.withColumn("__b", F.explode(F.sequence(first, last)))


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    bucket: int = BUCKET,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Pairs that share positions: ``__from`` and ``__part`` (length) of the shared piece.

    Joined on key and position bucket; a pair that spans buckets has one row, and one
    piece, in each. ``extra`` are further columns of ``left`` to keep.
    """
    keys = list(keys)
    a = _in_buckets(left.select(*keys, *extra, "start", "end"), bucket).withColumnsRenamed(
        {"start": "__ls", "end": "__le"}
    )
    b = _in_buckets(right, bucket).withColumnsRenamed({"start": "__rs", "end": "__re"})
    low, high = F.col("__b") * bucket, (F.col("__b") + 1) * bucket
    begin = F.greatest("__ls", "__rs", low)
    return (
        a.join(b, [*keys, "__b"])
        .withColumn("__from", begin)
        .withColumn("__part", F.least("__le", "__re", high) - begin)
        .where(F.col("__part") > 0)
    )


def interval_overlap(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    bucket: int = BUCKET,
) -> DataFrame:
    """Length shared by the unions of both sides, one row per key with any overlap.

    ``right`` may carry more keys than ``left`` (for example a configuration); the
    result is then per key of ``right``.
    """
    keys = list(keys)
    extra = [c for c in right.columns if c not in (*keys, "start", "end")]
    a = interval_union(left.select(*keys, "start", "end"), keys, bucket)
    b = interval_union(right.select(*keys, *extra, "start", "end"), [*keys, *extra], bucket)
    pairs = overlap_pairs(a, b, keys, bucket)
    return pairs.groupBy(*keys, *extra).agg(F.sum("__part").cast("long").alias("overlap"))


def interval_difference(
    whole: DataFrame, taken: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()
) -> DataFrame:
    """Pieces of ``whole`` that ``taken`` does not cover.

    ``extra`` are columns of ``whole`` kept on its pieces (a region id, for example);
    they must tell overlapping intervals of one key apart.
    """
    keys, extra = list(keys), list(extra)
    own = [*keys, *extra, "start", "end"]
    whole = whole.select(*own)
    cover = interval_union(taken.select(*keys, "start", "end"), keys)
    pieces = overlap_pairs(whole, cover, keys, extra=extra)
    covered = pieces.select(
        *keys,
        *extra,
        F.col("__ls").alias("start"),
        F.col("__le").alias("end"),
        F.col("__from").alias("cs"),
        (F.col("__from") + F.col("__part")).alias("ce"),
    )
    # every interval adds a zero-length cut at its end, so gaps run from cut to cut
    cuts = covered.unionByName(
        whole.select(*own, F.col("end").alias("cs"), F.col("end").alias("ce"))
    )
    order = Window.partitionBy(*own).orderBy("cs", "ce")
    previous = F.coalesce(F.lag("ce").over(order), F.col("start"))
    gaps = cuts.withColumn("__from", previous).where(F.col("__from") < F.col("cs"))
    return gaps.select(
        *keys, *extra, F.col("__from").alias("start"), F.col("cs").alias("end")
    )


def owned_segments(proposals: DataFrame, keys: Sequence[str], extra: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """Disjoint segments of the positions that proposals cover, cut at every start and end,
    with the best ``rank`` that covers each. ``extra`` are the same for all of a key."""
    own = [*keys, *extra]
    cuts = proposals.select(*own, F.explode(F.array("start", "end")).alias("start")).distinct()
    by_position = Window.partitionBy(*keys).orderBy("start")
    segments = (
        cuts.withColumn("end", F.lead("start").over(by_position))
        .where(F.col("end").isNotNull())
        .withColumn("__b", F.floor(F.col("start") / bucket))
    )
    covering = _in_buckets(proposals.select(*keys, "rank", "start", "end"), bucket).withColumnsRenamed(
        {"start": "__ps", "end": "__pe"}
    )
    return (
        segments.join(covering, [*keys, "__b"])
        .where((F.col("__ps") <= F.col("start")) & (F.col("start") < F.col("__pe")))
        .groupBy(*own, "start", "end")
        .agg(F.min("rank").alias("rank"))
    )


def budget_context(
    proposals: DataFrame,
    keys: Sequence[str],
    budget: Column | int | str,
    bucket: int = BUCKET,
) -> DataFrame:
    """The characters chosen by walking proposals in rank order under a budget.

    ``proposals``: keys, ``rank`` (unique per key), ``start``, ``end``. A character
    belongs to the best ranked proposal that covers it; owners are visited by rank
    and positions in source order until the budget is used; the last piece is cut.
    Returns keys, ``rank``, ``start``, ``end``, with ``deferred_end`` = the end the
    piece had before the cut, which only better ranked proposals limit. ``budget`` may
    be a column of ``proposals``.

    No position lies in more proposals than the deepest one of its key. Once better
    ranked proposals are longer together than that depth times the budget, the budget
    is full, and worse ones are left out; they change neither pieces nor their ends.
    """
    keys = list(keys)
    if isinstance(budget, int):
        limit = F.lit(budget)
    else:
        limit = F.col(budget) if isinstance(budget, str) else budget
    p = proposals.select(*keys, "rank", "start", "end", limit.cast("long").alias("__budget"))
    p = p.where(F.col("end") > F.col("start"))
    edge = F.array(
        F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d"))
    )
    sweep = Window.partitionBy(*keys).orderBy("__e.at", "__e.d").rowsBetween(Window.unboundedPreceding, 0)
    depth = (
        p.select(*keys, F.explode(edge).alias("__e"))
        .withColumn("__depth", F.sum("__e.d").over(sweep))
        .groupBy(*keys)
        .agg(F.max("__depth").alias("__depth"))
    )
    by_rank = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.col("end") - F.col("start")).over(by_rank), F.lit(0))
    p = (
        p.withColumn("__seen", seen)
        .join(depth, keys)
        .where(F.col("__seen") < F.col("__budget") * F.col("__depth"))
        .drop("__seen", "__depth")
    )
    owned = owned_segments(p, keys, ["__budget"], bucket)
    # neighbouring segments of one owner are one piece
    by_owner = Window.partitionBy(*keys, "rank").orderBy("start")
    touches = F.col("start") == F.lag("end").over(by_owner)
    pieces = (
        owned.withColumn("__new", F.when(touches, 0).otherwise(1))
        .withColumn("__piece", F.sum("__new").over(by_owner))
        .groupBy(*keys, "__budget", "rank", "__piece")
        .agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("deferred_end"))
        .drop("__piece")
    )
    walk = Window.partitionBy(*keys).orderBy("rank", "start")
    length = F.col("deferred_end") - F.col("start")
    before = F.coalesce(
        F.sum(length).over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        pieces.withColumn("__before", before)
        .where(F.col("__before") < F.col("__budget"))
        .withColumn("end", F.col("start") + F.least(length, F.col("__budget") - F.col("__before")))
        .select(*keys, "rank", "start", "end", "deferred_end")
    )


def unit_context(
    proposals: DataFrame, units: DataFrame, keys: Sequence[str], on: str, budget: Column | int | str
) -> DataFrame:
    """Whole units that meet the proposals, in rank then source order, each once;
    a unit that does not fit is skipped and shorter ones may still follow.

    ``budget`` may be a column of ``proposals``, the same for all of a key. Units meet
    disjoint segments that know their best rank, so overlapping proposals don't multiply
    them. Whether a unit fits depends on all units before it: a fold over the lengths of one
    case, bounded by one document. It holds one number and marks what it takes; once what is
    left is below the shortest unit it changes nothing any more.
    """
    keys = list(keys)
    limit = F.lit(budget) if isinstance(budget, int) else F.col(budget) if isinstance(budget, str) else budget
    p = proposals.select(*keys, on, "rank", "start", "end", limit.cast("long").alias("__budget"))
    p = p.where(F.col("end") > F.col("start"))
    extra = ["__budget", *([] if on in keys else [on])]
    s = _in_buckets(owned_segments(p, keys, extra), BUCKET).withColumnsRenamed({"start": "__ps", "end": "__pe"})
    u = _in_buckets(units.select(on, "start", "end"), BUCKET)
    meets = (
        s.join(u, [on, "__b"])
        .where((F.col("start") < F.col("__pe")) & (F.col("__ps") < F.col("end")))
        .groupBy(*keys, "__budget", "start", "end")
        .agg(F.min("rank").alias("rank"))
        # a unit longer than the budget is never taken
        .where(F.col("end") - F.col("start") <= F.col("__budget"))
    )
    unit = F.struct(*[F.col(c).cast("long").alias(c) for c in ("rank", "start", "end")])
    listed = meets.groupBy(*keys, "__budget").agg(F.array_sort(F.collect_list(unit)).alias("__u"))
    sizes = F.transform("__u", lambda x: x["end"] - x["start"])
    # per block of units what is left before it; then, block by block, which units fit
    blocks = listed.withColumn("__n", sizes).withColumn(
        "__blocks",
        F.transform(
            F.sequence(F.lit(1), F.size("__u"), F.lit(FOLD)), lambda i: F.slice("__n", i, F.lit(FOLD))
        ),
    )

    def left(before: Column, size: Column) -> Column:
        return F.when(size <= before, before - size).otherwise(before)

    def scan(start: Column, values: Column, step) -> Column:
        """What is left before each of ``values``, and after the last."""
        zero = F.struct(start.alias("now"), F.array().cast("array<bigint>").alias("all"))
        fold = F.aggregate(
            values, zero, lambda acc, v: F.struct(step(acc["now"], v).alias("now"), F.array_append(acc["all"], acc["now"]).alias("all"))
        )
        return fold["all"]

    through = lambda before, block: F.aggregate(block, before, left)
    opened = blocks.withColumn("__open", scan(F.col("__budget"), F.col("__blocks"), through))
    fits = F.flatten(
        F.transform(
            F.arrays_zip("__open", "__blocks"),
            lambda z: F.zip_with(scan(z["__open"], z["__blocks"], left), z["__blocks"], lambda before, size: size <= before),
        )
    )
    marked = opened.withColumn("__fits", fits)
    taken = F.explode(F.arrays_zip(F.col("__u").alias("u"), F.col("__fits").alias("fits")))
    return marked.select(*keys, taken.alias("__t")).where("__t.fits").select(*keys, "__t.u.rank", "__t.u.start", "__t.u.end")


def context_size(context: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unique characters of a context."""
    merged = interval_union(context, keys)
    return merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("characters"))
