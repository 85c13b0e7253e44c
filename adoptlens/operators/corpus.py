"""Document selection, gold separation, masking and triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import with_running_sums
from ..functions.exprs import col
from ..functions.text import (
    MARKERS,
    PREVIEW_AFTER,
    PREVIEW_BEFORE,
    PREVIEW_HITS,
    PREVIEW_MARKERS,
    marker_count,
    mask_characters,
    mask_contacts,
    normalized_hash,
)
from ..session import cut_lineage
from .ranking import global_rank


def dedupe_documents(
    docs: DataFrame, doc: str = "document_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """Documents whose normalized text occurs once: every member of a group of copies
    is left out. Texts are hashed in place and never shuffled; copies shrink to one
    counted hash on the map side, and the hashes that occur once pick their rows."""
    rows = docs.select(
        normalized_hash(text).alias("text_hash"),
        F.col(doc).alias(doc),
        F.length(text).alias("n_characters"),
        *[F.col(c) for c in keep],
    )
    counted = rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("__n"))
    once = counted.where(F.col("__n") == 1).select("text_hash")
    return rows.join(once, "text_hash", "left_semi").select(
        doc, "n_characters", *keep, "text_hash"
    )


def duplicate_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    groups = docs.groupBy(normalized_hash(text).alias("text_hash")).agg(
        F.count(F.lit(1)).alias("documents")
    )
    more = F.col("documents") > 1
    return groups.agg(
        F.count(F.when(more, 1)).alias("duplicate_groups"),
        F.sum(F.when(more, F.col("documents")).otherwise(0)).alias("documents_excluded"),
    )


def length_bands(
    docs: DataFrame, partition: str, length: str, identity: Column | str, bands: int = 4
) -> DataFrame:
    """Equal slices of each partition ordered by (length, SHA-256 of the identity):
    slice b ends at n*b//bands rows. Adds ``band`` (1-based) and ``eligible``."""
    sizes = docs.groupBy(partition).agg(F.count(F.lit(1)).alias("eligible"))
    hashed = docs.withColumn("__h", F.sha2(col(identity).cast("string"), 256)).withColumn(
        "__tie", F.conv(F.substring("__h", 1, 15), 16, 10).cast("long")
    )
    ranked = global_rank(
        hashed, length, "__tie", by=[partition], descending=False, tie_break=["__h"]
    )
    return (
        ranked.join(sizes, partition)
        .withColumn("band", F.ceil(bands * F.col("row_number") / F.col("eligible")).cast("int"))
        .drop("__h", "__tie", "row_number", "average_rank")
    )


def stratified_select(
    docs: DataFrame,
    quotas: dict[str, Sequence[int]],
    seed: str,
    partition: str = "partition",
    doc: str = "document_id",
    text: str = "text",
    exclude: DataFrame | None = None,
    allow_short: bool = False,
) -> DataFrame:
    """Seeded hash sample per partition and length band after removing copies and the
    ``exclude`` ids. ``quotas``: partition -> rows wanted per band. A stratum that can't
    fill its quota raises ValueError, unless ``allow_short``."""
    unique = dedupe_documents(docs, doc, text, [partition])
    if exclude is not None:
        unique = unique.join(exclude.select(doc).distinct(), doc, "left_anti")
    wanted = unique.where(F.col(partition).isin(*quotas))
    banded = length_bands(wanted, partition, "n_characters", doc)
    order = F.sha2(F.concat(F.lit(seed + "\n"), F.col(doc).cast("string")), 256)
    first = Window.partitionBy(partition, "band").orderBy("selection_hash")
    most = max(max(q) for q in quotas.values())
    table = F.create_map(
        *[
            part
            for name, values in quotas.items()
            for part in (F.lit(name), F.array(*[F.lit(v) for v in values]))
        ]
    )
    selected = (
        banded.withColumn("selection_hash", order)
        .withColumn("position", F.row_number().over(first))
        # the constant bound lets every task keep its own first rows before the shuffle
        .where(F.col("position") <= most)
        .where(F.col("position") <= F.element_at(F.element_at(table, F.col(partition)), F.col("band")))
    )
    if allow_short:
        return selected
    # no more rows than the quotas ask for
    selected = cut_lineage(selected)
    missing = short_strata(selected, quotas, partition).orderBy(partition, "band").collect()
    if missing:
        raise ValueError(f"too few documents: {[tuple(r) for r in missing]}")
    return selected


def short_strata(selected: DataFrame, quotas: dict[str, Sequence[int]], partition: str = "partition"):
    """Strata that could not fill their quota; empty when the selection is complete."""
    spark = selected.sparkSession
    wanted = spark.createDataFrame(
        [(name, b, q) for name, qs in quotas.items() for b, q in enumerate(qs, 1)],
        f"{partition} string, band int, quota int",
    )
    got = selected.groupBy(partition, "band").agg(F.count(F.lit(1)).alias("selected"))
    return (
        wanted.join(got, [partition, "band"], "left")
        .fillna(0, ["selected"])
        .where(F.col("selected") < F.col("quota"))
    )


def split_gold(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks without any answer column, and the references kept apart from them."""
    tasks = questions.select("case_id", "document_id", "category", "question", "query")
    references = questions.select(
        "case_id", "document_id", "source_qa_id", "is_impossible", "answers"
    )
    return tasks, references


def membership_mismatch(tasks: DataFrame, references: DataFrame) -> DataFrame:
    """Cases on one side only, or with different documents."""
    a = tasks.select("case_id", F.col("document_id").alias("task_document"))
    b = references.select("case_id", F.col("document_id").alias("reference_document"))
    return a.join(b, "case_id", "full").where(
        ~F.col("task_document").eqNullSafe(F.col("reference_document"))
    )


def require_no_gold(tasks: DataFrame) -> DataFrame:
    """Guards the execution input: answer columns must not be in the schema."""
    found = {"answers", "is_impossible"} & set(tasks.columns)
    if found:
        raise ValueError(f"gold columns in execution input: {sorted(found)}")
    return tasks


# --- masking ---------------------------------------------------------------


def mask_violations(docs: DataFrame, masks: DataFrame) -> DataFrame:
    """Masks that are out of range, overlap, or no longer match the reviewed text."""
    order = Window.partitionBy("document_id").orderBy("start", "end")
    checked = masks.withColumn("__prev", F.lag("end").over(order)).join(
        docs.select("document_id", "text"), "document_id", "left"
    )
    segment = F.expr("substring(text, cast(start as int) + 1, cast(end - start as int))")
    problem = (
        F.when(F.col("text").isNull(), "unknown_document")
        .when(
            (F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") >= F.col("end")),
            "out_of_range",
        )
        .when(F.col("start") < F.col("__prev"), "overlap")
        .when(F.col("segment_sha256") != F.sha2(segment, 256), "text_changed")
    )
    return checked.withColumn("violation", problem).where(F.col("violation").isNotNull()).select(
        "document_id", "start", "end", "violation"
    )


def mask_spans(docs: DataFrame, masks: DataFrame) -> DataFrame:
    """Texts with every masked character replaced by X; whitespace and length stay.

    The masks of a document are disjoint, so their list is bounded by its text.
    """
    listed = masks.groupBy("document_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")
                )
            )
        ).alias("__m")
    )

    def cut(start: Column, end: Column) -> Column:
        return F.substring(F.col("text"), start + 1, end - start)

    def piece(mask: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("__m"), i - 1)["end"])
        return F.concat(
            cut(before, mask["start"]), mask_characters(cut(mask["start"], mask["end"]))
        )

    tail = cut(F.element_at("__m", -1)["end"], F.length("text"))
    masked = F.concat(F.array_join(F.transform("__m", piece), ""), tail)
    joined = docs.join(listed, "document_id", "left")
    return joined.withColumn(
        "text", F.when(F.col("__m").isNull(), F.col("text")).otherwise(masked)
    ).drop("__m")


def prepare_review_bundle(
    docs: DataFrame, masks: DataFrame, references: DataFrame, held: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Masked documents and the reasons why a bundle must be rejected.

    A mask may not meet a gold span, and the masked text must still hold every
    quote. Held documents are left out.
    """
    from .intervals import overlap_pairs
    from .scoring import gold_mismatches, gold_spans

    if held is not None:
        ids = held.select("document_id").distinct()
        docs = docs.join(ids, "document_id", "left_anti")
        references = references.join(ids, "document_id", "left_anti")
    masks = masks.join(docs.select("document_id"), "document_id", "left_semi")
    prepared = mask_spans(docs, masks)
    gold = gold_spans(references, docs)
    touching = (
        overlap_pairs(gold.select("document_id", "start", "end"), masks.select("document_id", "start", "end"), ["document_id"])
        .select("document_id", F.lit("mask_meets_gold").alias("problem"))
        .distinct()
    )
    changed = mask_violations(docs, masks).select("document_id", F.col("violation").alias("problem"))
    lost = (
        gold_mismatches(references, prepared)
        .join(references.select("case_id", "document_id"), "case_id")
        .select("document_id", F.col("reason").alias("problem"))
    )
    return prepared, touching.unionByName(changed).unionByName(lost).distinct()


# --- triage ----------------------------------------------------------------


def triage_markers(docs: DataFrame, names: Sequence[str] = tuple(MARKERS), doc: str = "document_id"):
    """Number of matches per marker family."""
    return docs.select(doc, *[marker_count("text", n).alias(n) for n in names])


def marker_positions(docs: DataFrame, name: str, doc: str = "document_id") -> DataFrame:
    """Start and end of every match, from the lengths of matches and gaps."""
    pattern = f"(?iU){MARKERS[name]}"
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)
    sized = docs.select(
        doc,
        "text",
        F.transform(hits, F.length).alias("__h"),
        F.transform(gaps, F.length).alias("__g"),
    ).where(F.size("__h") > 0)
    # gap, match, gap, match, ...: every second sum is where a match starts
    pieces = F.flatten(F.zip_with(F.slice("__g", F.lit(1), F.size("__h")), "__h", lambda g, h: F.array(g, h)))
    placed = with_running_sums(sized, pieces, F.lit(0), "__at")
    spans = F.transform(
        F.sequence(F.lit(0), F.size("__h") - 1),
        lambda k: F.struct(F.get("__at", 2 * k + 1).alias("start"), F.get("__at", 2 * k + 2).alias("end")),
    )
    return placed.select(doc, "text", F.posexplode(spans).alias("hit", "s")).select(
        doc, "text", F.lit(name).alias("kind"), "hit", "s.start", "s.end"
    )


def triage_previews(
    docs: DataFrame, names: Sequence[str] = PREVIEW_MARKERS, doc: str = "document_id"
) -> DataFrame:
    """A window around the first matches of each family, contacts masked."""
    frames = []
    for name in names:
        hits = marker_positions(docs, name, doc).where(F.col("hit") < PREVIEW_HITS)
        start = F.greatest(F.lit(0), F.col("start") - PREVIEW_BEFORE)
        end = F.least(F.length("text"), F.col("end") + PREVIEW_AFTER)
        frames.append(
            hits.select(
                doc,
                "kind",
                "hit",
                start.alias("start"),
                end.alias("end"),
                mask_contacts(F.substring(F.col("text"), start + 1, end - start)).alias("preview"),
            )
        )
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
