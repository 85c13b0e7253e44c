"""Near duplicates: min-max hashing, banding, exact confirmation, connected components.

Under each of ``PERMUTATIONS`` permutations a document keeps the smallest and the largest
hash of its shingles, two independent-enough samples for one hash evaluation. The minima
of ``ROWS`` permutations form a band, their maxima another: ``2 * PERMUTATIONS / ROWS``
bands. Two documents at the threshold of 0.8 miss all of them with a chance of 5e-7.

Documents with equal sets form a class; classes take part, copies don't. Within a band
value classes are never paired with each other all at once:

1. each class is compared with one class it shares a band value with, the first of the
   band and then, where components are still apart, the last: a number of pairs in
   proportion to the classes;
2. confirmed links give components. Only where a band value still spans several
   components, links between those may be missing. For these classes an exact prefix
   filter finds every pair that can still reach the threshold: with shingles ordered from
   rare to frequent, two such sets share one of their first ``n - ceil(0.8 n) + 1``. Of
   these pairs only those are compared that two exact bounds let through: what either set
   has left, from where they meet, of shingles that other components have too, and the
   bits in which their parities differ.

A link counts when the full sets confirm it, compared as sorted 48-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adoptlens.session import cut_lineage

from .components import components
from .shingles import mix, shingle_sets
from .tokens import slices

WORDS, PERCENT = 5, 80
PERMUTATIONS, ROWS = 144, 6
_DRAW = np.random.default_rng(5)
_XOR = _DRAW.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_MUL = _DRAW.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
PARITY_BITS = 1024
#: Shingles that are hashed together; a block of all permutations stays in the cache.
BLOCK = 2048


def min_max(shingles: np.ndarray) -> np.ndarray:
    """Row 0: the minimum under each permutation; row 1: the maximum."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((2, PERMUTATIONS), np.uint32)
    out[0], out[1] = np.uint32(0xFFFFFFFF), 0
    for at in range(0, len(x), BLOCK):
        h = (x[None, at : at + BLOCK] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(out[0], h.min(axis=1), out=out[0])
        np.maximum(out[1], h.max(axis=1), out=out[1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band; a key also tells the band."""
    rows = signature.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + rows[:, k])
    return key.view(np.int64)


def set_bytes(shingles: np.ndarray) -> bytes:
    """Sorted distinct 48-bit hashes, in two planes."""
    short = np.unique(shingles >> np.uint64(16))
    return (short >> np.uint64(16)).astype("<u4").tobytes() + (short & np.uint64(0xFFFF)).astype("<u2").tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    n = len(data) // 6
    high = np.frombuffer(data, "<u4", n).astype(np.uint64)
    return (high << np.uint64(16)) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64)


def _key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))


def text_key(text: Column) -> Column:
    """Tells apart rows of different texts that share an id."""
    return F.xxhash64(text)


def signatures(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, set_key (null for an empty set), n_shingles, bands of every document."""
    fields = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_key", pa.binary())]
        + [("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, found = batch["doc_id"], batch["text_key"], batch["text"].to_pylist()
            for a, b in slices(found):
                sets = shingle_sets(found[a:b], words)
                bands = [band_keys(min_max(s)) if len(s) else None for s in sets]
                columns = [ids[a:b], texts[a:b], [_key(s) for s in sets], [len(s) for s in sets], bands]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields
                )

    return texts.mapInArrow(sign, "doc_id long, text_key long, set_key binary, n_shingles long, bands array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """set_key, shingles (as ``set_bytes``) of every document that has any."""
    fields = pa.schema([("set_key", pa.binary()), ("shingles", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch["text"].to_pylist()
            for a, b in slices(found):
                sets = [s for s in shingle_sets(found[a:b], words) if len(s)]
                yield pa.RecordBatch.from_pydict(
                    {"set_key": [_key(s) for s in sets], "shingles": [set_bytes(s) for s in sets]}, schema=fields
                )

    return texts.mapInArrow(build, "set_key binary, shingles binary")


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among (a, b, set_a, set_b) whose full sets reach ``percent``."""
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            good = []
            for x, y in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist()):
                if y != last:
                    last, kept = y, from_bytes(y)
                mine = from_bytes(x)
                both = len(mine) + len(kept)
                small = min(len(mine), len(kept))
                # the smaller set alone may be too small
                if 100 * small < percent * (both - small):
                    good.append(False)
                    continue
                merged = np.concatenate([mine, kept])
                merged.sort(kind="stable")
                common = int(np.count_nonzero(merged[1:] == merged[:-1]))
                good.append(100 * common >= percent * (both - common))
            chosen = pa.RecordBatch.from_arrays([batch["a"], batch["b"]], schema=fields)
            yield chosen.filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long")


def _prefix(percent: int) -> Column:
    """Length of the prefix in which two sets must meet: n - ceil(n * percent / 100) + 1."""
    return (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")


def _parities(classes: DataFrame) -> DataFrame:
    """(node, parity): for each of PARITY_BITS residues whether an odd number of shingles
    has it. A shingle that only one of two sets has flips one bit, so the sets differ in at
    least as many shingles as their parities in bits."""
    fields = pa.schema([("node", pa.int64()), ("parity", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch["shingles"].to_pylist():
                residues = (from_bytes(data) % np.uint64(PARITY_BITS)).astype(np.int64)
                odd = (np.bincount(residues, minlength=PARITY_BITS) & 1).astype(np.uint8)
                found.append(np.packbits(odd).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(found, fields[1].type)], schema=fields)

    return classes.select("node", "shingles").mapInArrow(count, "node long, parity array<long>")


def _remaining_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes (node, component, n, shingles) of different components that
    the prefix filter and the sizes let through."""
    fields = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("token", pa.int64())])

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = from_bytes(row["shingles"]).astype(np.int64)
                k = len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, row[c]), pa.int64()) for c in ("node", "n", "component")] + [pa.array(tokens)],
                    schema=fields,
                )

    tokens = classes.select("node", "n", "component", "shingles").mapInArrow(
        unfold, "node long, n long, component long, token long"
    )
    # a shingle that only one component has can't be shared by a link that is missing
    seen = tokens.groupBy("token").agg(
        F.count("*").alias("df"), F.min("component").alias("x"), F.max("component").alias("y")
    )
    ranked = tokens.join(seen.filter("x <> y").select("token", "df"), "token")
    # the others come first in the order; they can't meet another set
    met = ranked.groupBy("node", "n", "component").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order")
    )
    met = met.withColumn("most", F.size("order")).join(_parities(classes), "node")
    length = F.greatest(F.lit(0), _prefix(percent) - (F.col("n") - F.col("most")).cast("int"))
    prefix = F.slice("order", F.lit(1), length)
    rows = cut_lineage(
        met.select("node", "n", "most", "component", "parity", F.posexplode(prefix).alias("at", "t")).select(
            "node", "n", "component", "parity", (F.col("most") - F.col("at")).alias("left"), "t.token"
        )
    )
    spans = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    rows = rows.join(spans.filter("x <> y").select("token"), "token")
    a, b = rows.alias("a"), rows.alias("b")
    # where two sets meet first, they share no more than what either has left from there on
    most = F.least("a.left", "b.left")
    # nor do they differ in fewer shingles than their parities differ in bits
    differ = F.lit(0)
    for k in range(PARITY_BITS // 64):
        differ = differ + F.bit_count(F.col("a.parity")[k].bitwiseXOR(F.col("b.parity")[k]))
    near = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.component") < F.col("b.component"))
        & (most * 100 >= (F.col("a.n") + F.col("b.n") - most) * percent)
        & (differ * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent))
    )
    return a.join(b, near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def near_duplicates(
    documents: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key, group.

    ``group`` is the same for linked documents and null for a text without words.

    A-Z are lower-cased, words are runs without ASCII white space, a document's set holds
    its distinct shingles of ``words`` words (the whole sequence where it is shorter).
    Documents with 100 * intersection >= percent * union are linked; component_id is the
    smallest doc_id that links lead to, and kept marks it. A text that is null or has no
    word is linked with nothing and stays. Rows that repeat a doc_id share its component
    and verdict if their texts do; a null doc_id takes part but never names a component
    that has another id, and a row without id is kept only in a component without ids.
    Other columns are ignored. An empty table gives an empty result.
    """
    texts = _texts(documents, id_col, text_col)
    signed = cut_lineage(signatures(texts, words))
    classes = _classes(signed)
    links = cut_lineage(_links(texts, classes, words, percent))
    roots = components(links).withColumnRenamed("component", "root")
    members = classes.select("set_key", "node", "first_doc").join(roots, "node", "left")
    members = members.withColumn("root", F.coalesce("root", "node"))
    names = members.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = members.join(names, "root").select("set_key", "component_id", F.col("root").alias("group"))
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        signed.select("doc_id", "text_key", "set_key", "n_shingles")
        .join(named, "set_key", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), "text_key", "group")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def survivors(found: DataFrame) -> DataFrame:
    """(doc_id, text_key) of the rows of ``near_duplicates`` that stay: of each group one,
    the smallest doc_id (none comes last) and of its texts the one with the least key; of
    texts without words all."""
    own = F.col("group").isNull()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    one = found.filter(~own).groupBy("group").agg(first).select("first.doc_id", "first.text_key")
    return one.union(found.filter(own).select("doc_id", "text_key")).distinct()


def _classes(signed: DataFrame) -> DataFrame:
    """Documents with equal sets as one row: set_key, node, first_doc, n, bands.

    ``node`` is the smallest doc_id of the class, or a negative number made from its key
    where it has no id or shares that id with another class.
    """
    grouped = signed.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("first_doc"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    )
    grouped = cut_lineage(grouped)
    owner = grouped.groupBy("first_doc").agg(F.min("set_key").alias("owner"))
    other = -F.conv(F.hex(F.substring("set_key", 1, 7)), 16, 10).cast("long") - 1
    own = F.col("first_doc").isNotNull() & (F.col("set_key") == F.col("owner"))
    return cut_lineage(
        grouped.join(owner, "first_doc", "left").select(
            "set_key", F.when(own, F.col("first_doc")).otherwise(other).alias("node"), "first_doc", "n", "bands"
        )
    )


def _with_components(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """(band, node, component) of the members whose band value spans several components."""
    if links is None:
        labelled = members.withColumn("component", F.col("node"))
    else:
        labelled = members.join(components(links), "node", "left")
        labelled = labelled.withColumn("component", F.coalesce("component", "node"))
    spans = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return cut_lineage(labelled.join(spans.filter("x <> y").select("band"), "band").select("band", "node", "component"))


def _hub_links(members: DataFrame, sets: DataFrame, pick, percent: int) -> DataFrame:
    """Confirmed links of each class to one hub of another component. The hub of a band
    value is the class that ``pick`` chooses; a class takes the hub with which it shares
    most band values."""
    hubs = members.groupBy("band").agg(pick("node").alias("hub"))
    votes = members.join(hubs, "band").groupBy("node", "component", "hub").agg(F.count("*").alias("votes"))
    of = members.select(F.col("node").alias("hub"), F.col("component").alias("other")).distinct()
    best = (
        votes.join(of, "hub")
        .filter("component <> other")
        .groupBy("node")
        .agg(F.max(F.struct("votes", (-F.col("hub")).alias("hub"))).alias("best"))
    )
    one = sets.join(best, "node").select(
        F.col("node").alias("a"), (-F.col("best.hub")).alias("b"), F.col("shingles").alias("set_a")
    )
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return confirmed(one.join(two, "b"), percent)


def _links(texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("x"), F.max("node").alias("y"))
    members = cut_lineage(banded.join(shared.filter("x <> y").select("band"), "band"))
    wanted = classes.select("node", "n", "set_key", "first_doc").join(members.select("node").distinct(), "node")
    firsts = wanted.select(F.col("first_doc").alias("id")).distinct()
    found = texts.join(firsts, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = _sets(found, words).dropDuplicates(["set_key"])
    sets = cut_lineage(wanted.join(sets, "set_key").select("node", "n", "shingles"))
    # the first and the last class of a band value as its hub
    links, still = None, _with_components(members, None)
    for pick in (F.min, F.max):
        more = _hub_links(still, sets, pick, percent)
        links = cut_lineage(more if links is None else links.union(more))
        still = _with_components(members, links)
    rest = cut_lineage(sets.join(still.select("node", "component").distinct(), "node"))
    pairs = _remaining_pairs(rest, percent)
    one = rest.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    two = rest.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return links.union(confirmed(pairs.join(one, "a").join(two, "b"), percent))
