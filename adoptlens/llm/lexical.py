"""Ranked lexical search over blocks of documents, with bounds from pairs of terms.

The index has a row per (block, term): the documents of the block that hold the term, as
places in the block, and how often; and one row per block with its ids and lengths. Blocks
are cut from the scan, so no text is shuffled. A search joins its terms to the index by
term, and each block ranks its documents for the items that meet it:

1. Impact lists. Per block the largest impact of each term, and for pairs of an item's most
   frequent terms the largest joint impact over the documents that hold both.
2. Bounds. Of a matched pair a document scores at most max(joint, either alone), which is
   less than both maxima together; matched greedily by what they save, the pairs bound all
   terms that are still to come.
3. MaxScore. Terms are taken by falling maximum. Once the bound of the rest is below the
   k-th best sum so far, no new document can enter; from then on only candidates are looked
   up, and those leave whose sum and bound fall short. Equal scores never leave.

One block in sixteen is searched first; an item's k-th best score there is a floor for the
others. Bounds and floors save work and change no result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adoptlens.session import cut_lineage, shared_dir

from .common import whole_text

#: A-Z in lower case; what no term holds as blanks. Bytes of other scripts are above 7F.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
#: Bytes of text and documents of a block; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_DOCUMENTS = 16 << 20, 1 << 16
#: Items that are searched together in a block, and terms of an item that are paired.
ITEMS, PAIR_TERMS = 1024, 8
FIRST_BLOCKS = 16
INDEX = pa.schema(
    [("block", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("docs", pa.binary()), ("tfs", pa.binary())]
    + [("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
)
INDEX_SQL = "block long, term binary, df long, docs binary, tfs binary, ids array<long>, lengths array<long>"


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values that lie one after the other in ``data``, up to these places."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and the place of each one's text in the list."""
    raw = np.frombuffer(b" ".join(texts).translate(FOLD), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = raw != 32
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    after = np.cumsum([len(t) + 1 for t in texts])
    dense = np.ascontiguousarray(raw[inside[1:-1].view(bool)])
    return _binary(dense, np.cumsum(ends - starts)), np.searchsorted(after, starts, side="right")


def _block(number: int, ids: list, texts: list[bytes], most_rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The index rows of a block, its own row first."""
    n = len(texts)
    terms, text = tokens(texts)
    lengths = np.bincount(text, minlength=n)
    own = [[number], [None], [int((lengths > 0).sum())], [None], [None], [ids], [lengths.tolist()]]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(own, INDEX)], schema=INDEX)
    if not len(terms):
        return
    coded = terms.dictionary_encode()
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + text, return_counts=True)
    doc, df = (pair % n).astype("<u2"), np.bincount(pair // n)
    tf, ends = tf.astype("<u4"), np.cumsum(df)
    for a in range(0, len(df), most_rows):
        z = min(a + most_rows, len(df))
        low, upto = (ends[a] - df[a]), ends[a:z]
        none = pa.nulls(z - a, pa.list_(pa.int64()))
        columns = [
            pa.array(np.full(z - a, number)), coded.dictionary[a:z], pa.array(df[a:z].astype(np.int64)),
            _binary(doc[low : upto[-1]], 2 * (upto - low)), _binary(tf[low : upto[-1]], 4 * (upto - low)), none, none,
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=INDEX)


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index of all documents, as a table in the shared folder.

    A null text is empty; it takes a place in a block and no term names it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, value in zip(batch["id"].to_pylist(), batch["text"]):
                text = value.as_py()
                if ids and (size + len(text) > block_bytes or len(ids) == BLOCK_DOCUMENTS):
                    yield from _block(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text) + 1
        if ids:
            yield from _block(number, ids, texts)

    rows = documents.select(F.col(id_col).cast("long").alias("id"), whole_text(F.col(text_col)).cast("binary").alias("text"))
    path = shared_dir(documents.sparkSession, "index")
    rows.mapInArrow(run, INDEX_SQL).write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(INDEX_SQL).parquet(path)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each once; rows that repeat an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, text = tokens(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(text)), terms], ["item_id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), whole_text(F.col(text_col)).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


def weigh(terms: DataFrame, index: DataFrame, n_documents: int) -> DataFrame:
    """The weight of each distinct term that some document holds and that weighs anything."""
    held = index.filter("term IS NOT NULL").select("term", "df")
    df = terms.select("term").distinct().join(held, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_documents + 2)) / (2 * F.col("df") + 1)))
    return df.select("term", weight.cast("long").alias("w")).filter("w > 0")


class Block:
    """The lists of a block, decoded when a search asks for them."""

    def __init__(self, rows: list[dict], n_documents: int, n_terms: int):
        own = next(r for r in rows if r["term"] is None)
        self.ids = own["ids"]
        n = np.array(own["lengths"], np.int64)
        if 50 * int(n.max(initial=0)) * n_documents >= 2**63:
            n = n.astype(object)
        self.m = (50 + 50 * n * n_documents // max(n_terms, 1)).astype(np.int64)
        self.rows = {r["term"]: r for r in rows if r["term"] is not None}
        self.items: dict = defaultdict(list)
        self.floors: dict = {}
        for term, r in self.rows.items():
            for item in r["items"]:
                self.items[item["item_id"]].append(term)
                self.floors[item["item_id"]] = item["floor"] or 0
        self.lists: dict = {}

    def postings(self, term: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a term by place, and its impact on their scores."""
        if term not in self.lists:
            r = self.rows[term]
            docs = np.frombuffer(r["docs"], "<u2").astype(np.int64)
            tf = np.frombuffer(r["tfs"], "<u4").astype(np.int64)
            self.lists[term] = docs, r["w"] * (10**9 * tf // (1000 * tf + 20 * self.m[docs]))
        return self.lists[term]

    def pairs(self, most: int = PAIR_TERMS) -> set[tuple[bytes, bytes]]:
        """The pairs that are worth a list: of the lightest terms of each item."""
        out = set()
        for terms in self.items.values():
            light = sorted(sorted(terms, key=lambda t: (self.rows[t]["w"], t))[:most])
            out.update((a, b) for k, a in enumerate(light) for b in light[k + 1 :])
        return out

    def joint(self, a: bytes, b: bytes) -> tuple[int, int]:
        """In how many documents two terms meet, and their largest joint impact there."""
        (docs, score), (others, other) = sorted((self.postings(a), self.postings(b)), key=lambda p: len(p[0]))
        at = np.searchsorted(others, docs)
        at[at == len(others)] = 0
        both = others[at] == docs
        return int(both.sum()), int((score[both] + other[at[both]]).max(initial=0))


def bounds(largest: list[int], pairs: list[tuple[int, int, int]]) -> np.ndarray:
    """What terms k, k + 1, ... can add at most, for each k and for none.

    ``largest`` are the maxima of the terms, ``pairs`` (a, b, joint) with a before b. A pair
    counts where both terms are still to come, each term in one pair.
    """
    saved, taken = np.zeros(len(largest) + 1, np.int64), set()
    gains = [(largest[a] + largest[b] - max(joint, largest[a], largest[b]), a, b) for a, b, joint in pairs]
    for gain, a, b in sorted(gains, reverse=True):
        if gain > 0 and a not in taken and b not in taken:
            taken |= {a, b}
            saved[: a + 1] += gain
    return np.append(np.cumsum(largest[::-1])[::-1], 0).astype(np.int64) - saved


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def best(block: Block, terms: list[bytes], bound: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and scores of all documents among the ``k`` best of the block that reach
    the floor. ``terms`` come in falling order of their maxima, ``bound`` from ``bounds``."""
    sums, at = np.zeros(len(block.ids), np.int64), 0
    while at < len(terms) and bound[at] >= max(floor, 1):
        docs, score = block.postings(terms[at])
        sums[docs] += score
        at += 1
        floor = max(floor, kth(sums, k))
    docs = np.flatnonzero((sums > 0) & (sums + bound[at] >= floor))
    sums = sums[docs]
    for at in range(at, len(terms)):
        if not len(docs):
            break
        others, score = block.postings(terms[at])
        place = np.searchsorted(others, docs)
        place[place == len(others)] = 0
        sums = sums + np.where(others[place] == docs, score[place], 0)
        floor = max(floor, kth(sums, k))
        left = sums + bound[at + 1] >= floor
        docs, sums = docs[left], sums[left]
    return docs, sums


def _impacts(n_documents: int, n_terms: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table.to_pylist(), n_documents, n_terms)
        key = [table["block"][0].as_py(), table["part"][0].as_py()]
        rows = [(*key, t, None, len(s), int(s.max())) for t in block.rows for _, s in [block.postings(t)]]
        rows += [(*key, a, b, *block.joint(a, b)) for a, b in block.pairs()]
        columns = list(zip(*rows)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], IMPACTS)

    return run


IMPACTS = ["block", "part", "term", "other", "n_documents", "impact"]
IMPACTS_SQL = "block long, part long, term binary, other binary, n_documents long, impact long"


def _search(n_documents: int, n_terms: int, k: int):
    def run(lists: pa.Table, impacts: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = [], [], []
        if lists.num_rows:  # a part of the items that no term of the block meets has none
            block = Block(lists.to_pylist(), n_documents, n_terms)
            largest, joint = {}, defaultdict(list)
            for r in impacts.to_pylist():
                if r["other"] is None:
                    largest[r["term"]] = r["impact"]
                else:
                    joint[r["term"]].append((r["other"], r["impact"]))
            for item, terms in block.items.items():
                terms = sorted(terms, key=lambda t: (-largest[t], t))
                place = {t: n for n, t in enumerate(terms)}
                pairs = [
                    (*sorted((place[a], place[b])), impact) for a in terms for b, impact in joint[a] if b in place
                ]
                docs, scores = best(block, terms, bounds([largest[t] for t in terms], pairs), block.floors[item], k)
                found = zip(scores.tolist(), (block.ids[d] for d in docs.tolist()))
                found = sorted(((s, i) for s, i in found if s), key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
                out[0].extend([item] * len(found))
                out[1].extend(i for _, i in found)
                out[2].extend(s for s, _ in found)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 50, **columns: str) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    Only scores above 0 count; equal scores are ranked by ascending doc_id, one without an
    id last. Rows of documents that repeat an id are ranked one by one. Items without a term
    that weighs anything have no rows; rows of ``items`` that repeat an id are one item, and
    those without an id are one too. Empty tables give an empty result.
    """
    spark: SparkSession = index.sparkSession
    own = index.filter("term IS NULL")
    told = own.agg(F.sum("df"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    stats = told[0] or 0, told[1] or 0
    terms = cut_lineage(item_terms(items, **columns))
    weights = weigh(terms, index, stats[0])
    lists = cut_lineage(index.filter("term IS NOT NULL").join(weights, "term").select("block", "term", "w", "docs", "tfs"))
    parts = -(-terms.select("item_id").distinct().count() // ITEMS) or 1
    terms = terms.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    blocks = own.select("block", each.alias("part"), "ids", "lengths")

    def meet(floors: DataFrame | None) -> DataFrame:
        """The lists with the items that ask for them, at most ITEMS in a part on average,
        and the block's own row."""
        rows = terms if floors is None else terms.join(floors, terms["item_id"].eqNullSafe(floors["__item"]), "left")
        floor = F.lit(None).cast("long") if floors is None else F.col("floor")
        asked = rows.groupBy("part", "term").agg(F.collect_list(F.struct("item_id", floor.alias("floor"))).alias("items"))
        return lists.join(asked, "term").unionByName(blocks, allowMissingColumns=True)

    impacts = cut_lineage(meet(None).groupBy("block", "part").applyInArrow(_impacts(*stats), IMPACTS_SQL))
    is_first = F.pmod(F.xxhash64("block"), F.lit(FIRST_BLOCKS)) == 0

    def found(chosen, floors: DataFrame | None) -> DataFrame:
        sides = [df.filter(chosen).groupBy("block", "part") for df in (meet(floors), impacts)]
        rows = sides[0].cogroup(sides[1]).applyInArrow(_search(*stats, k), "item_id long, doc_id long, score long")
        return cut_lineage(rows)

    first = found(is_first, None)
    floors = _ranked(first, k).filter(F.col("rank") == k).select(F.col("item_id").alias("__item"), F.col("score").alias("floor"))
    rest = found(~is_first, cut_lineage(floors))
    ranked = _ranked(first.unionByName(rest), k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
