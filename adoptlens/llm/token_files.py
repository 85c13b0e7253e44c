"""Token files: the ids of whole documents in ascending doc_id order, Simple-8b coded.

A token file is a Parquet folder of segments. A segment holds whole consecutive documents,
about ``SEGMENT_IDS`` ids: the document ids (signed 64-bit, with a null mark), the ids of
each document as one Simple-8b stream of lengths, and all ids as another. ``part`` and
``segment`` give the order; a segment decodes on its own, block by block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .tokens import encoder, slices, vocabulary_path

SEGMENT_IDS = 1 << 20
SCHEMA = "part long, segment long, n_docs long, n_ids long, data binary"
DOC_SCHEMA = "part long, segment long, doc_id long, before long, n_tokens long, ids_crc32 long"


def pack_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    return known.tobytes() + nulls.tobytes() + simple8b.encode(lengths) + simple8b.encode(ids)


def unpack_segment(n_docs: int, data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    view = memoryview(data)
    known = np.frombuffer(view[: 8 * n_docs], "<i8").tolist()
    nulls = np.frombuffer(view[8 * n_docs : 9 * n_docs], np.uint8)
    view = view[9 * n_docs :]
    lengths = simple8b.decode(view)
    ids = simple8b.decode(view[simple8b.size_of(view) :])
    return [None if x else d for d, x in zip(known, nulls)], lengths.astype(np.int64), ids.astype("<u4")


def write_tokens(
    documents: DataFrame, path: str, vocabulary: str | None = None, segment_ids: int = SEGMENT_IDS
) -> None:
    """Writes the token file of (doc_id, text). Null texts are empty: their only id is the end id.

    Texts move once, dealt out by ranges of doc_id; rows that share a doc_id, or have none
    (first), are spread and ordered by the hash of their text. Other columns are ignored.
    """
    vocabulary = vocabulary or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        docs: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def emit():
            nonlocal segment, docs, lengths, ids, held
            data = pack_segment(docs, np.concatenate(lengths), np.concatenate(ids))
            row = {"part": [part], "segment": [segment], "n_docs": [len(docs)], "n_ids": [held], "data": [data]}
            segment, docs, lengths, ids, held = segment + 1, [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=FIELDS)

        for batch in batches:
            known, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in slices(texts):
                found, sizes = encoder(vocabulary).encode(texts[a:b])
                docs += known[a:b]
                lengths.append(sizes)
                ids.append(found)
                held += len(found)
                if held >= segment_ids:
                    yield emit()
        if docs:
            yield emit()

    by = ["doc_id", F.xxhash64("text")]
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by, "text")
    # the data is coded already; compressing it again only costs time
    ordered.mapInArrow(write, SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token file: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, lengths, ids = unpack_segment(row["n_docs"], row["data"])
                ends = np.cumsum(lengths)
                flat = memoryview(ids.tobytes())
                crc = [zlib.crc32(flat[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": [row["part"]] * len(docs),
                        "segment": [row["segment"]] * len(docs),
                        "doc_id": docs,
                        "before": ends - lengths,
                        "n_tokens": lengths,
                        "ids_crc32": crc,
                    },
                    schema=DOC_FIELDS,
                )

    segments = spark.read.schema(SCHEMA).parquet(path)
    docs = segments.mapInArrow(read, DOC_SCHEMA)
    # one row per part, that is per task of the writer
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("of_parts"))
    order = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = segments.select(
        "part", "segment", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("of_segments")
    ).join(parts, "part")
    return docs.join(bases, ["part", "segment"]).select(
        "doc_id",
        (F.col("of_parts") + F.col("of_segments") + F.col("before")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


FIELDS = pa.schema(
    [("part", pa.int64()), ("segment", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]
)
DOC_FIELDS = pa.schema(
    [(n, pa.int64()) for n in ("part", "segment", "doc_id", "before", "n_tokens", "ids_crc32")]
)
