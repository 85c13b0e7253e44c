"""Bounded-space online packing of documents into sequences of tokens.

Each partition keeps ``open_windows`` windows. A document goes where it leaves the least
room (best fit); when it fits nowhere, the fullest window is emitted and a new one opened.
Only a document longer than a window is cut: into full windows and a rest. What is open at
the end of a partition is merged in the same way, the longest pieces first: sixteen
partitions at a time, then sixteen of those, so that no task holds more than
``FAN_IN * open_windows`` windows however many partitions there are.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adoptlens.session import cut_lineage

from .tokens import encoder, slices, vocabulary_path

LENGTH, OPEN_WINDOWS, FAN_IN = 4096, 128, 16
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
SCHEMA = "group long, window long, open boolean, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, ids binary"
FIELDS = pa.schema(
    [("group", pa.int64()), ("window", pa.int64()), ("open", pa.bool_())]
    + [(n, pa.int64()) for n in [*PIECE, "offset"]]
    + [("ids", pa.binary())]
)
#: Ids of sequences: the level of merging, the group within it, the window within that.
LEVEL_BIT, GROUP_BIT = 58, 31


class OpenWindows:
    """A bounded number of windows, found by the room they have left."""

    def __init__(self, most: int, length: int):
        self.most, self.length = most, length
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for an item of ``size``; may close the fullest window."""
        at = bisect.bisect_left(self.room, (size, -1))
        if at < len(self.room):
            left, window = self.room.pop(at)
        else:
            if len(self.room) == self.most:
                self.room.pop(0)
            left, window = self.length, self.new()
        if left > size:
            bisect.insort(self.room, (left - size, window))
        return window, self.length - left

    def still_open(self) -> set[int]:
        return {window for _, window in self.room}


def pack(
    documents: DataFrame,
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids_crc32,
    doc_tokens, sequence_id, offset (in the sequence), and ``ids`` (little-endian unsigned
    32-bit integers) if asked for.

    Null texts are empty: a document always has its end id. Repeated rows are packed one by
    one. Other columns are ignored. An empty table gives an empty result. The first packing
    is written to the shared folder before its leftovers are merged, so both agree.
    """
    vocabulary = vocabulary or vocabulary_path()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, windows = TaskContext.get().partitionId(), OpenWindows(open_windows, length)
        rows: list[list] = []
        for batch in batches:
            known, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in slices(texts):
                ids, sizes = encoder(vocabulary).encode(texts[a:b])
                flat, at = memoryview(ids.astype("<u4").tobytes()), 0
                for doc, n in zip(known[a:b], sizes.tolist()):
                    for start in range(0, n, length):
                        size = min(length, n - start)
                        raw = flat[4 * (at + start) : 4 * (at + start + size)]
                        window, offset = (windows.new(), 0) if size == length else windows.place(size)
                        rows.append(
                            [group, window, None, doc, start, size, zlib.crc32(raw), n, offset, bytes(raw) if with_ids else None]
                        )
                    at += n
        # a window's fate is known at the end of the partition; a row here is a few numbers
        still = windows.still_open()
        for at in range(0, len(rows), 10_000):
            columns = [list(c) for c in zip(*rows[at : at + 10_000])]
            columns[2] = [w in still for w in columns[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, FIELDS)], schema=FIELDS
            )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    done = cut_lineage(docs.mapInArrow(first, SCHEMA))
    last = done.agg(F.max("group")).first()[0]
    closed = [_sequences(done.filter(~F.col("open")), 0)]
    left, groups, level = done.filter("open"), (last or 0) + 1, 0
    while groups > 1:
        level, groups = level + 1, -(-groups // FAN_IN)
        merged = left.withColumn("to", F.floor(F.col("group") / FAN_IN)).groupBy("to")
        done = cut_lineage(merged.applyInPandas(_merge(length, open_windows), SCHEMA))
        closed.append(_sequences(done.filter(~F.col("open")), level))
        left = done.filter("open")
    out = _sequences(left, level)
    for part in closed:
        out = out.unionByName(part)
    return out if with_ids else out.drop("ids")


def _sequences(pieces: DataFrame, level: int) -> DataFrame:
    number = (
        F.lit(level).cast("long") * F.lit(1 << LEVEL_BIT)
        + F.col("group") * F.lit(1 << GROUP_BIT)
        + F.col("window")
    )
    return pieces.select(*PIECE, number.alias("sequence_id"), "offset", "ids")


def _merge(length: int, open_windows: int):
    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        # the smallest last: they fill what the others leave
        pieces = pieces.sort_values(
            ["length", "group", "window", "offset"], ascending=[False, True, True, True], kind="stable"
        )
        windows = OpenWindows(open_windows, length)
        at = np.array([windows.place(n) for n in pieces["length"].tolist()], dtype="int64").reshape(-1, 2)
        out = pieces.assign(group=pieces["to"].astype("int64"), window=at[:, 0], offset=at[:, 1])
        out["open"] = out["window"].isin(windows.still_open())
        return out.drop(columns="to")

    return merge
