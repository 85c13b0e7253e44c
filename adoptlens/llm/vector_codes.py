"""Product codes of vectors: one codebook per part, fitted by ball k-means on integers.

An entry and the parts assigned to it are a ball. Entries further away than twice the
radius of a ball are no neighbours of it; a part nearer to its entry than half the way to
the nearest neighbour lies in the stable core and is not looked at again; any other part
lies in a ring that names the neighbours it has to be compared with, nearest first. A
neighbour that has not moved since the last round can't win from an entry that hasn't.
Squared distances are integers, so the bounds are exact and ties go to the lower index.

Each task takes the balls of its own batches: their radii are smaller, and the bounds hold
for every subset of a ball. A round is one pass that writes the codes beside the vectors
and adds up sums per entry; only those sums meet, parts x entries x (length + 1) numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adoptlens.session import cut_lineage, release

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


class VectorCodes(NamedTuple):
    """rows: vec_id, label, code (a byte per part), error; codebooks: (part, entry, place)."""

    rows: DataFrame
    codebooks: np.ndarray


def is_whole(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def largest_component(length: int) -> int:
    """Four squared distances of vectors with components up to it fit in 64 bits."""
    return math.isqrt(2**63 // (16 * length)) - 1


def squared(difference: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", difference, difference)


def assign(x: np.ndarray, entries: np.ndarray, own: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``x`` and the squared distance to it.

    ``own`` is any first guess. Entries not ``moved`` are those that stand where they
    stood when ``own`` was the nearest of all; pass all as moved if it never was.
    """
    between = squared(entries[:, None, :] - entries[None, :, :])
    best, least = own.copy(), squared(x - entries[own])
    reach = 4 * least
    for i in np.unique(own):
        ball = np.flatnonzero(own == i)
        ball = ball[np.argsort(-reach[ball], kind="stable")]
        widths = -reach[ball]
        near = np.flatnonzero((between[i] <= -widths[0]) & (moved | moved[i]))
        for j in near[np.argsort(between[i, near], kind="stable")]:
            if j == i:
                continue
            ring = ball[: np.searchsorted(widths, -between[i, j], side="right")]
            there = squared(x[ring] - entries[j])
            wins = (there < least[ring]) | ((there == least[ring]) & (j < best[ring]))
            best[ring[wins]], least[ring[wins]] = j, there[wins]
    return best, least


def sums(x: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """(entry, place): the sums of the rows with a code, their count last."""
    out = np.zeros((entries, x.shape[1] + 1), np.int64)
    order = np.argsort(codes, kind="stable")
    found, start = np.unique(codes[order], return_index=True)
    out[found, :-1] = np.add.reduceat(x[order], start, axis=0)
    out[found, -1] = np.diff(np.append(start, len(codes)))
    return out


def moved_entries(codebooks: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The codebooks after an update by ``total``, of Python integers."""
    out = codebooks.copy()
    for part, entry in np.ndindex(*out.shape[:2]):
        *added, count = total[part, entry]
        if count:
            out[part, entry] = [a // count for a in added]
    return out


def _round(codebooks: np.ndarray, moved: np.ndarray, last: bool):
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, width)
            if batch["code"].null_count:
                own = np.zeros((n, parts), np.int64)
            else:
                own = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            added = np.empty((parts, entries, width + 1), np.int64)
            for p in range(parts):
                x = np.ascontiguousarray(v[:, p])
                found, least = assign(x, codebooks[p], own[:, p], moved[p])
                codes[:, p] = found
                error += least
                added[p] = sums(x, found, entries)
            raw = codes.tobytes()
            packed = pa.array([raw[k : k + parts] for k in range(0, len(raw), parts)], pa.binary())
            names = ["vec_id", "label", "code"]
            columns = [batch["vec_id"], batch["label"], packed]
            if last:
                names, columns = [*names, "error"], [*columns, pa.array(error)]
            else:
                once = pa.array([added.ravel().tolist()] + [None] * (n - 1), pa.list_(pa.int64()))
                names, columns = [*names, "v", "sums"], [*columns, batch["v"], once]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _total(rows: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    found = rows.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n"))
    out = np.zeros(math.prod(shape), object)
    for at, n in found.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)"))).collect():
        out[at] = int(n)
    return out.reshape(shape)


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> VectorCodes:
    """Codes of the vectors, and the codebooks (bytes, so 256 entries at most).

    Rows whose vector is null or holds null or non-finite components are dropped. Each
    component x becomes floor(4096 * x). The codebook of a part starts as that part of the
    vectors with the smallest ids (fewer if there are fewer; a null id comes last, equal
    ids by their vectors). Their length, a multiple of ``parts``, is that of the smallest
    id with such a vector. Vectors of another length, empty ones and those with a component
    beyond ``largest_component`` (46,000 for 64 components) can't be coded: they stay with a
    null code and a null error, and count in no codebook. Rows that repeat are coded one by
    one. Other columns are ignored. An empty table gives no rows and an empty codebook.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(is_whole(F.col(vector_col))).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), integers(F.col(vector_col)).alias("v")
    )
    by_id = F.col("vec_id").asc_nulls_last()
    fits = (F.size("v") > 0) & (F.size("v") % parts == 0)
    shortest = kept.filter(fits).select("vec_id", F.size("v").alias("n")).orderBy(by_id, "n").first()
    uncoded = F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")
    if not shortest:
        return VectorCodes(kept.select("vec_id", "label", *uncoded), np.zeros((parts, 0, 0), np.int64))
    length = shortest["n"]
    most = largest_component(length)
    codable = (F.size("v") == length) & F.forall("v", lambda x: x.between(-most, most))
    first = kept.filter(codable).select("vec_id", "v").orderBy(by_id, "v").limit(entries).collect()
    if not first:
        return VectorCodes(kept.select("vec_id", "label", *uncoded), np.zeros((parts, 0, 0), np.int64))
    codebooks = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    moved = np.ones(codebooks.shape[:2], bool)
    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:2])
    rows = kept.filter(codable).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.col("v").cast("array<int>").alias("v"))
    written = None
    for _ in range(rounds):
        found = rows.mapInArrow(_round(codebooks, moved, False), f"{ids}, code binary, v array<int>, sums array<long>")
        found = cut_lineage(found)
        if written is not None:
            release(written)
        written = found
        now = moved_entries(codebooks, _total(found, (*codebooks.shape[:2], codebooks.shape[2] + 1)))
        moved, codebooks = (now != codebooks).any(axis=2), now
        rows = found.select("vec_id", "label", "code", "v")
    found = cut_lineage(rows.mapInArrow(_round(codebooks, moved, True), f"{ids}, code binary, error long"))
    if written is not None:
        release(written)
    rest = kept.filter(~codable).select("vec_id", "label", *uncoded)
    return VectorCodes(found.unionByName(rest), codebooks)


def decode(codes: Column, codebooks: np.ndarray) -> Column:
    """The vector that a code stands for, components divided by the scale again."""
    parts = codebooks.shape[0]
    books = F.lit(codebooks.tolist()) if codebooks.size else F.array()
    digits = [F.conv(F.hex(F.substring(codes, p + 1, 1)), 16, 10).cast("int") for p in range(parts)]
    whole = F.concat(*(books[p][digits[p]] for p in range(parts)))
    return F.transform(whole, lambda x: x / SCALE)


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds label_error: the errors summed over equal labels, nulls together."""
    # written, so that a label that a third of all rows have can be split in the join
    found = cut_lineage(rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    return rows.join(found, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
