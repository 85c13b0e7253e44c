"""Removal of passages that repeat across documents, by partitioned suffix order.

The law: a byte goes when a string of ``least`` bytes that covers it also starts in a
document with a smaller doc_id. So for each suffix only one thing matters: whether its
longest previous factor, the longest match with a suffix of an earlier document, reaches
``least`` bytes. Suffixes that agree on that many bytes are neighbours in suffix order and
share the smallest hash of their first 16-byte strings, their anchor. The work is therefore
done in parts, one per range of anchors:

1. Documents are dealt into splits. Consecutive suffixes with their anchor at the same place
   form a run. A string reaches far beyond its anchor on one side at least, so each split
   sends its distinct anchors once with the bytes before and once with those after them;
   the longer strings met in two documents are sent back. Sixteen bytes alone meet by
   chance, and the more so the larger the corpus is.
2. A split sends its distinct runs with such a side: their bytes and their first document.
3. A part puts the suffixes of its runs in order; strings whose hash no other has are left out. Between neighbours the longest common
   prefix is taken; the nearest suffixes before and after in that order whose documents are
   smaller give the two matches of which the longer is the previous factor. A suffix whose
   factor reaches ``least`` follows it to the first document of its string. Runs with equal
   bytes are one run, and an anchor that only one run has needs no order: all its suffixes
   have the factor that the copies of the run give.
4. Splits mark what starts in an earlier document and cut it out.

Factors are counted up to ``least`` bytes, which is all the law asks. Runs are named by
64-bit keys, but no key decides alone: a part compares bytes, a split tells its own runs
apart by a second key, and runs that differ under one key are left in the text.

A string that a third of all documents share reaches a part once per split, not once per
document. Texts move once; steps 1, 2 and 4 read the same shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_for, whole_text
from .shingles import mix

LEAST = 50
#: Bytes of an anchor, and those beside it that a side of it has at most.
ANCHOR = SIDE = 16
#: Of an anchor's hash these bits decide; in the others a minimum carries its place.
PLACE = np.uint64((1 << 24) - 1)
#: Text bytes of a split, and bytes that are worked on together.
SPLIT_BYTES, CHUNK = 8 << 20, 1 << 20
#: Stands for a null doc_id, smaller than every other.
NO_ID = -(1 << 63)

BLOB = pa.schema([("part", pa.int64()), ("split", pa.int64()), ("data", pa.binary())])
BLOB_SQL = "part long, split long, data binary"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
    + [("kept_sha256", pa.string()), ("spans", SPANS), ("kept", pa.binary())]
)
RESULT_SQL = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "spans array<struct<start: long, end: long>>, kept binary"
)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def anchor_hashes(data: np.ndarray, a: np.uint64 = _A, b: np.uint64 = _B, c: np.uint64 = _C) -> np.ndarray:
    """The hash of the ANCHOR bytes from each position; other odd numbers, another hash."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = words[: len(data) - 15] * a + words[8:] * b
    return (h ^ (h >> np.uint64(32))) * c


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    return np.minimum(h[: len(h) - (width - reach)], h[width - reach :]) if width > reach else h


def string_hashes(h: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """The hash of the ``least`` bytes from each position in ``at``."""
    out = np.zeros(len(at), np.uint64)
    for step in [*range(0, least - ANCHOR, ANCHOR), least - ANCHOR]:
        out = mix(out * _B + h[at + step])
    return out


class Runs:
    """Runs of suffixes with their anchor at one place in the pieces of a buffer.

    at: where the first suffix of a run starts; size: its suffixes; anchor: the bits of the
    anchor's hash that decide; place: where the anchor is.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int):
        n = len(data) - least + 1
        edge = np.zeros(max(n, 0) + 1, np.int32)
        long = lengths >= least
        self.data, self.least = data, least
        if n <= 0 or not long.any():
            self.at = self.size = self.place = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            self.h = np.zeros(0, np.uint64)
            return
        self.h = h = anchor_hashes(data)
        assert len(h) <= int(PLACE)
        # of equal anchors in a string the first one counts
        least_of = sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), least - ANCHOR + 1)
        edge[starts[long]] += 1
        edge[starts[long] + lengths[long] - least + 1] -= 1
        index = np.flatnonzero(np.cumsum(edge[:-1]))
        anchors = least_of[index]
        new = np.ones(len(index), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (index[1:] != index[:-1] + 1)
        first = np.flatnonzero(new)
        self.at, self.size = index[first], np.diff(np.append(first, len(index)))
        self.anchor, self.place = anchors[first] & ~PLACE, (anchors[first] & PLACE).astype(np.int64)

    def keys(self, rows=slice(None)) -> np.ndarray:
        """What names the bytes of each run."""
        at, size = self.at[rows], self.size[rows]
        return run_keys(self.h, at, size, self.least)

    def checks(self, rows=slice(None)) -> np.ndarray:
        """A second key."""
        at, last = self.at[rows], self.at[rows] + self.size[rows] - 1
        if not len(at):
            return np.zeros(0, np.uint64)
        other = anchor_hashes(self.data, _C, _A, _B)
        return mix(string_hashes(other, at, self.least) * _B + string_hashes(other, last, self.least))

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchors with the bytes before and with those after them; where no
        string of a run reaches as far on one side, both are that of the other side."""
        reach = min(SIDE, -(-(self.least - ANCHOR) // 2))
        before = self.place - self.at >= reach
        after = self.at + self.size - 1 + self.least - self.place - ANCHOR >= reach
        here = self.h[self.place]
        left = mix(here * _A + self.h[np.where(before, self.place - reach, self.place)])
        right = mix(here * _C + self.h[np.where(after, self.place + reach, self.place)] + _B)
        return np.where(before, left, right), np.where(after, right, left)


def run_keys(h: np.ndarray, at: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    ends = string_hashes(h, at, least) * _A + string_hashes(h, at + size - 1, least)
    return mix(ends * _B + size.astype(np.uint64))


def _pieces(table: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about CHUNK bytes: data, and per piece its start, length, row and offset
    in that row's text. A longer text is cut into pieces that overlap by ``least - 1``."""
    held: list[bytes] = []
    meta: list[tuple[int, int]] = []
    size = 0

    def emit():
        lengths = np.array([len(x) for x in held], dtype=np.int64)
        rows = np.array(meta, dtype=np.int64).reshape(-1, 2)
        data = np.frombuffer(b"".join(held), dtype=np.uint8)
        return data, np.cumsum(lengths) - lengths, lengths, rows[:, 0], rows[:, 1]

    for row, raw in enumerate(table.column("raw").to_pylist()):
        for offset in range(0, max(1, len(raw) - least + 1), CHUNK):
            piece = raw[offset : offset + CHUNK + least - 1]
            if held and size + len(piece) > CHUNK:
                yield emit()
                held, meta, size = [], [], 0
            held.append(piece)
            meta.append((row, offset))
            size += len(piece)
    if held:
        yield emit()


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)


def _blobs(part: np.ndarray, split: int, data) -> pa.Table:
    """One row per part: ``data(rows)`` of its rows."""
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    blobs = [data(rows) for rows in np.split(order, first[1:])] if len(parts) else []
    return pa.Table.from_arrays(
        [pa.array(parts, pa.int64()), pa.array([split] * len(parts), pa.int64()), pa.array(blobs, pa.binary())],
        schema=BLOB,
    )


def _part(anchor: np.ndarray, parts: int) -> np.ndarray:
    # an anchor is a minimum, so its upper bits are small numbers; any other bits will do
    return (mix(anchor) % np.uint64(parts)).astype(np.int64)


def _short(side: np.ndarray) -> np.ndarray:
    """What tells the sides of one part apart. Two with equal bits pass for one, and step 3
    finds that their strings differ."""
    return (side >> np.uint64(32)).astype("<u4")


def _send_sides(parts: int, least: int):
    def send(table: pa.Table) -> pa.Table:
        ids, found, docs = _ids(table), [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]

        def once(side: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Each side with the first and the last of its documents."""
            order = np.argsort(side, kind="stable")
            side, doc = side[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]])) if len(side) else order
            if not len(first):
                return side, doc
            low, high = np.minimum.reduceat(doc[:, 0], first), np.maximum.reduceat(doc[:, 1], first)
            return side[first], np.stack([low, high], axis=1)

        for data, starts, lengths, row, _ in _pieces(table, least):
            runs = Runs(data, starts, lengths, least)
            doc = ids[row[np.searchsorted(starts, runs.at, "right") - 1]]
            side, of = once(np.concatenate(runs.sides()), np.tile(np.stack([doc, doc], axis=1), (2, 1)))
            found.append(side)
            docs.append(of)
        side, doc = once(np.concatenate(found), np.concatenate(docs))
        several = doc[:, 0] != doc[:, 1]
        pack = lambda rows: _short(side[rows]).tobytes() + np.packbits(several[rows]).tobytes()
        part = (side % np.uint64(parts)).astype(np.int64)
        return _blobs(part, table.column("split")[0].as_py(), pack)

    return send


def _meet(table: pa.Table) -> pa.Table:
    """Which sides of a part are met in two documents, for each split that has them."""
    splits, blobs = table.column("split").to_pylist(), table.column("data").to_pylist()
    counts = np.array([len(b) * 8 // 33 for b in blobs], dtype=np.int64)
    side = np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(blobs, counts.tolist())])
    several = np.concatenate(
        [np.unpackbits(np.frombuffer(b, np.uint8, offset=4 * n), count=n) for b, n in zip(blobs, counts.tolist())]
    )
    order = np.argsort(side, kind="stable")
    ranked = side[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(first, len(ranked)))
    shared = np.empty(len(side), bool)
    shared[order] = np.repeat((size > 1) | (np.maximum.reduceat(several[order], first) > 0), size)
    edges = np.cumsum(counts)
    out = [a[s].tobytes() for a, s in zip(np.split(side, edges[:-1]), np.split(shared, edges[:-1]))]
    return pa.Table.from_arrays(
        [table.column("part").combine_chunks().cast(pa.int64()), pa.array(splits, pa.int64()), pa.array(out, pa.binary())],
        schema=BLOB,
    )


def _new(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where another pair of keys begins in order."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    return new


def _send_runs(parts: int, least: int):
    def send(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows:
            return BLOB.empty_table()
        high = shared.column("part").to_numpy().astype(np.uint64) << np.uint64(32)
        met = [np.frombuffer(b, "<u4").astype(np.uint64) | part for part, b in zip(high, shared.column("data").to_pylist())]
        wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *met]))

        def is_met(side: np.ndarray) -> np.ndarray:
            if not len(wanted):
                return np.zeros(len(side), bool)
            named = ((side % np.uint64(parts)) << np.uint64(32)) | _short(side)
            return wanted[np.minimum(np.searchsorted(wanted, named), len(wanted) - 1)] == named

        ids = _ids(table)
        anchors, keys, checks, docs, sizes, raws = [], [], [], [], [], []
        for data, starts, lengths, row, _ in _pieces(table, least):
            runs = Runs(data, starts, lengths, least)
            before, after = runs.sides()
            good = np.flatnonzero(is_met(before) | is_met(after))
            key, check = runs.keys(good), runs.checks(good)
            doc = ids[row[np.searchsorted(starts, runs.at[good], "right") - 1]]
            # the first and the last document of each distinct run of this buffer
            order = np.lexsort((doc, check, key))
            key, check = key[order], check[order]
            first = np.flatnonzero(_new(key, check))
            last = np.append(first[1:], len(key)) - 1 if len(key) else order
            rows = good[order[first]]
            anchors.append(runs.anchor[rows])
            keys.append(key[first])
            checks.append(check[first])
            docs.append(np.stack([doc[order[first]], doc[order[last]]], axis=1).reshape(-1, 2))
            sizes.append(runs.size[rows])
            raw = data.tobytes()
            ends = runs.at[rows] + runs.size[rows] + least - 1
            raws += [raw[a:b] for a, b in zip(runs.at[rows].tolist(), ends.tolist())]
        anchor, key, size = np.concatenate(anchors), np.concatenate(keys), np.concatenate(sizes)
        doc, check = np.concatenate(docs), np.concatenate(checks)
        order = np.lexsort((doc[:, 0], check, key))
        first = np.flatnonzero(_new(key[order], check[order]))
        rows = order[first]
        low = doc[rows, 0]
        high = np.maximum.reduceat(doc[order, 1], first) if len(first) else low
        several = low != high

        def pack(chosen: np.ndarray) -> bytes:
            head = np.array([len(chosen)], "<i8").tobytes()
            marks = (size[rows[chosen]] * 2 + several[chosen]).astype("<u2").tobytes()
            packed = zstandard.compress(b"".join(raws[i] for i in rows[chosen].tolist()), 1)
            return head + low[chosen].astype("<i8").tobytes() + marks + packed

        return _blobs(_part(anchor[rows], parts), table.column("split")[0].as_py(), pack)

    return send


def common_prefixes(columns: list[np.ndarray], widths: list[int], order: np.ndarray) -> np.ndarray:
    """How many bytes each suffix in order shares with the one before it; 0 for the first.
    ``columns`` hold the bytes, ``widths`` of them in each, the first one highest."""
    out = np.zeros(len(order), np.int64)
    equal = np.ones(max(len(order) - 1, 0), bool)
    for column, width in zip(columns, widths):
        ranked = column[order]
        differ = ranked[1:] ^ ranked[:-1]
        for byte in range(width - 1, -1, -1):
            here = equal & (differ >> np.uint64(8 * byte) == 0)
            out[1:] += here
            if byte == 0:
                equal = here
    return out


def smaller_before(doc: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before it with a smaller document (-1: none), and the
    bytes that the suffixes of both share. Places skip to where those they meet would go."""
    place, shared = np.arange(-1, len(doc) - 1), lcp.copy()
    going = np.flatnonzero((place >= 0) & (doc[place] >= doc))
    while len(going):
        met = place[going]
        shared[going] = np.minimum(shared[going], shared[met])
        place[going] = place[met]
        now = place[going]
        going = going[(now >= 0) & (doc[now] >= doc[going])]
    shared[place < 0] = 0
    return place, shared


def previous_factors(doc: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length of the longest previous factor of each place in suffix order, and the
    place of its suffix (itself, where there is none)."""
    n = len(doc)
    before, one = smaller_before(doc, lcp)
    after, two = smaller_before(doc[::-1], np.concatenate([lcp[:1], lcp[:0:-1]]))
    after, two = n - 1 - after[::-1], two[::-1]
    length, source = np.maximum(one, two), np.where(one >= two, before, after)
    return length, np.where(length > 0, source, np.arange(n))


def first_documents(raw: np.ndarray, at: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each suffix (``at`` in ``raw``, of document ``doc``) the first document with a
    suffix that agrees with it on ``least`` bytes: where its previous factors lead."""
    columns, widths = [], []
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    for step in range(0, least, 8):
        keep = min(8, least - step)
        columns.append(words[at + step].astype(np.uint64) >> np.uint64(64 - 8 * keep))
        widths.append(keep)
    order = np.lexsort(columns[::-1])
    ranked = doc[order]
    length, source = previous_factors(ranked, common_prefixes(columns, widths, order))
    root = np.where(length >= least, source, np.arange(len(order)))
    while True:
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further
    out = np.empty(len(at), np.int64)
    out[order] = ranked[root]
    return out


def _shared(h: np.ndarray, at: np.ndarray, least: int, some: int = 1 << 18) -> np.ndarray:
    """Which suffixes have a string whose hash another one has. Equal strings have equal
    hashes, so the others agree with none on ``least`` bytes."""
    named = [string_hashes(h, at[a : a + some], least) for a in range(0, len(at), some)]
    named = np.concatenate([np.zeros(0, np.uint64), *named])
    order = np.argsort(named)
    same = named[order[1:]] == named[order[:-1]]
    found = np.zeros(len(at), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    return found


def _unlike(raw: np.ndarray, at: np.ndarray, length: np.ndarray, other: np.ndarray, some: int = 1 << 16) -> np.ndarray:
    """Which entries differ in their bytes from entry ``other`` of theirs."""
    out = length != length[other]
    left = np.flatnonzero(~out & (other != np.arange(len(at))))
    for a in range(0, len(left), some):
        e = left[a : a + some]
        n = length[e]
        start = np.cumsum(n) - n
        nth = np.arange(int(n.sum())) - np.repeat(start, n)
        differ = raw[np.repeat(at[e], n) + nth] != raw[np.repeat(at[other[e]], n) + nth]
        out[e] = np.logical_or.reduceat(differ, start)
    return out


def _answer(least: int):
    def answer(table: pa.Table) -> pa.Table:
        splits, lows, marks, raws, counts = table.column("split").to_pylist(), [], [], [], []
        for blob in table.column("data").to_pylist():
            n = int(np.frombuffer(blob, "<i8", 1)[0])
            lows.append(np.frombuffer(blob, "<i8", n, 8))
            marks.append(np.frombuffer(blob, "<u2", n, 8 + 8 * n).astype(np.int64))
            raws.append(zstandard.decompress(blob[8 + 10 * n :]))
            counts.append(n)
        low, mark = np.concatenate(lows), np.concatenate(marks)
        raw = np.frombuffer(b"".join(raws), np.uint8)
        size, several = mark >> 1, (mark & 1).astype(bool)
        length = size + least - 1
        at = np.cumsum(length) - length
        h = anchor_hashes(raw)
        anchor = np.empty(len(at), np.uint64)
        key = np.empty(len(at), np.uint64)
        for a in range(0, len(at), 1 << 16):
            some = at[a : a + (1 << 16)]
            anchor[a : a + (1 << 16)] = np.min([h[some + k] for k in range(least - ANCHOR + 1)], axis=0) & ~PLACE
            key[a : a + (1 << 16)] = run_keys(h, some, size[a : a + (1 << 16)], least)
        # distinct runs with their first document; of each anchor
        order = np.lexsort((low, key, anchor))
        first = np.flatnonzero(_new(key[order], anchor[order]))
        run_of = np.empty(len(order), np.int64)
        run_of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        run = order[first]  # the entry that stands for a distinct run
        torn = np.zeros(len(run), bool)  # keys of several runs: nothing is told of them
        torn[run_of[_unlike(raw, at, length, run[run_of])]] = True
        run_doc = low[run]
        again = np.zeros(len(run), bool)
        again[1:] = anchor[run][1:] == anchor[run][:-1]
        again[:-1] |= again[1:]
        # suffixes of the runs of anchors with several distinct runs
        mixed = np.flatnonzero(again)
        times = size[run[mixed]]
        base = np.zeros(len(run), np.int64)
        base[mixed] = np.cumsum(times) - times
        nth = np.arange(int(times.sum())) - np.repeat(base[mixed], times)
        suffix = np.repeat(at[run[mixed]], times) + nth
        earliest = np.repeat(run_doc[mixed], times)
        met = np.flatnonzero(_shared(h, suffix, least))
        earliest[met] = first_documents(raw, suffix[met], earliest[met], least)
        # a run whose suffixes all have the same answer is as good as one without others
        same = np.ones(len(run), bool)
        if len(mixed):
            lo, hi = np.minimum.reduceat(earliest, base[mixed]), np.maximum.reduceat(earliest, base[mixed])
            same[mixed] = lo == hi
            run_doc = run_doc.copy()
            run_doc[mixed] = lo
        tell = (several | (run_doc[run_of] < low)) & ~torn[run_of]
        out = []
        edges = np.cumsum([0, *counts])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            mine = np.flatnonzero(tell[a:b]) + a
            plain, odd = mine[same[run_of[mine]]], mine[~same[run_of[mine]]]
            n = size[odd]
            which = np.repeat(base[run_of[odd]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append(
                np.array([len(plain), len(odd)], "<i8").tobytes()
                + key[plain].astype("<u8").tobytes()
                + run_doc[run_of[plain]].astype("<i8").tobytes()
                + key[odd].astype("<u8").tobytes()
                + n.astype("<i8").tobytes()
                + earliest[which].astype("<i8").tobytes()
            )
        return pa.Table.from_arrays(
            [pa.array([0] * len(out), pa.int64()), pa.array(splits, pa.int64()), pa.array(out, pa.binary())],
            schema=BLOB,
        )

    return answer


def _unpack(answers: pa.Table):
    """All answers for a split: keys in order, where the documents of each start, how many
    there are (1: the same for all suffixes of the run), the documents."""
    keys, docs, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob in answers.column("data").to_pylist():
        plain, odd = np.frombuffer(blob, "<i8", 2).tolist()
        at = 16
        keys += [np.frombuffer(blob, "<u8", plain, at)]
        docs += [np.frombuffer(blob, "<i8", plain, at + 8 * plain)]
        counts += [np.ones(plain, np.int64)]
        at += 16 * plain
        sizes = np.frombuffer(blob, "<i8", odd, at + 8 * odd)
        keys += [np.frombuffer(blob, "<u8", odd, at)]
        docs += [np.frombuffer(blob, "<i8", int(sizes.sum()), at + 16 * odd)]
        counts += [sizes]
    key, count = np.concatenate(keys), np.concatenate(counts)
    start = np.cumsum(count) - count
    order = np.argsort(key, kind="stable")
    # two answers under one key are answers for two runs
    ranked = key[order]
    apart = np.ones(len(ranked) + 1, bool)
    apart[1:-1] = ranked[1:] != ranked[:-1]
    order = order[apart[1:] & apart[:-1]]
    return key[order], start[order], count[order], np.concatenate(docs)


def _cut_out(least: int, with_kept: bool):
    def cut_out(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        key, start, count, docs = _unpack(answers)
        ids, raws = _ids(table), table.column("raw").to_pylist()
        found: list[list[np.ndarray]] = [[] for _ in raws]  # removed [from, to) of each row
        for data, starts, lengths, row, offset in _pieces(table, least):
            if not len(key):
                break
            runs = Runs(data, starts, lengths, least)
            named = runs.keys()
            at = np.minimum(np.searchsorted(key, named), len(key) - 1)
            hit = np.flatnonzero(key[at] == named)
            at = at[hit]
            n = runs.size[hit]
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            first = docs[np.repeat(start[at], n) + np.where(np.repeat(count[at], n) > 1, nth, 0)]
            suffix = np.repeat(runs.at[hit], n) + nth
            piece = np.searchsorted(starts, suffix, "right") - 1
            gone = first < ids[row[piece]]
            suffix, piece = suffix[gone], piece[gone]
            if not len(suffix):
                continue
            # strings that touch or overlap make one span
            apart = np.ones(len(suffix), bool)
            apart[1:] = (suffix[1:] > suffix[:-1] + least) | (piece[1:] != piece[:-1])
            begin = np.flatnonzero(apart)
            end = np.append(begin[1:], len(suffix)) - 1
            shift = offset[piece[begin]] - starts[piece[begin]]
            spans = np.stack([suffix[begin] + shift, suffix[end] + shift + least], axis=1)
            for r, span in zip(row[piece[begin]].tolist(), spans):
                found[r].append(span)
        rows = []
        for doc, raw, spans in zip(table.column("doc_id").to_pylist(), raws, found):
            merged: list[list[int]] = []
            for a, b in (s.tolist() for s in spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            if merged:
                ends = [0, *(x for s in merged for x in s), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
            else:
                left = raw
            rows.append(
                (doc, len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(),
                 [{"start": a, "end": b} for a, b in merged], left if with_kept else None)
            )
        return pa.Table.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(map(list, zip(*rows)), RESULT)], schema=RESULT
        )

    return cut_out


def remove_repeats(
    documents: DataFrame,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_kept: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans
    (maximal removed runs, [start, end) in bytes), and ``kept`` (the remaining bytes) if
    asked for.

    Texts are UTF-8 bytes, null is empty. Matches never cross documents; a string that
    repeats within one document, or in rows with the same doc_id, stays. A null doc_id is
    smaller than any other. Strings are judged on the input. Other columns are ignored. An
    empty table gives an empty result. ``least`` is 17 or more.
    """
    if least <= ANCHOR:
        raise ValueError(f"least has to be over {ANCHOR}")
    spark = documents.sparkSession
    texts = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).cast("binary").alias("raw")
    )
    total = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = groups_for(spark, total, SPLIT_BYTES)
    split = F.pmod(F.xxhash64("doc_id", "raw"), F.lit(n))
    texts = texts.withColumn("split", split).repartition(n, "split")
    sides = texts.groupBy("split").applyInArrow(_send_sides(n, least), BLOB_SQL)
    shared = sides.groupBy("part").applyInArrow(_meet, BLOB_SQL)
    runs = (
        texts.groupBy("split").cogroup(shared.groupBy("split")).applyInArrow(_send_runs(n, least), BLOB_SQL)
    )
    answers = runs.groupBy("part").applyInArrow(_answer(least), BLOB_SQL)
    result = (
        texts.groupBy("split")
        .cogroup(answers.groupBy("split"))
        .applyInArrow(_cut_out(least, with_kept), RESULT_SQL)
    )
    return result if with_kept else result.drop("kept")
