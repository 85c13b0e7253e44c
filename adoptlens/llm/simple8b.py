"""Simple-8b: as many ids as fit go into one 64-bit word, after a selector of four bits.

A block is an independent run of words for at most ``BLOCK`` ids. Values of more than 60
bits are escapes: their word only marks the place, and the values follow in the block's
escape list, so that all words of a block decode together.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 16
#: Fixed values of the code: selector -> (ids in a word, bits of each). 0 marks an escape.
SELECTORS = {
    0: (1, 0), 1: (120, 0), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6),
    8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60),
}
COUNTS = np.array([SELECTORS[s][0] for s in range(16)], dtype=np.int64)
PAYLOAD = np.uint64((1 << 60) - 1)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value; of some over 53 bits one more than it has, so these are escapes."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def encode_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words and the escape list of up to BLOCK unsigned 64-bit values."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.concatenate([values, np.zeros(int(COUNTS.max()), np.uint64)])
    # the widest of the next 1, 2, 3, ... values, each from the one before
    widest, width = _bits(padded), 1
    choice = np.zeros(n, np.uint8)  # an escape, unless something fits
    for selector in range(15, 0, -1):
        count, bits = SELECTORS[selector]
        if count > width:
            widest = np.maximum(widest[: len(widest) - (count - width)], widest[count - width :])
            width = count
        choice[widest[:n] <= bits] = selector
    step, starts, at = COUNTS[choice].tolist(), [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    start = np.array(starts, dtype=np.int64)
    chosen = choice[start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in range(2, 16):
        rows = np.flatnonzero(chosen == selector)
        if len(rows):
            count, bits = SELECTORS[selector]
            first = start[rows]
            for k in range(count):
                words[rows] |= padded[first + k] << np.uint64(k * bits)
    return words, values[start[chosen == 0]]


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of a block."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    payload = words & PAYLOAD
    for selector in range(2, 16):
        rows = np.flatnonzero(chosen == selector)
        if len(rows):
            count, bits = SELECTORS[selector]
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[first[rows] + k] = (payload[rows] >> np.uint64(k * bits)) & mask
    out[first[chosen == 0]] = escapes
    return out[:n]


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """A stream: how many values, blocks and values per block, the words and escapes
    before each block, the words, the escapes."""
    pieces = [encode_block(values[at : at + block]) for at in range(0, len(values), block)]
    offsets = np.zeros((len(pieces) + 1, 2), np.uint64)
    if pieces:
        offsets[1:] = np.cumsum([[len(w), len(e)] for w, e in pieces], axis=0)
    head = np.array([len(values), len(pieces), block], dtype=np.uint64)
    parts = [head, offsets.ravel(), *(w for w, _ in pieces), *(e for _, e in pieces)]
    return b"".join(p.astype("<u8").tobytes() for p in parts)


def size_of(data: bytes | memoryview) -> int:
    """Bytes of the stream that ``data`` begins with."""
    n, blocks, _ = np.frombuffer(data[:24], "<u8").tolist()
    ends = np.frombuffer(data[24 + 16 * blocks : 40 + 16 * blocks], "<u8")
    return 8 * (3 + 2 * (blocks + 1) + int(ends.sum()))


def decode_blocks(data: bytes | memoryview):
    """The blocks of a stream one by one; offsets lead to each without decoding the others."""
    n, blocks, block = np.frombuffer(data[:24], "<u8").tolist()
    offsets = np.frombuffer(data[24 : 40 + 16 * blocks], "<u8").reshape(-1, 2).astype(np.int64)
    body = np.frombuffer(data[40 + 16 * blocks : size_of(data)], "<u8")
    words, escapes = body[: offsets[-1, 0]], body[offsets[-1, 0] :]
    for k in range(blocks):
        (w0, e0), (w1, e1) = offsets[k], offsets[k + 1]
        yield decode_block(words[w0:w1], escapes[e0:e1], min(block, n - k * block))


def decode(data: bytes | memoryview) -> np.ndarray:
    found = list(decode_blocks(data))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)
