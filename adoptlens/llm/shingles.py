"""Word shingles of many texts at once, as hashes, with numpy."""

from __future__ import annotations

import numpy as np

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\v\f\r"
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in SPACES else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 21), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, A-Z lower-cased, and how many words each has."""
    raws = [(t or "").encode("utf-8", "surrogatepass").translate(FOLD) for t in texts]
    data = np.frombuffer(b" " + b" ".join(raws) + b" ", dtype=np.uint8)
    word = data != 32
    start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    end = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    total = np.concatenate(
        [np.zeros(1, np.uint64), np.cumsum(_CODE[data] * _power("up", _BASE, len(data)), dtype=np.uint64)]
    )
    hashes = (total[end] - total[start]) * _power("down", _INVERSE, len(data))[start]
    hashes = mix(hashes + (end - start).astype(np.uint64) * _STEP)
    edges = np.cumsum([0] + [len(r) + 1 for r in raws])
    counts = np.diff(np.searchsorted(start, edges + 1))
    return hashes, counts


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``words`` words; of the whole
    sequence as one shingle where it is shorter; none without words."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * _STEP + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= words:
            out.append(np.unique(rolled[at : at + count - words + 1]))
        elif count:
            whole = np.uint64(count)
            with np.errstate(over="ignore"):
                for h in hashes[at : at + count]:
                    whole = whole * _STEP + h
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
