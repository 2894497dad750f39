"""Word shingles of texts as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd multipliers of the polynomial over bytes and of the one over words, and of the final mix.
_BYTE, _WORD, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.cumprod(np.full(n - 1, base, dtype=np.uint64))
    return out


_INVERSE = np.uint64(pow(int(_BYTE), -1, 1 << 64))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each run of non-space bytes, A-Z lower-cased, by sums of a polynomial over the bytes."""
    b = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[b]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(len(b), _BYTE), out=sums[1:])
    # divided by the power at its start, a word's sum does not depend on its place
    back = _powers(len(b), _INVERSE)[starts]
    return mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; of the whole sequence if it is shorter; none without words."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = total * _WORD + h[k : len(h) - n + 1 + k]
    return np.unique(mix(total))
