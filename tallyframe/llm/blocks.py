"""Pairs within a block of rows, in numpy."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa


def give_back() -> None:
    """Return to the system what was freed: a worker lives on, and what it keeps for later counts as the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches by the pairs (i, j)."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            break
    return low
