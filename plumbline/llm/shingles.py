"""Words and shingles of texts as 64-bit hashes, for operators that compare texts by them."""

from __future__ import annotations

import numpy as np
import xxhash

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xC2B2AE3D27D4EB4F)
_S, _T = np.uint64(29), np.uint64(32)


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """One hash for each word; ``lower`` folds A-Z first. bytes.split() cuts at blank, tab, line feed, VT, FF and CR."""
    data = (text or "").encode()
    return np.array([xxhash.xxh3_64_intdigest(w) for w in (data.lower() if lower else data).split()], dtype=np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _M) ^ (b + _N)
    h ^= h >> _S
    h *= _N
    h ^= h >> _T
    return h


def sequence_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """One hash for each run of ``size`` words, none if there are fewer; runs of doubling length are put together."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, size + (seed << 32), dtype=np.uint64)
    level, width, at = words, 1, 0
    while width <= size:
        if size & width:
            out = _mix(out, level[at : at + n])
            at += width
        if 2 * width <= size:
            level = _mix(level[:-width], level[width:])
        width *= 2
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingles of lower-cased words; a text with fewer words has its whole sequence as the only one."""
    words = word_hashes(text, lower=True)
    return np.unique(sequence_hashes(words, min(size, len(words)))) if len(words) else np.empty(0, dtype=np.uint64)
