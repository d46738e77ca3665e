"""Anchors: content-defined positions that any two equal windows share.

Of the k-grams in a window of ``window`` units the one of least hash is its
anchor (of equals the leftmost).  Two equal windows have their anchors at the
same offset, so a window that repeats has an anchor whose k-gram repeats.
Consecutive windows mostly share an anchor; what is recorded is the anchor and
the range of windows that it stands for.
"""

from __future__ import annotations

import numpy as np

_STEP = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: Units of one pass; positions inside a pass take the low bits of the order.
CHUNK_BITS = 20
_LOW = np.uint64((1 << CHUNK_BITS) - 1)


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams, k a power of two, by doubling."""
    h, n, step = units.astype(np.uint64), 1, 0
    while n < k:
        h = h[:-n] * _STEP[step] + h[n:]
        h ^= h >> np.uint64(29)
        n, step = 2 * n, step + 1
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, out = 1, x
    while 2 * n <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    if n < width:
        out = np.minimum(out[: len(out) - (width - n)], out[width - n :])
    return out


def anchors(units: np.ndarray, lengths: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """For documents laid end to end: (document, anchor position, first and last window start, k-gram hash) of every anchor.

    Positions count from the document's start.  At most 2**CHUNK_BITS units.
    """
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(units) < window:
        return none
    h = gram_hashes(units, k)
    order = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(order, window - k + 1)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.maximum(lengths - window + 1, 0)
    firsts = starts[counts > 0]
    counts_ = counts[counts > 0]
    if not len(firsts):
        return none
    valid = np.zeros(len(least) + 1, np.int8)  # windows inside one document
    np.add.at(valid, firsts, 1)
    np.add.at(valid, np.minimum(firsts + counts_, len(least)), -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    low = least[at] & _LOW
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    pos = low[new].astype(np.int64)
    doc = np.searchsorted(ends, first, side="right")
    base = starts[doc]
    return doc, pos - base, first - base, last - base, h[pos]
