"""Minimal perfect hash over distinct 32-byte digests.

Levelled construction: at each level the keys still without a place hash into
a bit array of twice their number; a key that is alone in its bit stays, the
others go on to the next level.  A key's index is the rank of its bit over all
levels.  What is left after the last level is kept as a plain sorted tail.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
LEVELS = 24
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _slots(words: np.ndarray, level: int, size: int) -> np.ndarray:
    step = words[:, 1] | np.uint64(1)
    return (_mix(words[:, 0] + np.uint64(level + 1) * step) % np.uint64(size)).astype(np.int64)


def as_matrix(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), 32)


class PerfectHash:
    """Index 0..n-1 for n distinct digests; other digests get some index or -1."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], tail: np.ndarray):
        self.sizes, self.bits, self.tail = sizes, bits, tail
        ranks, below = [], 0
        for level in bits:
            ranks.append(below + np.cumsum(level, dtype=np.int64) - level)
            below += int(level.sum())
        self.ranks, self.in_levels = ranks, below
        self.tail_keys = {bytes(x): below + i for i, x in enumerate(tail)}

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        left = np.ascontiguousarray(digests)
        sizes, bits = [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(8, int(len(left) * GAMMA))
            at = _slots(left.view(np.uint64), level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        return cls(sizes, bits, left)

    def index(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1, np.int64)
        words = np.ascontiguousarray(digests).view(np.uint64).reshape(len(digests), 4)
        open_ = np.arange(len(digests))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                return out
            at = _slots(words[open_], level, size)
            hit = self.bits[level][at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        for i in open_:
            out[i] = self.tail_keys.get(bytes(digests[i]), -1)
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), len(self.tail), *self.sizes], np.int64).tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.bits) + self.tail.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        levels, tail = np.frombuffer(data, np.int64, 2)
        sizes = [int(x) for x in np.frombuffer(data, np.int64, levels, 16)]
        at, bits = 16 + 8 * int(levels), []
        for size in sizes:
            n = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, n, at), count=size).astype(bool))
            at += n
        return cls(sizes, bits, np.frombuffer(data, np.uint8, 32 * int(tail), at).reshape(int(tail), 32))
