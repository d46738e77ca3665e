"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are split by prefixes of variable length.  A prefix starts as the
k-gram at an anchor (``repeats``); one whose group would be over the memory
that a task should take is solved in parts and, if too much is left of these,
extended to the whole window.  Neighbouring prefixes share a task until it has
its fill.  Each task then builds the subtree of the suffixes of its spans: the
suffixes in order, the common prefix of every two neighbours, and from these
the internal nodes.  All leaves below an internal node at least 35 words deep
share a window, so a node is a repeat, as long as it is deep; its leaves are
the occurrences, and all of them go.

Spans with the same bytes are one span with several occurrences, and every
occurrence of such a span goes.

Defined cases: null text has no words; texts shorter than the window lose
nothing; identical rows repeat each other and lose all their windows; a null
id is an id like any other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from chunkwright.llm.common import table
from chunkwright.llm.repeats import Kind, without_repeats

WINDOW, ANCHOR = 35, 8
_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _numbers(spans: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, each span followed by an end of its own; positions of the ends."""
    known: dict[bytes, int] = {}
    out: list[int] = []
    ends = []
    for words in spans:
        out += [known.setdefault(w, len(known)) for w in words]
        ends.append(len(out))
        out.append(-1)
    numbers = np.array(out, np.int64)
    numbers[ends] = len(known) + np.arange(len(ends))
    return numbers, np.array(ends)


def _dense(key: np.ndarray) -> np.ndarray:
    """The rank of each value among the different ones."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    return out


class Subtree:
    """The suffix tree of some spans: ``order`` (the leaves), ``common`` (the words that a leaf shares with the one before)."""

    def __init__(self, spans: list[list[bytes]]):
        numbers, self.ends = _numbers(spans)
        n = len(numbers)
        ranks, step = [_dense(numbers)], 1
        longest = max(map(len, spans)) + 1
        while step < longest and ranks[-1].max() < n - 1:  # names of twice the length, until all differ
            rank = ranks[-1]
            later = np.full(n, -1, np.int64)
            later[:-step] = rank[step:]
            ranks.append(_dense(rank * np.int64(n + 1) + later + 1))
            step *= 2
        self.order = np.argsort(ranks[-1], kind="stable")
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(n, np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            # an end is a word of its own, so a common part never leaves its span
            same = np.flatnonzero((np.maximum(a, b) < n) & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)]))
            common[1:][same] += 1 << level
            a[same] += 1 << level
            b[same] += 1 << level
        self.common = common

    def nodes(self, least: int) -> list[tuple[int, int, int]]:
        """The internal nodes at least ``least`` words deep: depth, first and last leaf."""
        found, open_ = [], []
        deep = np.flatnonzero(self.common >= least)
        before = -1
        for i, depth in zip(deep.tolist(), self.common[deep].tolist(), strict=True):
            if i != before + 1:
                found += [(d, first, before) for d, first in open_]
                open_ = []
            first = i - 1
            while open_ and open_[-1][0] > depth:
                d, first = open_.pop()
                found.append((d, first, i - 1))
            if not open_ or open_[-1][0] < depth:
                open_.append((depth, first))
            before = i
        return found + [(d, first, before) for d, first in open_]

    def leaves_below(self, least: int) -> np.ndarray:
        """Positions of the leaves below nodes at least ``least`` words deep."""
        edge = np.zeros(len(self.order) + 1, np.int64)
        for _, first, last in self.nodes(least):
            edge[first] += 1
            edge[last + 1] -= 1
        return np.sort(self.order[np.cumsum(edge[:-1]) > 0])


def repeated(spans: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(span, start) of every window that occurs more than once in the spans."""
    split = [x.split() for x in spans]
    tree = Subtree(split)
    at = tree.leaves_below(window)
    of = np.searchsorted(tree.ends, at)
    lengths = np.array([len(x) for x in split], np.int64)
    return of, at - (tree.ends[of] - lengths[of])


KIND = Kind(window=WINDOW, k=ANCHOR, by_words=True, keep_first=False, kernel=repeated)


def _cut(id_: int, text: bytes, runs: list[tuple[int, int]]) -> dict:
    words = text.split()
    kept, at = [], 0
    for a, b in runs:
        kept += words[at:a]
        at = b
    left = b" ".join(kept + words[at:])
    return {"doc_id": id_, "n_words": len(words), "n_removed": sum(b - a for a, b in runs), "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left.decode()}


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: bool = True) -> DataFrame:
    """One row per document: words, words removed, the digest of those kept, and, if asked for, the text kept."""
    return without_repeats(docs, KIND, _cut, _SCHEMA if kept else _SCHEMA.removesuffix(", kept string"), id_col, text_col)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), kept=False)
