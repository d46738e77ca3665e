"""Suffix-array dedup by merging shard Burrows-Wheeler transforms.

Of every 100-byte string that occurs more than once, all but the first
occurrence go (``repeats`` finds where the text can repeat at all, and brings
the spans in question together).  A task's spans are split into shards of
about ``SHARD`` by document.  Each shard has its transform: for its suffixes
in order, the symbols before them.  The shards are merged by refining their
interleave: an order of the shard numbers sorted by the first h symbols becomes
one sorted by the first h + 2 if each shard's transform is read along it and
the symbols read are distributed stably.  Where neighbours part in a pass,
their common prefix has the length reached by then (to within two symbols);
intervals whose common prefixes reach 100 symbols are the repeats.  No suffix
is sorted again.

Transforms of all suffixes of a corpus would have to be read some fifty times
to be merged, so only spans with an anchor that occurs again, and different
from others in their bytes, have one.

Defined cases: null text is the empty text; matches never cross documents;
texts shorter than the window lose nothing; identical rows repeat each other,
the one later in (id, text) order losing its text; a null id comes first; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from chunkwright.llm.common import table
from chunkwright.llm.repeats import Kind, without_repeats

WINDOW, ANCHOR, SHARD = 100, 32, 512
#: Ends a span; never a byte of UTF-8.
_END = 0xFF
_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _suffix_order(text: np.ndarray, after: np.ndarray, longest: int) -> np.ndarray:
    """All suffixes in order, each span read as a ring, by doubling; equal rings in the order of their spans.

    A rank is the number of smaller suffixes, so a suffix that is alone in its
    rank needs no further look.
    """
    counts = np.bincount(text, minlength=256)
    rank = (np.cumsum(counts) - counts)[text]
    live, step = np.flatnonzero(counts[text] > 1), 1
    while len(live) and step <= longest:
        key = rank[live] * np.int64(len(text) + 1) + rank[after[live]]
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        old = rank[live]
        head = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.arange(len(live))
        rank[live] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        live = live[~(new & np.concatenate([new[1:], [True]]))]
        after, step = after[after], step * 2
    return np.argsort(rank, kind="stable")


class Transform:
    """A shard's suffixes in order, with the two symbols before each."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, base: int):
        begins = np.concatenate([[0], ends[:-1] + 1])
        before, after = np.arange(-1, len(text) - 1), np.arange(1, len(text) + 1)
        before[begins], after[ends] = ends, begins  # a span is a ring
        order = _suffix_order(text, after, int((ends - begins).max()) + 1)
        one = before[order]
        self.symbols = text[before[one]].astype(np.uint16) << 8 | text[one]
        self.positions = order + base


def merge(shards: list[Transform], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their first ``window`` symbols, and what each has in common with the one before.

    The common prefix is that of whole passes of two symbols; ``window`` where
    two stay together.  A border stays where it is once it is found.
    """
    which = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(x.positions) for x in shards])
    all_symbols = np.concatenate([x.symbols for x in shards])
    common = np.full(len(which), window, np.int32)
    common[0] = 0
    symbols = np.empty(len(which), np.uint16)
    for depth in range(0, window, 2):
        symbols[np.argsort(which, kind="stable")] = all_symbols  # each shard's, in its own order
        read = symbols & np.uint16(0xFF) if depth + 1 == window else symbols  # an odd length: the nearer symbol only
        order = np.argsort(read, kind="stable")
        block = np.cumsum(common < window, dtype=np.int32)[order]
        read, which = read[order], which[order]
        parted = np.flatnonzero((read[1:] != read[:-1]) | (block[1:] != block[:-1])) + 1
        common[parted] = np.where(common[parted] < window, common[parted], depth)
    positions = np.empty(len(which), np.int64)
    positions[np.argsort(which, kind="stable")] = np.concatenate([x.positions for x in shards])
    return positions, common


def repeated(spans: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(span, start) of every window that also starts earlier, for spans in order."""
    lengths = np.array([len(x) + 1 for x in spans])
    text = np.frombuffer(bytes([_END]).join(spans) + bytes([_END]), np.uint8)
    ends = np.cumsum(lengths) - 1
    step = max(SHARD, -(-len(spans) // 255))
    shards = []
    for a in range(0, len(spans), step):
        b = min(a + step, len(spans))
        base = ends[a] - lengths[a] + 1
        shards.append(Transform(text[base : ends[b - 1] + 1], ends[a:b] - base, int(base)))
    positions, common = merge(shards, window)
    block = np.cumsum(common < window)
    of = np.searchsorted(ends, positions)
    inside = positions + window <= ends[of]
    positions, block = positions[inside], block[inside]
    if not len(positions):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    least = np.minimum.reduceat(positions, heads)
    later = np.sort(positions[positions != np.repeat(least, np.diff(np.append(heads, len(positions))))])
    of = np.searchsorted(ends, later)
    return of, later - (ends[of] - lengths[of] + 1)


KIND = Kind(window=WINDOW, k=ANCHOR, by_words=False, keep_first=True, kernel=repeated, chunk=2048)


def _cut(id_: int, text: bytes, runs: list[tuple[int, int]]) -> dict:
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    left = b"".join([*kept, text[at:]])
    return {"doc_id": id_, "n_bytes": len(text), "n_removed": len(text) - len(left), "n_spans": len(runs), "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left.decode("utf-8", "replace")}


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: bool = True) -> DataFrame:
    """One row per document: sizes, the digest of the bytes kept, and, if asked for, the text kept.

    ``kept`` shows a character cut in two as a replacement sign; the digest is
    of the bytes.
    """
    return without_repeats(docs, KIND, _cut, _SCHEMA if kept else _SCHEMA.removesuffix(", kept string"), id_col, text_col)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents"), kept=False)
