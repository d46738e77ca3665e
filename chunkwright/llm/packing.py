"""Sequence packing by the online sum-of-squares rule.

Each task reads its part of the documents once, in order.  A document's ids
are cut at every ``window`` ids; whole pieces are sequences of their own.  The
rest, shorter than a window, is placed online: ``counts[h]`` holds how many
partly filled windows are filled up to h, and a piece of length s goes on the
level h (0: a new window) for which the sum of the squared counts grows least.

Ids are kept only for windows still open, so memory is bounded: past
``MAX_OPEN`` open windows (64 MB of ids), and at the end of a task, the
emptiest are taken apart and their pieces cut to fill the gaps of the fullest,
which keep all that was placed in them.  What then remains, less than a window
in each task, becomes sequences of a power of two, which need no padding, and
one of at most ``LEAST`` ids.  Nothing is shuffled, and a lost task repeats
its own part with the same sequence numbers (task number, then a counter).

Ids are those of the ``tokenizers`` library for the given vocabulary; the same
byte-level ranks are run by ``tiktoken``, which is several times faster
(``tests/llm`` compares the two).  Its expressions fail on runs of a million
white-space characters, so runs of ``LONG_SPACE`` or more never reach them:
such a run, less its last character if text follows, is one piece in any case,
and its ids come from the ranks directly.

Defined cases: null text is the empty text and gives the end id alone;
identical rows are packed once each; an empty table gives no rows; columns
other than id and text are ignored; texts of any length are encoded whole, cut
only between two words where the tokenizer cuts in any case.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chunkwright.llm.common import pick, table, tidied

WINDOW, END_ID, MAX_OPEN, LEAST = 1024, 0, 16384, 64
LONG_TEXT = 1_000_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LONG_SPACE = 100_000
#: White space as the tokenizer's expressions have it, which is not quite that of ``re``.
_LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)
END_TEXT = "<|endoftext|>"
_BETWEEN_WORDS = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(ranks_path: str):
    """Encoding of a byte-level vocabulary of ranks; the text of the end marker is its id, as in ``tokenizers``."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_TEXT: len(ranks)})


def encode(text: str, ranks_path: str) -> np.ndarray:
    if len(text) < LONG_SPACE:
        return _encode(text, ranks_path)
    parts, at = [], 0
    for run in _LONG_RUN.finditer(text):
        to = run.end() if run.end() == len(text) or text.startswith(END_TEXT, run.end()) else run.end() - 1
        parts.append(_encode(text[at : run.start()], ranks_path))
        parts.append(np.array(encoder(ranks_path)._encode_single_piece(text[run.start() : to].encode()), np.uint32))
        at = to
    parts.append(_encode(text[at:], ranks_path))
    return np.concatenate(parts)


def _encode(text: str, ranks_path: str) -> np.ndarray:
    enc = encoder(ranks_path)
    if len(text) <= LONG_TEXT:
        return np.array(enc.encode(text, allowed_special="all"), np.uint32)
    parts, at = [], 0
    while at < len(text):
        cut = _BETWEEN_WORDS.search(text, at + LONG_TEXT)
        to = cut.start() if cut else len(text)
        parts.append(np.array(enc.encode(text[at:to], allowed_special="all"), np.uint32))
        at = to
    return np.concatenate(parts)


class SumOfSquares:
    """Open windows by fill level; ``place`` returns the window that a piece closes, if any."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = 0

    def level_for(self, size: int) -> int:
        top = self.window - size
        growth = (self.counts[size:] - self.counts[: top + 1]).astype(np.float64) + 1
        growth[0] = self.counts[size] + 0.5
        growth[top] = 0.5 - self.counts[top]
        growth[1:][self.counts[1 : top + 1] == 0] = np.inf
        return top - int(np.argmin(growth[::-1]))  # of equals the fullest

    def place(self, size: int, piece) -> list | None:
        level = self.level_for(size)
        held = []
        if level:
            held = self.levels[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        held.append(piece)
        if level + size == self.window:
            return held
        self.levels[level + size].append(held)
        self.counts[level + size] += 1
        self.open += 1
        return None

    def top_up(self, most: int) -> tuple[list[list], list, int]:
        """Windows filled until at most ``most`` are open, what is left of the last one taken apart, and the ids moved.

        The fullest windows keep all that was placed in them; the emptiest are
        taken apart, and their pieces, cut where a window is full, fill the gaps.
        """
        by_fill = [(fill, held) for fill in range(self.window, 0, -1) for held in self.levels[fill]]
        first, last, moved, full = 0, len(by_fill), 0, []
        loose: list = []
        while first < last and (loose or last - first > most):
            fill, held = by_fill[first]
            while fill < self.window and (loose or last - first > 1):
                if not loose:
                    last -= 1
                    loose = list(by_fill[last][1])
                doc, start, ids, total = loose.pop()
                part, rest = ids[: self.window - fill], ids[self.window - fill :]
                if len(rest):
                    loose.append((doc, start + len(part), rest, total))
                held.append((doc, start, part, total))
                fill, moved = fill + len(part), moved + len(part)
            first += 1
            if fill < self.window:
                loose = held
                break
            full.append(held)
        self.__init__(self.window)
        for fill, held in by_fill[first:last]:
            self.levels[fill].append(held)
            self.counts[fill] += 1
            self.open += 1
        return full, loose, moved


def powers(pieces: list, window: int) -> list[list]:
    """Less than a window as sequences of a power of two, which need no padding, and one of at most ``LEAST`` ids."""
    out: list[list] = []
    left = sum(len(p[2]) for p in pieces)
    pieces = pieces[::-1]
    while left:
        size = window
        while size > LEAST and size > left:
            size //= 2
        size, held = min(size, left), []
        left -= size
        while size:
            doc, start, ids, total = pieces.pop()
            part, rest = ids[:size], ids[size:]
            if len(rest):
                pieces.append((doc, start + len(part), rest, total))
            held.append((doc, start, part, total))
            size -= len(part)
        out.append(held)
    return out


def pack_stream(docs: Iterator[tuple[int, np.ndarray]], window: int = WINDOW, max_open: int = MAX_OPEN, moved: list[int] | None = None) -> Iterator[list]:
    """Sequences, each a list of (doc, start, ids, total); the ids that left the window they were placed in are appended to ``moved``."""
    levels = SumOfSquares(window)
    for doc, ids in docs:
        total = len(ids)
        whole = total - total % window
        for at in range(0, whole, window):
            yield [(doc, at, ids[at : at + window], total)]
        if whole < total:
            full = levels.place(total - whole, (doc, whole, ids[whole:], total))
            if full is not None:
                yield full
        if levels.open > max_open:
            windows, left, n = levels.top_up(max_open // 2)
            yield from windows
            for piece in left:
                full = levels.place(len(piece[2]), piece)
                if full is not None:
                    yield full
            if moved is not None:
                moved.append(n)
    windows, left, n = levels.top_up(0)
    yield from windows
    yield from powers(left, window)
    if moved is not None:
        moved.append(n)


def _pack(ranks_path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36

        def docs():
            for batch in batches:
                for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
                    yield doc.as_py(), np.append(encode(text.as_py() or "", ranks_path), np.uint32(end_id)).astype("<u4")

        rows = []
        names = [x.split()[0] for x in _PIECES.split(", ")]
        for n, held in enumerate(pack_stream(docs(), window)):
            offset = 0
            for doc, start, ids, total in held:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first + n, offset))
                offset += len(ids)
            if len(rows) >= 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = pick(docs, id=id_col, text=text_col)
    rows = rows.select(rows["id"].cast("long").alias("id"), "text")
    return rows.mapInArrow(tidied(_pack(ranks_path or vocabulary(), window, end_id)), _PIECES)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
