"""Repeated windows of a corpus: what the suffix-array and the substring dedup share.

1. Every anchor (see ``anchors``) is emitted with its k-gram.  Equal windows
   have equal k-grams at their anchors, so a k-gram that occurs once settles
   that its windows do not repeat; those anchors go no further.
2. Each anchor left fetches its span, the text that its windows cover, and the
   spans meet by k-gram.  Spans with the same bytes are one span that occurs
   several times.  A kernel (merged Burrows-Wheeler transforms, or suffix
   trees) finds the equal windows of the different spans.
3. The windows found are joined to the documents and cut out.

Hashes only decide which task a span goes to; every repeat is found by bytes.

The k-gram is the prefix that splits the suffixes into groups.  A frequent one
(found in a sample of the documents, which only steers how rows are dealt) has
as many parts as its occurrences need; each part is solved by itself and
leaves one representative of each span.  The representatives of a k-gram meet
again.  If they are over ``SPANS``, more than one task should hold, the prefix
is extended to the whole window: every window of theirs is a span of its own,
met by its own text, in parts and then by representatives again.

A document is a row.  Where ids repeat, rows are numbered by (id, text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.anchors import CHUNK_BITS, anchors
from chunkwright.llm.common import MARKS, drop_materialised, materialise, pick, shuffle_partitions, tidied
from chunkwright.llm.runs import whole_runs

#: One document in so many steers how frequent k-grams are dealt.  At most HOT_KEYS are split into parts of about PART
#: spans; any other holds less than 1 / HOT_KEYS of all.
SAMPLE, HOT_LEAST, HOT_KEYS, PART = 0.02, 20, 100_000, 512
#: Representatives of one prefix that one task takes; offsets that share a test before the kernel.
SPANS, STEP = 20_000, 4
_ANCHORS = "gram long, row long, at long"
_SPANS = "gram long, salt int, row long, at long, text binary"
_SOLVED = "kind int, gram long, row long, at long, more long, text binary"
#: at: position of the anchor, windows before it, windows in all, by these factors.
_A, _B = 1 << 16, 1 << 8
#: The salt of a prefix that one task has whole.
WHOLE = -1


@dataclass(frozen=True)
class Kind:
    """``units``: text to units; ``kernel``: spans and windows of whole groups to the windows that go, for about ``chunk`` spans at a time."""

    window: int
    k: int
    by_words: bool
    keep_first: bool
    kernel: Callable
    chunk: int = 8192


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _units(text: bytes, by_words: bool, hashes: _WordHashes) -> np.ndarray:
    if by_words:
        return np.array(list(map(hashes.__getitem__, text.split())), np.uint64)
    return np.frombuffer(text, np.uint8)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _pieces(rows: list[int], units: list[np.ndarray], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of documents (rows, offset in the document, lengths, units); a long document overlaps itself by a window."""
    most = 1 << CHUNK_BITS
    held: list[tuple[int, int, np.ndarray]] = []
    n = 0
    for row, own in zip(rows, units, strict=True):
        for at in range(0, max(1, len(own) - window + 1), most - window):
            part = own[at : at + most - 1]
            if len(part) < window:
                continue
            if n + len(part) >= most and held:
                yield _chunk(held)
                held, n = [], 0
            held.append((row, at, part))
            n += len(part)
    if held:
        yield _chunk(held)


def _chunk(held):
    return np.array([x[0] for x in held]), np.array([x[1] for x in held]), np.array([len(x[2]) for x in held]), np.concatenate([x[2] for x in held])


def _find_anchors(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rows = batch.column("row").to_pylist()
            for at in range(0, len(rows), 256):
                units = [_units(x.as_py() or b"", kind.by_words, hashes) for x in texts[at : at + 256]]
                for row, offset, lengths, laid in _pieces(rows[at : at + 256], units, kind.window):
                    doc, pos, first, last, gram = anchors(laid, lengths, kind.window, kind.k)
                    if len(doc):
                        packed = (pos + offset[doc]) * _A + (pos - first) * _B + (last - first)
                        yield pa.record_batch([_signed(gram), pa.array(row[doc]), pa.array(packed)], names=["gram", "row", "at"])

    return run


def _repeated_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of gram, those whose gram occurs again; a gram that comes in parts does."""
    for part in whole_runs(batches, ["gram", "salt"], 50_000):
        gram = part["gram"].to_numpy()
        same = np.concatenate([[False], gram[1:] == gram[:-1], [False]])
        at = np.flatnonzero(same[1:] | same[:-1] | (part["salt"].to_numpy() != WHOLE))
        if len(at):
            yield from part.take(pa.array(at)).combine_chunks().to_batches()


def _windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last window of anchors."""
    pos, rest = at // _A, at % _A
    first = pos - rest // _B
    return first, first + rest % _B


def _cutter(text: bytes, by_words: bool, window: int) -> Callable[[int, int], bytes]:
    """Text from window ``first`` to the end of window ``last``."""
    if not by_words:
        return lambda first, last: text[first : last + window]
    words = text.split()
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(x + 1 for x in ends)]
    return lambda first, last: joined[starts[first] : ends[last + window - 1]]


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _fetch(kind: Kind):
    """The spans of the anchors asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, texts, rows = batch.column("asked"), batch.column("text").cast(pa.binary()), batch.column("row").to_numpy()
            sizes = asked.value_lengths().to_numpy()
            begin = 0
            while begin < len(rows):  # about 20,000 spans at a time
                end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), 20_000)))
                some = asked.slice(begin, end - begin).flatten()
                gram, salt, at = (some.field(i).to_numpy() for i in range(3))
                first, last = (x.tolist() for x in _windows(at))
                spans, n = [], 0
                for k in range(begin, end):
                    cut = _cutter(texts[k].as_py() or b"", kind.by_words, kind.window)
                    to = n + int(sizes[k])
                    spans += map(cut, first[n:to], last[n:to])
                    n = to
                yield _batch([gram, salt, np.repeat(rows[begin:end], sizes[begin:end]), at, spans], _SPANS)
                begin = end

    return run


def _single(kind: Kind):
    """Every window of the spans as a span of its own, its prefix the whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            first, last = _windows(batch.column("at").to_numpy())
            for i, (row, parts, text) in enumerate(zip(batch.column("row").to_pylist(), batch.column("parts").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                cut = _cutter(text, kind.by_words, kind.window)
                own = [cut(w, w) for w in range(int(last[i] - first[i]) + 1)]
                n = len(own)
                yield _batch([[digest(x) - (1 << 63) for x in own], [row % parts] * n, [row] * n, (np.arange(n) + first[i]) * _A, own], _SPANS)

    return run


def shared_parts(grams: np.ndarray, texts: list[bytes], before: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans worth a look: their numbers, and the first and last window that may repeat.

    Windows whose anchors lie at one of ``STEP`` neighbouring offsets share all
    but STEP - 1 of their units.  If no other span of the k-gram has that
    shared part, none has these windows.
    """
    owner, part, hashes = [], [], []
    digest = xxhash.xxh3_64_intdigest
    for r, (text, b, m) in enumerate(zip(texts, before.tolist(), count.tolist(), strict=True)):
        for i in range((b - m + 1) // STEP, b // STEP + 1):
            owner.append(r)
            part.append(i)
            hashes.append(digest(text[b - i * STEP : b - (i + 1) * STEP + 1 + window], i))
    owner, part = np.array(owner, np.int64), np.array(part, np.int64)
    key = np.array(hashes, np.uint64) ^ (grams[owner].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    owner, part = owner[shared], part[shared]  # in order of owner, then part
    if not len(owner):
        return owner, owner, owner
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    who = owner[heads]
    least, most = part[heads], part[np.concatenate([heads[1:], [len(owner)]]) - 1]
    begin = np.maximum(0, before[who] - ((most + 1) * STEP - 1))
    return who, begin, np.minimum(count[who] - 1, before[who] - least * STEP)


def _solve(kind: Kind):
    """Ranges of windows that go (kind 0), and representatives of the spans of prefixes that come in parts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, ["gram", "salt"], kind.chunk):
            gram, salt, row, at = (part[c].to_numpy() for c in ("gram", "salt", "row", "at"))
            texts = part["text"].to_pylist()
            first, last = _windows(at)
            group = np.concatenate([[0], np.cumsum((gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]))])
            known: dict[tuple[int, bytes], int] = {}
            of = np.array([known.setdefault(x, len(known)) for x in zip(group.tolist(), texts, strict=True)])
            times = np.bincount(of)
            heads = np.flatnonzero(np.diff(np.maximum.accumulate(of), prepend=-1) > 0)  # the first of each span, rows being in order
            gone = np.ones(len(of), bool) if kind.keep_first else times[of] > 1
            if kind.keep_first:
                gone[heads] = False
            gone = np.flatnonzero(gone)
            if len(gone):
                yield _batch([np.zeros(len(gone), np.int32), np.zeros(len(gone), np.int64), row[gone], first[gone], (last - first)[gone], [None] * len(gone)], _SOLVED)
            kept = heads[salt[heads] != WHOLE]
            if len(kept):
                yield _batch([np.ones(len(kept), np.int32), gram[kept], row[kept], at[kept], np.zeros(len(kept), np.int64), [texts[i] for i in kept]], _SOLVED)
            met = heads[np.bincount(group[heads])[group[heads]] > 1]
            if not len(met):
                continue
            met = met[np.lexsort((at[met], row[met]))]
            spans, begin = [texts[i] for i in met], first[met]
            rows = row[met]
            if not kind.by_words:
                rest = at[met] % _A
                who, skip, end = shared_parts(gram[met], spans, rest // _B, rest % _B + 1, kind.window)
                spans = [spans[i][a : b + kind.window] for i, a, b in zip(who.tolist(), skip.tolist(), end.tolist(), strict=True)]
                rows, begin = rows[who], begin[who] + skip
            if not len(spans):
                continue
            span, start = kind.kernel(spans, kind.window)
            if len(span):
                begins = begin[span] + start
                heads = np.flatnonzero(np.concatenate([[True], (span[1:] != span[:-1]) | (start[1:] != start[:-1] + 1)]))
                tails = np.concatenate([heads[1:] - 1, [len(span) - 1]])
                n = len(heads)
                yield _batch([np.zeros(n, np.int32), np.zeros(n, np.int64), rows[span[heads]], begins[heads], begins[tails] - begins[heads], [None] * n], _SOLVED)

    return run


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, text: the id is the row's number, unless ids are null or repeat."""
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    if rows.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty():
        return rows.select(F.col("id").alias("row"), "id", "text")
    return materialise(rows.orderBy("id", "text").select(F.monotonically_increasing_id().alias("row"), "id", "text"), "numbered")


def repeated_windows(rows: DataFrame, kind: Kind) -> DataFrame:
    """row, first, last: the ranges of window starts that go, of rows (row, text)."""
    n = shuffle_partitions(rows.sparkSession)
    if not 0 < kind.window - kind.k < _B:
        raise ValueError("a window must be longer than its anchor, by less than 256 units")
    find = tidied(_find_anchors(kind))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "row"), F.lit(1_000_000)) < int(SAMPLE * 1_000_000)).mapInArrow(find, _ANCHORS)
    parts = F.ceil(F.count(F.lit(1)) / (SAMPLE * PART)).cast("int").alias("parts")
    frequent = sample.groupBy("gram").agg(F.count(F.lit(1)).alias("seen"), parts).filter(F.col("seen") >= HOT_LEAST)
    frequent = materialise(frequent.orderBy(F.desc("seen"), "gram").limit(HOT_KEYS).select("gram", "parts"), "grams")
    found = rows.mapInArrow(find, _ANCHORS).join(F.broadcast(frequent), "gram", "left")  # at most HOT_KEYS rows
    found = found.select("gram", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.lit(WHOLE)).alias("salt"), "row", "at")
    dealt = found.repartition(n, "gram", "salt").sortWithinPartitions("gram")  # the texts are read for anchors once
    # What is left (some 40 % of the anchors of check_l) as a table lets their shuffle go before the spans are written.
    kept = materialise(dealt.mapInArrow(_repeated_grams, "gram long, salt int, row long, at long"), "anchors", free_shuffles=True)
    asked = kept.groupBy("row").agg(F.collect_list(F.struct("gram", "salt", "at")).alias("asked"))
    spans = asked.join(rows.select("row", "text"), "row").select("row", "asked", "text").mapInArrow(tidied(_fetch(kind)), _SPANS)

    def solved(spans: DataFrame) -> DataFrame:
        placed = spans.repartition(n, "gram", "salt").sortWithinPartitions("gram", "salt", "row", "at")
        return materialise(placed.mapInArrow(tidied(_solve(kind)), _SOLVED), "solved", free_shuffles=True)

    out = [solved(spans)]
    if not frequent.isEmpty():
        left = out[0].filter("kind = 1").select("gram", F.lit(WHOLE).alias("salt"), "row", "at", "text")
        wide = left.groupBy("gram").count().filter(F.col("count") > SPANS).select("gram", F.ceil(F.col("count") / SPANS).cast("int").alias("parts"))
        wide = materialise(wide, "wide")
        by_window = left.join(F.broadcast(wide), "gram")  # at most HOT_KEYS rows
        out.append(solved(left.join(F.broadcast(wide), "gram", "left_anti")))
        if not wide.isEmpty():
            single = by_window.select("row", "at", "text", "parts").mapInArrow(_single(kind), _SPANS)
            out.append(solved(single))
            out.append(solved(out[-1].filter("kind = 1").select("gram", F.lit(WHOLE).alias("salt"), "row", "at", "text")))
        drop_materialised(wide)
    ranges = [x.filter("kind = 0").select("row", F.col("at").alias("first"), (F.col("at") + F.col("more")).alias("last")) for x in out]
    whole = ranges[0]
    for x in ranges[1:]:
        whole = whole.unionByName(x)
    whole = materialise(whole, "ranges", free_shuffles=True)
    for x in [frequent, kept, *out]:
        drop_materialised(x)
    return whole


def covered(ranges: list[dict], window: int) -> list[tuple[int, int]]:
    """The maximal runs (begin, end) of units covered by the windows that start in the ranges."""
    out: list[list[int]] = []
    for x in sorted((x["first"], x["last"] + window) for x in ranges):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


def without_repeats(docs: DataFrame, kind: Kind, cut: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``cut(id, text, runs)`` gives a row of ``schema`` for each document, runs being what is covered."""
    rows = numbered(docs, id_col, text_col)
    ranges = repeated_windows(rows, kind)
    flags = ranges.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    mark = F.pmod(F.xxhash64("row"), F.lit(MARKS)).cast("int").alias("mark")
    marks = F.broadcast(ranges.select(mark).distinct())  # at most MARKS rows: only documents that may lose text are dealt out
    marked = rows.select("row", "id", "text", mark)
    whole = marked.join(marks, "mark", "left_anti").select("id", "text", F.lit(None).cast(flags.schema["ranges"].dataType).alias("ranges"))
    met = marked.join(marks, "mark", "left_semi").join(flags, "row", "left").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cut(i.as_py(), (t.as_py() or "").encode(), covered(r.as_py() or [], kind.window)) for i, t, r in zip(batch.column("id"), batch.column("text"), batch.column("ranges"), strict=True)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return whole.unionByName(met).mapInArrow(tidied(run), schema)

