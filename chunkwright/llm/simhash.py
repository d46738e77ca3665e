"""SimHash near-duplicate classes with a pigeonring filter.

Fingerprints (64 bits, over word shingles hashed by XXH64) are made distinct
first, so exact copies never meet each other.  The 64 bits are cut into
``distance + 1`` segments on a ring.  If two fingerprints differ in at most
``distance`` bits, some segment starts a chain whose cumulative differences
stay within the proportional budget at every length: the first segment is
equal, the first two differ in at most one bit, and so on.  Fingerprints are
therefore grouped by (segment number, value); inside a group the chain is
checked length by length, most pairs falling out at the second segment, and
the last length is the full Hamming check.

Wide fingerprints have 128 bits, with a second budget for all of them.

The corpus stage wants texts whose sets of shingles have a Jaccard similarity
of ``SIMILAR`` or more, which may differ in a fourth of the 128 bits.  Segments
short enough for that would gather a fixed share of all pairs, so there a key
comes before the ring: fingerprints meet if they share the least of their
shingles in one of ``MINS`` orders (at a similarity of 0.8 all but one in 15,000 pairs do), and how many meet follows from the copies, not from the
size of the corpus.  Those that share one least shingle are filtered by the
rings of either half and the full check on all bits.  The links are candidates
only: inside their components the distinct texts are compared by their sets of
shingles, and only a similarity of ``SIMILAR`` or more joins two of them.  The
fingerprints of a least shingle that over ``BLOCK`` share (a passage in many
texts) are cut into blocks, and every two of them meet there too, by the full
check at once: segments of three or four bits leave each pair to be looked at
more than once, which is dear where pairs are many.

A group of over ``BLOCK`` fingerprints is cut into blocks by a hash, and every
two blocks meet in a cell of their own, so no cell holds more than two blocks
and no link is lost.  A cell emits a spanning star of each of its components,
not its pairs.  Components are joined up by ``components``.

Defined cases: null text is the empty text; fewer words than a shingle: the
whole sequence is the one shingle; no words: fingerprint 0, linked like any
other; a null id ranks above all others as a representative; identical rows
are in one class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwright.llm.common import drop_materialised, materialise, only, pick, renamed, shuffle_partitions, table, tidied, without
from chunkwright.llm.components import components
from chunkwright.llm.runs import whole_runs

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Fingerprints of one key that meet in one cell: at most two blocks.
BLOCK = 4096
#: For the corpus stage: five words, bits that may differ of all 128 (so of one half at most half of these), orders of
#: shingles.  These budgets only find candidates (README: recall); the shingle sets decide.
STAGE_SHINGLE, STAGE_TOTAL, MINS = 5, 32, 6
#: Least Jaccard similarity of near copies, as a fraction, and the texts of one block that are compared.
SIMILAR, TEXTS, TEXT_BYTES = (4, 5), 1024, 16 << 20


def shingles(text: bytes, n: int) -> list[bytes]:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-n]]).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]


def _hashes(found: list[bytes], wide: bool) -> np.ndarray:
    """A row of bytes, lowest first, for each shingle."""
    if wide:
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), np.uint8).reshape(-1, 16)
    return np.frombuffer(b"".join([xxhash.xxh64_digest(x, SEED) for x in found]), np.uint8).reshape(-1, 8)[:, ::-1]


def _minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least shingle of each text in each of ``MINS`` orders, from 128-bit hashes laid end to end."""
    low, high = hashes.view("<u8").T
    return np.stack([np.minimum.reduceat(low + np.uint64(j) * high, starts) for j in range(MINS)], axis=1)


def fingerprints(texts: list[bytes], n: int, wide: bool = False, mins: bool = False) -> np.ndarray:
    """Unsigned fingerprints (a column of 64 bits, or two), a bit set where over half the shingles' hashes set it; then the minima if asked for."""
    columns = 2 if wide else 1
    out = np.zeros((len(texts), columns + MINS * mins), np.uint64)
    hashes: list[np.ndarray] = []
    at: list[int] = []
    held = 0

    def flush():
        if at:
            whole = np.concatenate(hashes)
            bits = np.unpackbits(whole, axis=1, bitorder="little")
            total = np.array([len(x) for x in hashes])
            counts = np.add.reduceat(bits, np.cumsum(total) - total, axis=0, dtype=np.int64)
            out[at, :columns] = np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8")
            if mins:
                out[at, columns:] = _minima(whole, np.cumsum(total) - total)
            hashes.clear()
            at.clear()

    for i, text in enumerate(texts):
        found = shingles(text, n)
        if len(found) > 400_000:  # a very long text: counted in parts
            counts, least = 0, []
            for k in range(0, len(found), 400_000):
                part = _hashes(found[k : k + 400_000], wide)
                counts = counts + np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                if mins:
                    least.append(_minima(part, np.zeros(1, np.int64)))
            out[i, :columns] = np.packbits(2 * counts > len(found), bitorder="little").view("<u8")
            if mins:
                out[i, columns:] = np.concatenate(least).min(axis=0)
        elif found:
            at.append(i)
            hashes.append(_hashes(found, wide))
            held += len(found)
            if held > 100_000:
                flush()
                held = 0
    flush()
    return out


def _fingerprint(n: int, wide: bool, mins: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fp = fingerprints([x or b"" for x in texts], n, wide, mins).view(np.int64)
            keys = [c for c in batch.schema.names if c != "text"]
            more = fp[:, 1] if wide else np.zeros(len(fp), np.int64)
            least = [pa.array(fp[:, 2:].tolist(), pa.list_(pa.int64()))] if mins else []
            yield pa.record_batch([*[batch.column(c) for c in keys], pa.array(fp[:, 0]), pa.array(more), *least], names=[*keys, "fp", "more", *["mins"] * mins])

    return run


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, wide: bool = False, stage: bool = False) -> DataFrame:
    """id, fp and more (the first and, if wide, the second 64 bits as signed longs) of every row; for the stage also the text's digest and the minima."""
    rows = pick(docs, id=id_col, text=text_col)
    sha = [text_digest(F.col("text")).alias("sha")] if stage else []
    rows = rows.select(rows["id"].cast("long").alias("id"), *sha, "text")
    return rows.mapInArrow(tidied(_fingerprint(shingle, wide or stage, stage)), f"id long, {'sha binary, ' if stage else ''}fp long, more long{', mins array<long>' if stage else ''}")


def text_digest(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments of 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


#: Links held before they are folded into components.
PENDING = 100_000


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (the least position of each component so far) after the links a-b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]


def ring_roots(fp: np.ndarray, more: np.ndarray, group: np.ndarray, first: np.ndarray, distance: int, total: int) -> np.ndarray:
    """The least position in the component of each position, by links inside runs of equal ``group``.

    ``first``: the segment that a run agrees in.  Pairs already in one component
    are not looked at again, and links are folded in as they come, so a group of
    copies costs memory for its members, not for its pairs.
    """
    parts = segments(distance + 1)
    masks = np.array([((1 << w) - 1) << s for s, w in parts], np.uint64)
    m = len(parts)
    ring = np.zeros((m, m + 1), np.uint64)  # masks of chains by start and length
    for i in range(m):
        for length in range(1, m + 1):
            ring[i, length] = ring[i, length - 1] | masks[(i + length - 1) % m]
    budgets = [length * distance // m for length in range(m + 1)]
    n = len(fp)
    ends = np.searchsorted(group, group, side="right")
    root, held, count = np.arange(n), [], 0
    step, live = 1, np.flatnonzero(np.arange(n) + 1 < ends)
    while len(live):
        at = live[root[live] != root[live + step]]
        x, start = fp[at] ^ fp[at + step], first[at]
        for length in range(2, m + 1):
            ok = np.bitwise_count(x & ring[start, length]) <= budgets[length]
            x, at, start = x[ok], at[ok], start[ok]
            if not len(at):
                break
        if total < 128 and len(at):
            at = at[np.bitwise_count(x).astype(np.int64) + np.bitwise_count(more[at] ^ more[at + step]) <= total]
        if len(at):
            held.append((at, at + step))
            count += len(at)
        if count > PENDING:
            root = joined(root, *(np.concatenate(c) for c in zip(*held, strict=True)))
            held, count = [], 0
        step += 1
        live = live[live + step < ends[live]]
    return joined(root, *(np.concatenate(c) for c in zip(*held, strict=True))) if held else root


def _cells(distance: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, ["segment", "value", "cell"], 20_000):
            fp, more, node = part["fp"].to_numpy().view(np.uint64), part["more"].to_numpy().view(np.uint64), part["node"].to_numpy()
            seg = part["segment"].to_numpy()
            key = np.stack([seg.astype(np.int64), part["value"].to_numpy(), part["cell"].to_numpy()])
            group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
            root = ring_roots(fp, more, group, seg.astype(np.int64), distance, total)
            at = np.flatnonzero(root != np.arange(len(fp)))
            if len(at):
                yield pa.record_batch([pa.array(node[at]), pa.array(node[root[at]])], names=["u", "v"])

    return run


def _cells_of(key: str) -> F.Column:
    """The cells in which the block of ``key`` meets the other ``blocks``."""
    own = F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(own, other).cast("long") * F.col("blocks") + F.greatest(own, other))
    #: a block meets itself in the cell with the next, so only a lone block has a cell (0, 0)
    return F.filter(cells, lambda c: (F.col("blocks") == 1) | (c % F.col("blocks") != F.floor(c / F.col("blocks"))))


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK, total: int = 128) -> DataFrame:
    """u, v: links that join all fingerprints (node, fp, more) within the budgets into their components."""
    parts = segments(distance + 1)
    spans = F.array(*[F.struct(F.lit(i).alias("segment"), F.expr(f"shiftrightunsigned(fp, {s}) & {(1 << w) - 1}L").alias("value")) for i, (s, w) in enumerate(parts)])
    keyed = distinct.select("node", "fp", "more", F.inline(spans))
    large = keyed.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("segment", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    sized = keyed.join(large, ["segment", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = sized.select("node", "fp", "more", "segment", "value", F.explode(_cells_of("node")).alias("cell"))
    n = 2 * shuffle_partitions(distinct.sparkSession)
    placed = cut.repartition(n, "segment", "value", "cell").sortWithinPartitions("segment", "value", "cell", "fp")
    return placed.mapInArrow(tidied(_cells(distance, total)), "u long, v long")


def crowd_roots(fp: np.ndarray, more: np.ndarray, own: np.ndarray, total: int) -> np.ndarray:
    """The least position in the component of each position, by links between two blocks (or inside the only one), sorted by ``own``.

    All pairs are checked in full; links are folded in as they come.
    """
    n = len(fp)
    cut = int(np.searchsorted(own, own[0], side="right"))
    root, held, count = np.arange(n), [], 0
    for i in range(cut):
        start = i + 1 if cut == n else cut
        apart = np.bitwise_count(fp[start:] ^ fp[i]) + np.bitwise_count(more[start:] ^ more[i])
        at = start + np.flatnonzero(apart <= total)
        at = at[root[at] != root[i]]
        if len(at):
            at = at[np.unique(root[at], return_index=True)[1]]  # one of each component
            held.append((np.full(len(at), i), at))
            count += len(at)
        if count > PENDING:
            root = joined(root, *(np.concatenate(c) for c in zip(*held, strict=True)))
            held, count = [], 0
    return joined(root, *(np.concatenate(c) for c in zip(*held, strict=True))) if held else root


def _gathered(total: int):
    distance = total // 2
    parts = segments(distance + 1)
    wide = np.int64(1) << np.int64(max(w for _, w in parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, ["key", "cell"], 20_000):
            key = np.stack([part["key"].to_numpy(), part["cell"].to_numpy()])
            group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
            several = np.bincount(group)[group] > 1
            if not several.any():
                continue
            group, node, own = group[several], part["node"].to_numpy()[several], part["own"].to_numpy()[several]
            halves = [part[c].to_numpy()[several].view(np.uint64) for c in ("fp", "more")]
            root = np.arange(len(node))
            crowd = np.flatnonzero(own >= 0)
            for at in np.split(crowd, np.flatnonzero(np.diff(group[crowd])) + 1) if len(crowd) else []:
                root[at] = at[crowd_roots(*(x[at] for x in halves), own[at], total)]
            rest = np.flatnonzero(own < 0)
            for fp, more in (halves, halves[::-1]) if len(rest) else ():
                code = np.stack([(group[rest] * len(parts) + i) * wide + (fp[rest] >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for i, (s, w) in enumerate(parts)], axis=1)
                order = np.argsort(code, axis=None, kind="stable")  # runs of one group, segment and value
                at, first, code = rest[order // len(parts)], order % len(parts), code.ravel()[order]
                top = ring_roots(fp[at], more[at], code, first, distance, total)
                linked = np.flatnonzero(top != np.arange(len(top)))
                root = joined(root, at[linked], at[top[linked]])
            linked = np.flatnonzero(root != np.arange(len(root)))
            if len(linked):
                yield pa.record_batch([pa.array(node[linked]), pa.array(node[root[linked]])], names=["u", "v"])

    return run


def gathered_links(distinct: DataFrame, total: int = STAGE_TOTAL, block: int = BLOCK) -> DataFrame:
    """u, v: links that join all fingerprints (node, fp, more, mins) that share a least shingle and differ in at most ``total`` of 128 bits into their components.

    The fingerprints of a key that over ``block`` share are cut into blocks;
    every block has a cell of its own (``own`` holds the block, elsewhere -1)
    and one with each other block, where only pairs across are checked.
    """
    n = 2 * shuffle_partitions(distinct.sparkSession)
    keyed = distinct.select("node", "fp", "more", F.posexplode("mins").alias("order", "least")).withColumn("key", F.xxhash64("order", "least"))
    sizes = keyed.groupBy("key").count().filter(F.col("count") > block)
    large = materialise(sizes.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large")
    columns = ["node", "fp", "more", "key"]
    if large.isEmpty():
        placed = keyed.select(*columns, F.lit(-1).alias("own"), F.lit(0).cast("long").alias("cell"))
    else:
        sized = keyed.join(large, "key", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(-1)))
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least("own", other).cast("long") * F.col("blocks") + F.greatest("own", other))
        placed = sized.select(*columns, "own", F.explode(F.coalesce(cells, F.array(F.lit(0).cast("long")))).alias("cell"))
    return placed.repartition(n, "key", "cell").sortWithinPartitions("key", "cell", "own").mapInArrow(tidied(_gathered(total)), "u long, v long")


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links a-b that join all sets with a Jaccard similarity of ``SIMILAR`` or more into their components.

    From each set reached, only those that no link has reached are compared.
    """
    size = np.array([len(x) for x in sets], np.int64)
    empty = np.flatnonzero(size == 0)
    links = [(int(empty[0]), int(x)) for x in empty[1:]]
    rest = np.flatnonzero(size)
    if len(rest) < 2:
        return links
    vocabulary, codes = np.unique(np.concatenate([sets[i] for i in rest]), return_inverse=True)
    ends = np.cumsum(size)
    held = np.zeros(len(vocabulary), np.int32)
    least, whole = SIMILAR
    queue: list[int] = []
    kept = codes  # codes of the sets in rest, one after the other
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            kept, rest = kept[size[rest[0]] :], rest[1:]
            continue
        a = queue.pop()
        held[codes[ends[a] - size[a] : ends[a]]] = 1
        shared = np.add.reduceat(held[kept], np.cumsum(size[rest]) - size[rest])
        held[codes[ends[a] - size[a] : ends[a]]] = 0
        hit = whole * shared >= least * (size[a] + size[rest] - shared)
        if hit.any():
            links += [(a, int(b)) for b in rest[hit]]
            queue += rest[hit].tolist()
            kept, rest = kept[np.repeat(~hit, size[rest])], rest[~hit]
    return links


def _similar(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, ["root", "cell"], 2_000):
            root, cell, key = part["root"].to_numpy(), part["cell"].to_numpy(), part["key"].to_numpy()
            edges = [0, *(np.flatnonzero((root[1:] != root[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), len(root)]
            for a, b in zip(edges, edges[1:], strict=False):
                hashes = (b"".join(map(xxhash.xxh64_digest, shingles(x.as_py(), shingle))) for x in part["text"][a:b])
                links = np.array(similar_links([np.unique(np.frombuffer(x, np.uint64)) for x in hashes]), np.int64).reshape(-1, 2)
                if len(links):
                    yield pa.record_batch([pa.array(key[a + links[:, 0]]), pa.array(key[a + links[:, 1]])], names=["u", "v"])

    return run


def text_links(texts: DataFrame, shingle: int, block: int = TEXTS) -> DataFrame:
    """u, v: links that join the texts (root, key, text), distinct by key, that are near copies of others of one root."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.length("text")) / TEXT_BYTES)).cast("int")
    large = texts.groupBy("root").agg(blocks.alias("blocks")).filter("blocks > 1")
    sized = texts.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = sized.select("root", "key", "text", F.explode(_cells_of("key")).alias("cell"))
    placed = cut.repartition(2 * shuffle_partitions(texts.sparkSession), "root", "cell").sortWithinPartitions("root", "cell")
    return placed.mapInArrow(tidied(_similar(shingle)), "u long, v long")


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK, total: int | None = None
) -> DataFrame:
    """id, fp, component_id (the smallest id reachable) of every row; with ``total`` by wide fingerprints."""
    wide = total is not None
    node = F.xxhash64("fp", "more") if wide else F.col("fp")
    rows = materialise(fingerprint_table(docs, id_col, text_col, shingle, wide).withColumn("node", node), "fingerprints")
    distinct = materialise(rows.groupBy("node", "fp", "more").agg(F.min("id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct, distance, block, total if wide else 128)).withColumnRenamed("node", "member")
    rooted = distinct.join(roots, distinct["node"] == roots["member"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # read again, so that Spark may split a large class in the join
    of_node = rooted.join(least, "root").select("node", "component_id")
    return rows.join(of_node, "node").select("id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE, total: int = STAGE_TOTAL, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each class one row, that with the smallest id.

    Rows are told apart by id and text digest, as ids may be null or repeat: a
    null id ranks last, of equal ids the smaller digest is first, and of rows
    with the same id and text one stays.
    """
    hashed = fingerprint_table(docs, id_col, text_col, shingle, stage=True)
    rows = materialise(hashed.withColumns({"node": F.xxhash64("fp", "more"), "key": F.xxhash64("sha")}), "fingerprints")
    distinct = materialise(rows.groupBy("node", "fp", "more", "mins").agg(F.lit(1).alias("one")).drop("one"), "distinct")
    found = components(gathered_links(distinct, total, block))
    candidates = found.withColumnRenamed("node", "member")
    best = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "sha")).alias("best")
    texts = rows.groupBy("key", "sha", "node").agg(best, F.count(F.lit(1)).alias("n"))
    texts = materialise(texts.join(candidates, texts["node"] == candidates["member"], "left").select("key", "sha", "best", "n", F.coalesce("root", "node").alias("root")), "texts")
    several = texts.groupBy("root").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("root")
    met = materialise(texts.join(several, "root").select("root", "key", "sha", F.col("best.id").alias("id")), "candidates")
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")
    bodies = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_digest(F.col(f"`{text_col}`")).alias("sha"), body)
    bodies = materialise(only(bodies, met, ["id", "sha"]).select("root", "key", "text"), "bodies")
    near = components(text_links(bodies, shingle))
    roots = near.withColumnsRenamed({"node": "member", "root": "top"})
    rooted = materialise(texts.join(roots, texts["key"] == roots["member"], "left").select("key", "best", "n", F.coalesce("top", "key").alias("root")), "rooted")
    first = materialise(rooted.groupBy("root").agg(F.min("best").alias("best"), F.sum("n").alias("n")).filter("n > 1").drop("n"), "first")
    of_key = rooted.select("key", "root").join(first, "root").select("key", "best")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("sha") == F.col("best.sha"))
    classes = materialise(rows.join(of_key, "key").select("id", "sha", stays.alias("stays")), "classes")
    for done in (rows, distinct, found, texts, met, bodies, near, rooted, first):
        drop_materialised(done)
    plain, own = renamed(docs)
    plain = plain.withColumns({"id": F.col(own[id_col]).cast("long"), "sha": text_digest(F.col(own[text_col]))})
    if not classes.filter("stays").groupBy("id", "sha").count().filter("count > 1").isEmpty():  # identical rows
        plain = plain.withColumn("n", F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.lit(1)))).filter("n = 1").drop("n")
    return without(plain, classes.filter("NOT stays").select("id", "sha"), ["id", "sha"]).drop("id", "sha").toDF(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
