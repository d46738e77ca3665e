"""Exact top-k inner products by tiled matrix products.

Vectors are quantised to floor(256 * x).  Queries and candidates are dealt to
the cells of a grid: queries to blocks of about ``BLOCK_BYTES``, candidates to
shards of about ``SHARD_BYTES``, and every block meets every shard in one cell,
both numbers being counted first.  A cell holds its block of queries and reads
its candidates tile by tile, keeping k scores a query (partial selection).  The
lists of the shards are merged per query in a tree with at most ``FAN_IN``
lists a node, as many levels as the shards need.  Nothing passes the driver.

Defined cases: null vectors and vectors with a null or non-finite component
take no part; a vector meets those of its own length only; the rows with a
query's own id are not its candidates; a repeated query id is asked once (its
smallest vector); equal scores go to the smaller id; fewer candidates than k
give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.llm.common import pick, shuffle_partitions, table, tidied

#: Bytes of query vectors in a cell, of candidates in a cell, rows per tile, lists that one merge takes.
BLOCK_BYTES, SHARD_BYTES, TILE, FAN_IN = 16_000_000, 64_000_000, 4096, 32
_PARTIAL = "query_id long, shard int, top array<struct<score: long, vec_id: long>>"


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.transform(F.col("vec"), lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    ok = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return pick(vectors, id=id_col, vec=vec_col).filter(ok & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), v.alias("v"))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; floats only where every sum stays below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # beyond a long: its nearest end
    return np.clip(a.astype(object) @ b.astype(object).T, low, high).astype(np.int64)


def select_top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at].astype(np.float64)))] if np.abs(scores[at]).max(initial=0) < 2**53 else at[np.array(sorted(range(len(at)), key=lambda i: (-int(scores[at[i]]), int(ids[at[i]]))), int)]


def _by_length(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    ids, lists = batch.column("id").to_numpy(), batch.column("v")
    starts = lists.offsets.to_numpy()
    flat, lengths = lists.values.to_numpy(zero_copy_only=False), np.diff(starts)
    return {int(d): (ids[at], flat[(starts[at][:, None] + np.arange(d))]) for d in np.unique(lengths) for at in [np.flatnonzero(lengths == d)]}


class _Best:
    """The k best candidates so far of each query of a cell."""

    def __init__(self, k: int):
        self.k = k
        self.queries: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, tile_ids: np.ndarray, tile: np.ndarray) -> None:
        for q_ids, q in self.queries.get(tile.shape[1], ()):
            for first in range(0, len(q_ids), 1024):
                some = q_ids[first : first + 1024]
                scores = _products(q[first : first + 1024], tile)
                own = some[:, None] == tile_ids[None, :]
                for i, q_id in enumerate(some.tolist()):
                    s, c = scores[i], tile_ids
                    if own[i].any():
                        s, c = s[~own[i]], c[~own[i]]
                    if q_id in self.lists:
                        held = self.lists[q_id]
                        if len(held[0]) == self.k:
                            better = s >= held[0][-1]
                            s, c = s[better], c[better]
                        if not len(s):
                            continue
                        s, c = np.concatenate([held[0], s]), np.concatenate([held[1], c])
                    top = select_top(s, c, self.k)
                    self.lists[q_id] = (s[top], c[top])

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        found = [(q, shard, [{"score": int(s), "vec_id": int(c)} for s, c in zip(*lists, strict=True)]) for q, lists in self.lists.items() if len(lists[0])]
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])))
        for at in range(0, len(found), 2000):
            cols = list(zip(*found[at : at + 2000], strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query_id", "shard", "top"])


def _scan(k: int):
    """Rows come in order of (block, shard, kind): of a cell first its queries, then its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best = None, _Best(k)
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "shard", "kind")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                block, shard, kind = keys[:, a].tolist()
                if (block, shard) != cell:
                    if cell:
                        yield from best.rows(cell[1])
                    cell, best = (block, shard), _Best(k)
                for d, (ids, matrix) in _by_length(batch.slice(a, b - a)).items():
                    if kind == 0:
                        best.queries[d].append((ids, matrix))
                    elif d in best.queries:
                        for at in range(0, len(ids), TILE):
                            best.add(ids[at : at + TILE], matrix[at : at + TILE])
        if cell:
            yield from best.rows(cell[1])

    return run


def _merge(lists: DataFrame, keys: list, k: int) -> DataFrame:
    """The k best of all lists of a key."""
    ordered = F.array_sort(F.transform(F.flatten(F.collect_list("top")), lambda x: F.struct((F.lit(0) - x["score"]).alias("less"), x["vec_id"].alias("vec_id"), x["score"].alias("score"))))
    top = F.transform(F.slice(ordered, 1, k), lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id")))
    return lists.groupBy(*keys).agg(top.alias("top"))


def _parts(rows: DataFrame, size: int) -> int:
    """How many parts of about ``size`` bytes the vectors of (id, v) fill."""
    return 1 + (rows.agg(F.coalesce(F.sum(8 * F.size("v") + 16), F.lit(0))).first()[0] - 1) // size


def exact_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, fan_in: int = FAN_IN
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates."""
    candidates = quantised(vectors, id_col, vec_col)
    asked = quantised(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    n = shuffle_partitions(vectors.sparkSession)
    blocks = max(1, _parts(asked, block_bytes))
    shards = max(_parts(candidates, shard_bytes), -(-n // blocks))  # as many cells as there are tasks
    dealt = lambda by, parts: F.pmod(F.xxhash64(F.lit("cell"), by), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    cells = asked.select(dealt("id", blocks).alias("block"), every(shards).alias("shard"), F.lit(0).alias("kind"), "id", "v")
    cells = cells.unionByName(candidates.select(every(blocks).alias("block"), dealt("id", shards).alias("shard"), F.lit(1).alias("kind"), "id", "v"))
    placed = cells.repartition(max(n, blocks * shards), "block", "shard").sortWithinPartitions("block", "shard", "kind")
    lists = placed.mapInArrow(tidied(_scan(k)), _PARTIAL)
    while shards > 1:  # a level of the tree
        shards = -(-shards // fan_in)
        lists = _merge(lists, ["query_id", F.floor(F.col("shard") / fan_in).cast("int").alias("shard")], k)
    return lists.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.filter("vec_id % 50 = 0"), 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
