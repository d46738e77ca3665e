"""Exact dedup by a minimal perfect hash over historical distinct digests.

The rows with the upper half of the ids are the history: their distinct
SHA-256 digests go into shards, each with a minimal perfect hash whose slots
hold the full digest, the winner (largest id) and the number of copies.  The
other rows are the batch: their distinct digests are looked up in the shard
and compared with the slot byte by byte.  Members are repeats of the slot's
winner; nonmembers are grouped by themselves.  As every history id is larger
than every batch id, the slot's locator is the winner of the whole group.

Digests are counted by a map-side combine before they move, so a digest that a
third of the rows share costs one row per task, and a shard holds distinct
digests only.  The rows meet their group's verdict in a join on the digest,
which Spark may split where one digest is frequent.

Defined cases: null text is the empty text; a null id ranks below all ids;
an empty table gives no rows; of identical rows with the same id one is kept;
columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwright.llm.common import materialise, pick, renamed, shuffle_partitions, table, without
from chunkwright.llm.mph import PerfectHash, as_matrix

#: Distinct digests that one shard may hold on average (48 bytes each).
SHARD_KEYS = 200_000
_INDEX = "shard int, mph binary, digests binary, winners binary, copies binary"
_GROUPS = "digest binary, keep_id long, copies long, member boolean"


def digest_groups(rows: DataFrame) -> DataFrame:
    """digest, keep_id, copies of the distinct digests of (id, digest) rows."""
    return rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def _shard(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def _build(key: tuple, part: pa.Table) -> pa.Table:
    digests = as_matrix(part["digest"].to_pylist())
    mph = PerfectHash.build(digests)
    to = np.argsort(mph.index(digests))
    winners = part["keep_id"].fill_null(np.iinfo(np.int64).min).to_numpy()[to]
    copies = part["copies"].to_numpy()[to]
    row = {"shard": pa.array([key[0].as_py()], pa.int32())}
    for name, value in (("mph", mph.to_bytes()), ("digests", digests[to].tobytes()), ("winners", winners.tobytes()), ("copies", copies.tobytes())):
        row[name] = pa.array([value], pa.binary())
    return pa.table(row)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard of the distinct digests in ``history`` (digest, keep_id, copies)."""
    return history.select(_shard(shards), "digest", "keep_id", "copies").groupBy("shard").applyInArrow(_build, _INDEX)


def _lookup(key: tuple, batch: pa.Table, index: pa.Table) -> pa.Table:
    digests = batch["digest"].to_pylist()
    keep = batch["keep_id"].fill_null(np.iinfo(np.int64).min).to_numpy().copy()
    copies = batch["copies"].to_numpy().copy()
    member = np.zeros(len(digests), bool)
    out_digests, out_keep, out_copies, out_member = list(digests), keep, copies, member
    if index.num_rows:
        row = {name: index[name][0].as_py() for name in ("mph", "digests", "winners", "copies")}
        slots = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners, held = np.frombuffer(row["winners"], np.int64), np.frombuffer(row["copies"], np.int64)
        total = held.copy()
        if digests:
            own = as_matrix(digests)
            at = PerfectHash.from_bytes(row["mph"]).index(own)
            hit = np.flatnonzero(at >= 0)
            hit = hit[(slots[at[hit]] == own[hit]).all(axis=1)]
            member[hit] = True
            total[at[hit]] += copies[hit]
        stay = np.flatnonzero(~member)
        out_digests = [digests[i] for i in stay] + [bytes(x) for x in slots]
        out_keep = np.concatenate([keep[stay], winners])
        out_copies = np.concatenate([copies[stay], total])
        out_member = np.concatenate([np.zeros(len(stay), bool), np.ones(len(slots), bool)])
    null = out_keep == np.iinfo(np.int64).min
    return pa.table({"digest": pa.array(out_digests, pa.binary()), "keep_id": pa.array(out_keep, pa.int64(), mask=null), "copies": pa.array(out_copies, pa.int64()), "member": pa.array(out_member, pa.bool_())})


def lookup(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Groups of batch and history together: digest, keep_id, copies, and whether the index holds the digest."""
    by_shard = batch.select(_shard(shards), "digest", "keep_id", "copies").groupBy("shard")
    return by_shard.cogroup(index.groupBy("shard")).applyInArrow(_lookup, _GROUPS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys_per_shard: int = SHARD_KEYS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    rows = materialise(rows, "digests")
    low, high, n = rows.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    shards = max(4 * shuffle_partitions(spark), -(-n // keys_per_shard))
    middle = 0 if low is None else low + (high - low + 1) // 2
    recent = F.coalesce(F.col("id") >= F.lit(middle), F.lit(False))
    index = build_index(digest_groups(rows.filter(recent)), shards)
    groups = lookup(digest_groups(rows.filter(~recent)), index, shards)
    repeated = groups.filter("copies > 1").select("digest", "keep_id", "copies")
    joined = rows.join(repeated, "digest", "left")
    once = F.lit(True)
    if not rows.groupBy("digest", "id").count().filter("count > 1").isEmpty():  # identical rows: dealt by both columns, else a frequent digest would fill one task
        joined = joined.repartition("digest", "id")
        once = F.row_number().over(Window.partitionBy("digest", "id").orderBy(F.lit(1))) == 1
    keep = F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        (F.col("id").eqNullSafe(keep) & once).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of identical rows with the same id one stays."""
    verdict = materialise(exact_dedup(docs, id_col, text_col).filter("NOT kept"), "repeats")
    plain, own = renamed(docs)
    plain = plain.withColumns({"id": F.col(own[id_col]).cast("long"), "sha": F.sha2(F.coalesce(own[text_col], F.lit("")), 256)})
    if not verdict.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty():  # identical rows
        first = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.lit(1)))
        plain = plain.withColumn("n", first).filter("n = 1").drop("n")
    gone = verdict.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    return without(plain, gone, ["id", "sha"]).drop("id", "sha").toDF(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
