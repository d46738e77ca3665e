"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import drop_materialised, materialise

ROUNDS = 60


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's least neighbour (or the node itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the least of them; links lead from larger to smaller."""
    least = _least(edges)
    to = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return to.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, root of all nodes with a link (u, v); root: the least node reachable.

    Each round is written to the shared folder.  The minima are combined
    map-side, so a node with many links costs one row per task there; the
    joins back are plain equi-joins, which Spark may split.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialise(edges, "links"), None
    for _ in range(rounds):
        n, mark = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if (n, mark) == before:
            break
        before = (n, mark)
        following = materialise(_small(_large(edges)), "links")
        drop_materialised(edges)
        edges = following
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
