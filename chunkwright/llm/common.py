"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may go without it; a temporary folder serves there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="chunkwright-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Whether Spark removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, free_shuffles: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    The table stands for its shuffles from then on; ``free_shuffles`` removes
    their files at once rather than when the driver's collector finds them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    if free_shuffles:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Remove the files behind a materialised table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles():
        parent = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if root.removeprefix("file:").lstrip("/") not in parent.toString():
            raise ValueError(f"{parent} is not in the shared folder")
        parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)
        return


#: Marks that ``without`` broadcasts: at most so many rows of one number.
MARKS = 1 << 20


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` less those whose keys occur in ``gone``; nulls are equal.

    The hashes of the gone keys, folded to ``MARKS`` values, are broadcast.
    Rows without a mark stay where they are; only the others, some of which
    are gone, are dealt out to meet the gone keys themselves.
    """
    rows, back = renamed(rows)
    keys_of, own = [F.col(f"`{k}`") for k in keys], [back[k] for k in keys]
    mark = F.pmod(F.xxhash64(*keys_of), F.lit(MARKS)).cast("int").alias("mark")
    marks = gone.select(mark).distinct()
    marked = rows.select("*", F.pmod(F.xxhash64(*own), F.lit(MARKS)).cast("int").alias("mark"))
    stay = marked.join(F.broadcast(marks), "mark", "left_anti")
    held = marked.join(F.broadcast(marks), "mark", "left_semi")
    there = gone.select(*[k.alias(f"gone{i}") for i, k in enumerate(keys_of)]).distinct()
    same = [held[k].eqNullSafe(there[f"gone{i}"]) for i, k in enumerate(own)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    left = stay.unionByName(held.join(there, condition, "left_anti")).drop("mark")
    return left.select(*back.values()).toDF(*back)


def only(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to ``wanted`` by ``keys`` (nulls are equal); its other columns follow.

    The folded hashes of the wanted keys are broadcast as in ``without``, so
    rows that nothing asks for are not dealt out.
    """
    mark = F.pmod(F.xxhash64(*keys), F.lit(MARKS)).cast("int").alias("__mark")
    met = rows.select("*", mark).join(F.broadcast(wanted.select(mark).distinct()), "__mark", "left_semi").drop("__mark")
    there = wanted.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & met[k].eqNullSafe(there[f"__{k}"])
    return met.hint("merge").join(there, condition).drop(*[f"__{k}" for k in keys])


def tidied(run):
    """``run`` over batches; what it frees goes back to the system at its end, as Python workers serve task after task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, renamed: clashing extra columns go."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ..., which no column of an operator is, and the new name of each.

    ``.toDF(*names)`` names them back, by place: so no name of the input can clash.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)
