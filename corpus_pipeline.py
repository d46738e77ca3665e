"""The corpus pipeline: from documents to packed training sequences.

``STAGES`` in order: the quality classifier drops what it rejects, exact dedup
keeps the row with the largest id of equal texts, SimHash near-dedup keeps one
document of each class, mixing repeats or leaves out documents by the target
weights of their sources, packing cuts what is left into sequences.

Every stage but the last returns the columns of ``documents``.  Null or empty
texts, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwright.llm import exact_dedup, mixing, packing, quality, simhash
from chunkwright.llm.common import materialise, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted_rows(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
