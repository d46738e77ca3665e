"""Chunking of document streams (an extension: batch semantics, applied as documents arrive)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.operators.chunkers import get_chunker


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, arrived timestamp", files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunk_stream(docs: DataFrame, chunker: str, **params) -> DataFrame:
    """Passages of a stream; chunkers are narrow, so no state is kept."""
    return get_chunker(chunker, **params)(docs)


def distinct_arrivals(docs: DataFrame, time: str = "arrived", late: str = "1 hour", key: str = "doc_id") -> DataFrame:
    """Documents once each, as long as copies arrive within the watermark."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def arrivals_per_window(docs: DataFrame, time: str = "arrived", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return docs.withWatermark(time, late).groupBy(F.window(time, size)).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"))
