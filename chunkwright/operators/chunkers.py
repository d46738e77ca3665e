"""Chunkers: documents to passages, one narrow transformation each.

``CHUNKERS`` maps a name to (defaults, function).  Functions take a DataFrame
with (doc_id, text) and parameters, and return doc_id, chunk_index, chunk_id,
text and what else the chunker knows (offsets, sentences).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chunkwright.functions import text as T
from chunkwright.functions.vectors import cosine
from chunkwright.operators import kernels

CHUNKERS: dict[str, tuple[dict, Callable[..., DataFrame]]] = {}
#: Chunks, and characters of chunks, that a worker holds before they leave.
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 20


def chunker(*names: str, **defaults):
    """Register a chunker under its names; a name can be taken once."""

    def register(f):
        for name in names:
            if name in CHUNKERS:
                raise ValueError(f"chunker {name!r} is already registered")
            CHUNKERS[name] = (defaults, f)
        return f

    return register


def get_chunker(name: str, **overrides) -> Callable[[DataFrame], DataFrame]:
    """The chunker with its defaults, overridden one by one."""
    if name not in CHUNKERS:
        raise KeyError(f"unknown chunker {name!r}; there are {', '.join(sorted(CHUNKERS))}")
    defaults, f = CHUNKERS[name]
    return lambda docs: f(docs, **(defaults | overrides))


def list_chunkers() -> list[str]:
    return sorted(CHUNKERS)


def _identified(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_index").cast("string")))


@chunker("fixed_size", chunk_size=512, overlap=50)
def fixed_size(docs: DataFrame, chunk_size: int, overlap: int) -> DataFrame:
    """Windows of characters; the last is the first that reaches the end."""
    if chunk_size <= 0 or overlap < 0 or overlap >= chunk_size:
        raise ValueError("chunk_size must be positive and overlap within [0, chunk_size)")
    n = F.length("text")
    at = docs.select("doc_id", "text", F.posexplode(T.windows(n, chunk_size, overlap)).alias("chunk_index", "start_char"))
    end = F.least(F.col("start_char") + chunk_size, n)
    return _identified(at.select("doc_id", "chunk_index", F.substring("text", F.col("start_char") + 1, F.lit(chunk_size)).alias("text"), "start_char", end.cast("int").alias("end_char")))


@chunker("passage_regexp", "passage", passage_length=10)
def passage_regexp(docs: DataFrame, passage_length: int) -> DataFrame:
    """Groups of sentences, split where white space follows . ! or ?"""
    if passage_length <= 0:
        raise ValueError("passage_length must be positive")
    groups = docs.select("doc_id", F.posexplode(T.sentence_groups(F.col("text"), passage_length)).alias("chunk_index", "g"))
    return _identified(groups.select("doc_id", "chunk_index", "g.text", "g.start_sentence", "g.end_sentence"))


def sequential_hac(sentences: DataFrame, distance_threshold: float = 0.3, keys: tuple = ("doc_id",), order: str = "sentence_index", embedding: str = "embedding", text: str | None = "text") -> DataFrame:
    """Chunks of embedded sentences: single linkage over neighbours only.

    On a chain the single-linkage tree is the chain itself, so a cut at the
    threshold parts exactly the neighbours at that cosine distance or more.
    """
    over = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(embedding).over(over)
    parts = F.when(before.isNull(), 0).when(1 - cosine(F.col(embedding), before) >= distance_threshold, 1).otherwise(0)
    marked = sentences.withColumn("__parts", parts).withColumn("chunk_index", F.sum("__parts").over(over.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    aggregates = [F.min(order).alias("first_sentence"), F.max(order).alias("last_sentence"), F.count(F.lit(1)).alias("sentences")]
    if text:
        pieces = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
        aggregates.append(F.array_join(pieces, " ").alias("text"))
    return marked.groupBy(*keys, "chunk_index").agg(*aggregates)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out for kernels that cost more than a shuffle; others stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def kernel_chunks(docs: DataFrame, split: Callable[[str], list[dict]], fields: str) -> DataFrame:
    """Apply a per-document kernel in Arrow batches; ``fields``: DDL of what it gives besides text.

    Chunks leave in small pieces, so that a worker holds one batch of documents and the chunks of a few.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, chunk_index int, text string" + (f", {fields}" if fields else "")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                own = d.as_py()
                for i, c in enumerate(split(t.as_py() or "")):
                    rows.append({"doc_id": own, "chunk_index": i, **c})
                    size += len(c["text"])
                    if len(rows) >= PIECE_ROWS or size >= PIECE_CHARS:
                        yield pa.RecordBatch.from_pylist(rows, schema=target)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    return _identified(docs.select("doc_id", "text").mapInArrow(run, schema))


@chunker("passage_spacy", passage_length=10, splitter=kernels.sentence_spans)
def passage_sentences(docs: DataFrame, passage_length: int, splitter) -> DataFrame:
    """Groups of sentences of an injected splitter, with the offsets of the first and last."""
    return kernel_chunks(docs, lambda t: kernels.group_spans(t, splitter(t), passage_length), "start_char int, end_char int, start_sentence int, end_sentence int")


@chunker("text_tiling", w=20, k=10, smoothing_width=2, smoothing_rounds=1, cutoff_policy="hc", stopwords=(), splitter=kernels.sentence_spans)
def text_tiling(docs: DataFrame, w: int, k: int, smoothing_width: int, smoothing_rounds: int, cutoff_policy: str, stopwords, splitter) -> DataFrame:
    p = kernels.Tiling(w, k, smoothing_width, smoothing_rounds, cutoff_policy, frozenset(stopwords), splitter)
    return kernel_chunks(docs, p.chunks, "segment_index int")


@chunker("max_min_chunker", c=0.9, hard_threshold=0.6, init_constant=1.5, embed=kernels.hashing_embedder, splitter=kernels.sentence_list)
def max_min(docs: DataFrame, c: float, hard_threshold: float, init_constant: float, embed, splitter) -> DataFrame:
    return kernel_chunks(docs, lambda t: kernels.max_min_chunks(splitter(t), embed, c, hard_threshold, init_constant), "")


@chunker("sequential_hac_chunker", distance_threshold=0.3, embed=kernels.hashing_embedder, splitter=kernels.sentence_list)
def sequential_hac_documents(docs: DataFrame, distance_threshold: float, embed, splitter) -> DataFrame:
    """The chain rule of ``sequential_hac`` per document, with an injected embedder; works on streams."""
    return kernel_chunks(docs, lambda t: kernels.chain_chunks(splitter(t), embed, distance_threshold), "")


@chunker(
    "recursive_semantic", max_chunk_size=15000, recursive_threshold=1500, delta=3, merge_threshold=350, final_threshold=2500, breakpoint_percentile=95,
    embed=kernels.hashing_embedder, splitter=kernels.sentence_list,
)
def recursive_semantic(docs: DataFrame, **p) -> DataFrame:
    return kernel_chunks(docs, kernels.Recursive(**p).chunks, "start_char int, end_char int")


@chunker("lumberchunker", group_size_threshold=350, ask=None, splitter=kernels.sentence_list)
def lumber(docs: DataFrame, group_size_threshold: int, ask, splitter) -> DataFrame:
    """Segments at content shifts that ``ask(prompt) -> str`` names."""
    if ask is None:
        raise ValueError("lumberchunker needs ask: a function of a prompt that returns the model's answer")
    return kernel_chunks(docs, lambda t: kernels.lumber_chunks(splitter(t), ask, group_size_threshold), "")


CHUNKERS["lumberchunker_api"] = CHUNKERS["lumber_chunker_api"] = CHUNKERS["lumberchunker"]


@chunker("dense_x_retrieval", propose=None, max_context_tokens=6000, max_new_tokens=3000, overlap_ratio=0.05, prompt_tokens=0)
def dense_x(docs: DataFrame, propose, max_context_tokens: int, max_new_tokens: int, overlap_ratio: float, prompt_tokens: int) -> DataFrame:
    """Propositions that ``propose(text) -> str`` writes, by windows of words."""
    if propose is None:
        raise ValueError("dense_x_retrieval needs propose: a function of a text that returns the model's output")
    budget = max_context_tokens - max_new_tokens - prompt_tokens
    return kernel_chunks(docs, lambda t: kernels.propositions(t, propose, budget, overlap_ratio), "window_segment_index int, total_window_segments int")


@chunker("graphseg", relatedness_threshold=0.25, min_segment_size=3, embed=kernels.hashing_embedder, splitter=kernels.sentence_spans)
def graph_segments(docs: DataFrame, relatedness_threshold: float, min_segment_size: int, embed, splitter) -> DataFrame:
    return kernel_chunks(docs, lambda t: kernels.graph_chunks(t, splitter(t), embed, relatedness_threshold, min_segment_size), "start_char int, end_char int, start_sentence int, end_sentence int")
