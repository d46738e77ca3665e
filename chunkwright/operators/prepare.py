"""Preparing datasets: coverage filter, downsampling, slices, dedupe, merging."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.functions.text import py_strip

ANSWER_KEYS = ("extractive_span_text_answer", "free_text_answer")
COVERAGE = 0.8


def has_answer(c: F.Column) -> F.Column:
    return F.coalesce(F.exists(c, lambda a: a.isNotNull() & (py_strip(a) != "")), F.lit(False))


def coverage_filtered(queries: DataFrame, keys: tuple = ANSWER_KEYS, least: float = COVERAGE) -> DataFrame:
    """Drop keys that too few queries fill; of the rest keep queries that fill all.

    The shares are one aggregate row, joined back by broadcast.
    """
    shares = queries.agg(*[F.avg(has_answer(F.col(k)).cast("double")).alias(f"__{k}") for k in keys])
    rows = queries.crossJoin(F.broadcast(shares))  # a single row
    for k in keys:
        enough = F.coalesce(F.col(f"__{k}") >= least, F.lit(False))
        rows = rows.filter(~enough | has_answer(F.col(k))).withColumn(k, F.when(enough, F.col(k)))
    return rows.drop(*[f"__{k}" for k in keys])


def first_documents(docs: DataFrame, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n documents, and the queries with a relevant one among them (their lists cut to these, repeats kept)."""
    kept = docs.orderBy("doc_ord").limit(n)
    return kept, restricted(queries, kept)


def restricted(queries: DataFrame, docs: DataFrame, max_queries: int | None = None) -> DataFrame:
    """Queries with at least one relevant document in ``docs``; relevance in its order."""
    at = queries.select("query_id", F.posexplode("relevant").alias("p", "doc_id")).join(docs.select("doc_id"), "doc_id", "left_semi")
    own = at.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "doc_id"))), lambda x: x["doc_id"]).alias("__relevant"))
    out = queries.join(own, "query_id").withColumn("relevant", F.col("__relevant")).drop("__relevant")
    return out if max_queries is None else out.orderBy("query_ord").limit(max_queries)


def passages_with_parent(passages: DataFrame, docs: DataFrame) -> DataFrame:
    return passages.join(docs.select(F.col("doc_id").alias("parent_id")), "parent_id", "left_semi")


def bottom_by_hash(docs: DataFrame, n: int, text: str = "text", seed: str = "42") -> DataFrame:
    """The n documents of least md5(seed:md5(text)), with their rank."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.md5(F.col(text))))
    top = docs.withColumn("hash_key", key).orderBy("hash_key", "doc_id").limit(n)
    return top.withColumn("hash_rank", F.row_number().over(Window.orderBy("hash_key", "doc_id")))  # n rows


def hash_slices(docs: DataFrame, sizes: dict[str, int], text: str = "text") -> DataFrame:
    """Contiguous slices of the documents in hash order, by name."""
    top = bottom_by_hash(docs, sum(sizes.values()), text)
    name, at = F.lit(None).cast("string"), 0
    bounds = []
    for k, n in sizes.items():
        bounds.append((k, at, at + n))
        at += n
    for k, a, b in bounds:
        name = F.when((F.col("hash_rank") > a) & (F.col("hash_rank") <= b), k).otherwise(name)
    return top.withColumn("slice", name)


def split_expression(expression: str) -> tuple[str, int | None, int | None]:
    """"train[10:20]" -> ("train", 10, 20); without brackets there are no bounds."""
    m = re.fullmatch(r"([^\[\]]*)(?:\[(-?\d*):(-?\d*)\])?", expression.strip())
    if not m:
        raise ValueError(f"bad split expression {expression!r}")
    return m[1], int(m[2]) if m[2] else None, int(m[3]) if m[3] else None


def sliced(df: DataFrame, expression: str, order: str) -> DataFrame:
    """Rows [a:b) of a numbered table; negative bounds count from the end."""
    _, a, b = split_expression(expression)
    if any(x is not None and x < 0 for x in (a, b)):
        n = df.count()
        a, b = (None if x is None else x if x >= 0 else max(0, n + x) for x in (a, b))
    out = df.filter(F.col(order) >= (a or 0))
    return out if b is None else out.filter(F.col(order) < b)


def seeded_sample(df: DataFrame, n: int, seed: int, id_col: str, order: str) -> DataFrame:
    """n rows by a hash of seed and id, in their own order again."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n).orderBy(order)


def distinct_documents(docs: DataFrame, prefix: str = "", length: int = 16, text: str = "text", order: str = "doc_id") -> DataFrame:
    """One row per text: digest id, first order, occurrences; map-side combined."""
    return docs.groupBy(F.col(text).alias("text")).agg(F.min(order).alias("first_ord"), F.count(F.lit(1)).alias("occurrences")).withColumn("content_id", F.concat(F.lit(prefix), F.substring(F.md5("text"), 1, length)))


def collision_free(docs: DataFrame, id_col: str = "content_id", order: str = "first_ord") -> DataFrame:
    """Ids that collide get -1, -2, ... from the second on."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    return docs.withColumn(id_col, F.when(n == 1, F.col(id_col)).otherwise(F.concat(F.col(id_col), F.lit("-"), (n - 1).cast("string"))))


def concatenated(df: DataFrame, key: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Texts of a key in order, blank ones left out."""
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col(text), F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))), lambda x: x["t"])
    return df.groupBy(key).agg(F.array_join(pieces, separator).alias("contents"), F.count(F.lit(1)).alias("pieces"))


def accumulated_contexts(df: DataFrame, key: str, order: str, context: str) -> DataFrame:
    """Contexts of a key joined in order, those already contained in what stands left out; where each one starts."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(context).alias("c"))))
    start = F.struct(F.lit("").alias("text"), F.array().cast(f"array<struct<o: {dict(df.dtypes)[order]}, start: int>>").alias("starts"))

    def step(s, x):
        held = F.contains(s["text"], x["c"])
        text = F.when(held, s["text"]).when(s["text"] == "", x["c"]).otherwise(F.concat(s["text"], F.lit("\n\n"), x["c"]))
        at = F.when(held, F.instr(s["text"], x["c"]) - 1).otherwise(F.length(text) - F.length(x["c"]))
        return F.struct(text.alias("text"), F.concat(s["starts"], F.array(F.struct(x["o"].alias("o"), at.cast("int").alias("start")))).alias("starts"))

    return df.groupBy(key).agg(F.aggregate(items, start, step).alias("s")).select(key, F.col("s.text").alias("contents"), F.col("s.starts").alias("starts"))


def super_document(docs: DataFrame, order: str = "doc_ord", text: str = "contents", merged_id: str = "merged") -> DataFrame:
    """One document of all texts in order.  A single row by definition: it must fit an executor."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return docs.agg(F.array_join(pieces, "\n\n").alias("contents"), F.count(F.lit(1)).alias("documents")).withColumn("doc_id", F.lit(merged_id))


def merged_queries(queries: DataFrame, docs: DataFrame, merged_id: str = "merged", answers: str = "answers") -> DataFrame:
    """Queries of a merged dataset: all point at the one document; without answers, the texts of their documents are."""
    none = F.size(F.coalesce(F.col(answers), F.array().cast("array<string>"))) == 0
    at = queries.filter(none).select("query_id", F.posexplode("relevant").alias("p", "doc_id")).join(docs.select("doc_id", F.col("contents").alias("__t")), "doc_id")
    own = at.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "__t"))), lambda x: x["__t"]).alias("__texts"))
    out = queries.join(own, "query_id", "left").withColumn(answers, F.when(none, F.coalesce("__texts", F.array().cast("array<string>"))).otherwise(F.col(answers)))
    return out.withColumn("relevant", F.array(F.lit(merged_id))).drop("__texts")
