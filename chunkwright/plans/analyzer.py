"""The analyzer's requests as functions that return DataFrames.

Tables carry exp (an experiment: a dataset run with a chunker):
experiments (exp, dataset, chunker, chunk_count), queries (exp, query_id,
contents, relevant), retrieved (exp, query_id, retrieved, retrieved_scores,
retrieved_relevant), passages (exp, passage_id, parent_id, contents),
documents (dataset, doc_id, contents), results (exp, metrics columns).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.operators.analytics import bucket, pair_status

PREVIEW = 3000


def datasets(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy("dataset").agg(F.count(F.lit(1)).alias("experiments"), F.array_sort(F.collect_set("chunker")).alias("chunkers"))


def dataset_metrics(experiments: DataFrame, results: DataFrame, dataset: str) -> DataFrame:
    return experiments.filter(F.col("dataset") == dataset).join(results, "exp", "left")


def relevant_percent(relevant: Column, chunk_count: Column) -> Column:
    return F.when(chunk_count > 0, F.round(100 * F.size(relevant) / chunk_count, 4))


def dataset_queries(experiments: DataFrame, queries: DataFrame, retrieved: DataFrame, dataset: str) -> DataFrame:
    """Each query once, with what each experiment made of it; an experiment's own record wins over its query file."""
    exps = experiments.filter(F.col("dataset") == dataset)
    a = retrieved.select("exp", "query_id", F.lit(None).cast("string").alias("contents"), F.lit(None).cast("array<string>").alias("relevant"), F.col("retrieved_relevant").alias("hit_ids"), F.lit(0).alias("rank"))
    b = queries.select("exp", "query_id", "contents", "relevant", F.array().cast("array<string>").alias("hit_ids"), F.lit(1).alias("rank"))
    own = a.unionByName(b).join(exps, "exp").groupBy("query_id", "exp", "chunk_count").agg(F.max("contents").alias("contents"), F.max_by("relevant", F.col("relevant").isNotNull()).alias("relevant"), F.min_by("hit_ids", "rank").alias("hit_ids"))
    record = F.struct(F.col("relevant"), (F.size("hit_ids") > 0).alias("hit"), relevant_percent(F.col("relevant"), F.col("chunk_count")).alias("relevant_pct"))
    return own.groupBy("query_id").agg(F.max("contents").alias("contents"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("exp", record.alias("r"))))).alias("per_exp"), bucket(F.count_if(F.size("hit_ids") > 0), F.count(F.lit(1))).alias("bucket"))


def query_detail(retrieved: DataFrame, passages: DataFrame, exp: str, query_id: str) -> DataFrame:
    """Retrieved passages of a query in their order, empty text where the passage is gone."""
    rows = retrieved.filter((F.col("exp") == exp) & (F.col("query_id") == query_id)).select("exp", "retrieved_relevant", F.posexplode(F.arrays_zip("retrieved", "retrieved_scores")).alias("p", "x"))
    rows = rows.select("exp", (F.col("p") + 1).alias("rank"), F.col("x.retrieved").alias("passage_id"), F.col("x.retrieved_scores").alias("score"), F.array_contains("retrieved_relevant", F.col("x.retrieved")).alias("is_relevant"))
    return rows.join(passages, ["exp", "passage_id"], "left").withColumn("contents", F.coalesce("contents", F.lit(""))).orderBy("rank")


def chunk(passages: DataFrame, experiments: DataFrame, documents: DataFrame, exp: str, passage_id: str) -> DataFrame:
    """A passage with a preview of its document and where it lies there."""
    one = passages.filter((F.col("exp") == exp) & (F.col("passage_id") == passage_id)).join(experiments, "exp")
    docs = documents.select("dataset", F.col("doc_id").alias("parent_id"), F.col("contents").alias("document"))
    return one.join(docs, ["dataset", "parent_id"], "left").select("exp", "passage_id", "contents", "parent_id", F.substring("document", 1, PREVIEW).alias("document_preview"), (F.length("document") > PREVIEW).alias("document_truncated"), (F.instr("document", F.col("contents")) - 1).alias("position"))


def full_document(passages: DataFrame, experiments: DataFrame, documents: DataFrame, exp: str, passage_id: str) -> DataFrame:
    one = passages.filter((F.col("exp") == exp) & (F.col("passage_id") == passage_id)).join(experiments, "exp").select("dataset", F.col("parent_id").alias("doc_id"))
    return document_rows(documents.join(one, ["dataset", "doc_id"], "left_semi"))


def document_rows(documents: DataFrame) -> DataFrame:
    n = F.size(F.filter(F.split("contents", r"\s+"), lambda x: x != ""))
    return documents.withColumn("words", n)


def relevant_queries(queries: DataFrame, exp: str, passage_id: str) -> DataFrame:
    return queries.filter((F.col("exp") == exp) & F.array_contains("relevant", passage_id)).select("query_id", "contents")


def relevant_chunk_texts(queries: DataFrame, retrieved: DataFrame, passages: DataFrame, exp: str, query_id: str) -> DataFrame:
    """Relevant passages of a query with their retrieval score, if any."""
    want = queries.filter((F.col("exp") == exp) & (F.col("query_id") == query_id)).select("exp", "query_id", F.explode(F.array_distinct("relevant")).alias("passage_id"))
    got = retrieved.select("exp", "query_id", F.explode(F.arrays_zip("retrieved", "retrieved_scores")).alias("x")).select("exp", "query_id", F.col("x.retrieved").alias("passage_id"), F.col("x.retrieved_scores").alias("score"))
    return want.join(got, ["exp", "query_id", "passage_id"], "left").join(passages, ["exp", "passage_id"], "left").select("passage_id", F.coalesce("contents", F.lit("")).alias("contents"), "score", F.col("score").isNotNull().alias("was_retrieved"))


def partner(dataset: Column) -> Column:
    """A merged dataset's slug without its ending, or with it."""
    return F.when(dataset.endswith("_merged"), F.regexp_replace(dataset, "_merged$", "")).otherwise(F.concat(dataset, F.lit("_merged")))


def pair_info(experiments: DataFrame, facts: DataFrame) -> DataFrame:
    """Per (dataset, query): how it fares beside its merged partner, over the chunkers both have.

    ``facts``: exp, query_id, hit.
    """
    own = facts.join(experiments.select("exp", "dataset", "chunker"), "exp")
    plain = own.filter(~F.col("dataset").endswith("_merged"))
    merged = own.filter(F.col("dataset").endswith("_merged")).select(F.regexp_replace("dataset", "_merged$", "").alias("dataset"), "chunker", "query_id", F.col("hit").alias("merged_hit"))
    both = plain.join(merged, ["dataset", "chunker", "query_id"])
    return both.groupBy("dataset", "query_id").agg(pair_status(F.bool_or(F.col("merged_hit") & ~F.col("hit")), F.bool_or(F.col("hit") & ~F.col("merged_hit"))).alias("status"))


def search(queries: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive search in questions and answers."""
    n = F.lit(needle.lower())
    return queries.filter(F.contains(F.lower("contents"), n) | F.exists(F.coalesce("answers", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), n)))


def scored(pairs: DataFrame, score) -> DataFrame:
    """Rows (query, text) with ``score(queries, texts) -> list`` of an injected model, by batches."""
    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(score(q.tolist(), t.tolist()), dtype="float64")

    return pairs.withColumn("score", run("query", "text"))


def sorted_by_score(rows: DataFrame, column: str) -> DataFrame:
    return rows.orderBy(F.col(column).desc_nulls_last())


def first_record(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__r = 1").drop("__r")
