"""Chunk quality, comparison of chunkers and of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.functions.boundary import boundary_label

PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def labelled_boundaries(passages: DataFrame, parent: str = "parent_id", order: str = "passage_ord", text: str = "contents") -> DataFrame:
    """Each passage with the label of its boundary to the next of its parent.

    Passages of a parent lie together in file order, so the window runs inside
    a parent instead of over the whole file.
    """
    over = Window.partitionBy(parent).orderBy(order)
    following = F.lead(text).over(over)
    return passages.withColumn("__next", following).withColumn("label", boundary_label(F.col(text), F.coalesce("__next", F.lit("")), F.col("__next").isNotNull())).drop("__next")


def chunk_metrics(passages: DataFrame, keys: list[str], length: Column, id_col: str, order: str) -> DataFrame:
    """Length statistics per run, with the first id at either extreme, and shares of boundary labels (column label)."""
    rows = passages.withColumn("__n", length)
    out = [
        F.count(F.lit(1)).alias("chunks"), F.avg("__n").alias("mean"), F.percentile("__n", F.lit(0.5)).alias("median"), F.stddev_pop("__n").alias("std"),
        F.min("__n").alias("min"), F.max("__n").alias("max"),
        F.min_by(id_col, F.struct("__n", order)).alias("min_id"), F.min_by(id_col, F.struct((-F.col("__n")).alias("m"), order)).alias("max_id"),
    ]
    out += [F.percentile("__n", F.lit(p / 100)).alias(f"p{p}") for p in PERCENTILES]
    if "label" in passages.columns:
        out += [F.avg((F.col("label") == x).cast("double")).alias(f"{x}_ratio") for x in ("good", "fail", "end_file")]
    return rows.groupBy(*keys).agg(*out)


def overlap_percent(metrics: DataFrame, dataset: str, mean: str) -> DataFrame:
    least = F.min(mean).over(Window.partitionBy(dataset))
    return metrics.withColumn("overlap_pct", F.round((F.col(mean) - least) / least * 100, 1))


def dataset_summary(runs: DataFrame) -> DataFrame:
    """dataset, document_count of its first run, chunkers and their number."""
    return runs.groupBy("dataset").agg(
        F.min_by("document_count", "run_ord").alias("document_count"), F.count_distinct("chunker").alias("n_chunkers"), F.array_join(F.array_sort(F.collect_set("chunker")), ", ").alias("chunkers")
    )


def average_length(passages: DataFrame, keys: list[str], text: str = "contents") -> DataFrame:
    return passages.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_count"), F.avg(F.length(text)).alias("avg_length")).withColumn("total_length", F.col("avg_length") * F.col("chunk_count"))


def document_lengths(docs: DataFrame, keys: list[str], text: str, threshold: int = 1_000_000) -> DataFrame:
    n = F.length(text)
    return docs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(n > threshold).alias("over"), (100 * F.avg((n > threshold).cast("double"))).alias("over_pct"), F.max(n).alias("max_length")
    )


def missing_relevance(queries: DataFrame, keys: list[str]) -> DataFrame:
    """Queries without a relevant passage ("-1"), per run."""
    out = queries.groupBy(*keys).agg(F.count_if(F.array_contains("relevant", "-1")).alias("missing_count"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("percent", F.when(F.col("total") > 0, 100 * F.col("missing_count") / F.col("total")).otherwise(0.0))


def hit_rates(facts: DataFrame, chunker: str = "chunker", hit: str = "hit") -> DataFrame:
    out = facts.groupBy(chunker).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col(hit).cast("int")).alias("hits"))
    return out.withColumn("hit_rate", F.round(100 * F.col("hits") / F.col("total"), 2)).orderBy(F.desc("hit_rate"), chunker)


def rank_statistics(facts: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    return facts.filter(F.col(rank).isNotNull()).groupBy(*keys).agg(
        F.avg(rank).alias("mean_rank"), F.percentile(rank, F.lit(0.5)).alias("median_rank"), F.min(rank).alias("min_rank"), F.max(rank).alias("max_rank"), F.count(F.lit(1)).alias("n")
    )


def hits_by_category(facts: DataFrame, category: str, experiment: str, hit: str = "hit") -> DataFrame:
    return facts.groupBy(category, experiment).agg(F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"))


def bucket(good: Column, total: Column) -> Column:
    return F.when(good == total, "all_good").when(good == 0, "all_bad").otherwise("partial")


def pair_status(better: Column, worse: Column) -> Column:
    return F.when(better & worse, "mixed").when(better, "better").when(worse, "worse").otherwise("same")


def bucket_counts(queries: DataFrame) -> DataFrame:
    """Counts by (bucket, status), and over all buckets."""
    sets = [F.col("bucket"), F.col("status")]
    out = queries.groupingSets([sets, [F.col("status")]], *sets).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("bucket", F.lit("all")).alias("bucket"), "status", "n")


def workload(bins: DataFrame) -> DataFrame:
    """Average and most passages and characters of merged bins."""
    n, c = F.size("spans"), F.length("text")
    return bins.agg(F.count(F.lit(1)).alias("bins"), F.avg(n).alias("avg_passages"), F.max(n).alias("max_passages"), F.avg(c).alias("avg_chars"), F.max(c).alias("max_chars"))


def ordered_digest(line: Column, order: Column) -> Column:
    """sha256 of the lines in order, each ended by a newline, as an aggregate.

    The digest is of the concatenation, so the lines of a group meet in one
    value; group by run, and by file where runs are large.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"])
    return F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise("")), 256)


def query_signatures(queries: DataFrame, keys: list[str], order: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("id"), F.col("relevant"), F.transform("relevant_scores", lambda x: x.cast("string")).alias("relevant_scores")))
    return queries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("query_count"), F.count_if(F.array_contains("relevant", "-1")).alias("minus_one_query_count"),
        ordered_digest(F.col("id"), F.col(order)).alias("query_ids_sha256"), ordered_digest(line, F.col(order)).alias("relevance_sha256"),
    )


def passage_signatures(passages: DataFrame, keys: list[str], order: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("id"), F.coalesce("original_id", F.lit("")).alias("original_id"), F.coalesce("parent_id", F.lit("")).alias("parentId")))
    return passages.groupBy(*keys).agg(F.count(F.lit(1)).alias("passage_count"), ordered_digest(line, F.col(order)).alias("mapping_sha256"))


def compared_signatures(baseline: DataFrame, current: DataFrame, max_delta: float = 2.0, fields: tuple = ("query_count", "minus_one_query_count", "passage_count", "query_ids_sha256", "relevance_sha256", "mapping_sha256")) -> DataFrame:
    """Per baseline run: which fields differ, the change in duration, and whether it passes."""
    fields = tuple(f for f in fields if f in baseline.columns and f in current.columns)
    b, c = baseline.alias("b"), current.alias("c")
    joined = b.join(c, F.col("b.run") == F.col("c.run"), "left")
    present = F.col("c.run").isNotNull()
    differing = F.filter(F.array(*[F.when(present & ~F.col(f"b.{f}").eqNullSafe(F.col(f"c.{f}")), f) for f in fields]), lambda x: x.isNotNull())
    delta = F.col("c.duration_sec") - F.col("b.duration_sec")
    out = joined.select(F.col("b.run").alias("run"), present.alias("present"), differing.alias("differing"), delta.alias("delta_sec"))
    timing = F.coalesce(F.abs("delta_sec") <= max_delta, F.lit(False))
    return out.withColumn("timing_ok", timing).withColumn("passed", F.col("present") & (F.size("differing") == 0) & timing)


def comparison_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(~F.col("present")).alias("missing"), F.avg("delta_sec").alias("avg_delta_sec"), F.max(F.abs("delta_sec")).alias("max_delta_sec")
    )


def facts(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query, chunker, relevant chunk) with rank and score where it was retrieved.

    ``queries``: query_id, chunker, relevant; ``retrieved``: query_id, chunker,
    retrieved, retrieved_scores.
    """
    want = queries.select("query_id", "chunker", F.explode(F.array_distinct("relevant")).alias("chunk_id"))
    got = retrieved.select("query_id", "chunker", F.posexplode(F.arrays_zip("retrieved", "retrieved_scores")).alias("p", "x")).select("query_id", "chunker", F.col("x.retrieved").alias("chunk_id"), (F.col("p") + 1).alias("rank"), F.col("x.retrieved_scores").alias("score"))
    return want.join(got, ["query_id", "chunker", "chunk_id"], "left").withColumn("was_retrieved", F.col("rank").isNotNull())


def shared_ends(groups: DataFrame, texts: str, prefix: int = 0, suffix: int = 0) -> DataFrame:
    """Groups whose texts all begin and end alike; fewer than two texts always do."""
    same = lambda f: F.size(F.array_distinct(F.transform(texts, f))) <= 1
    keep = F.lit(True)
    if prefix:
        keep = keep & same(lambda t: F.left(t, F.lit(prefix)))
    if suffix:
        keep = keep & same(lambda t: F.right(t, F.lit(suffix)))
    return groups.filter(keep)


def close_but_apart(pairs: DataFrame, tolerance: float, threshold: float) -> DataFrame:
    """Per merged chunk the first non-merged chunk with nearly its retrieval score and a far reranker score."""
    near = (F.abs(F.col("ret_m") - F.col("ret_n")) <= tolerance) & (F.col("ret_m") != F.col("ret_n")) & (F.abs(F.col("rer_m") - F.col("rer_n")) > threshold)
    over = Window.partitionBy("query_id", "chunk_m").orderBy("pos_n")
    return pairs.filter(near).withColumn("__r", F.row_number().over(over)).filter("__r = 1").drop("__r")


def merged_cases(plain: DataFrame, merged: DataFrame) -> DataFrame:
    """(chunker, query) that the plain run hits and the merged run misses."""
    return plain.filter("hit").select("chunker", "query_id").join(merged.filter("NOT hit").select("chunker", "query_id"), ["chunker", "query_id"])


def chosen_experiments(experiments: DataFrame, datasets: list | None = None, excluded_chunkers: list | None = None) -> DataFrame:
    """Experiments of the named datasets (all, if none is named) without the excluded chunkers."""
    out = experiments.filter(F.col("dataset").isin(datasets)) if datasets else experiments
    return out.filter(~F.col("chunker").isin(excluded_chunkers)) if excluded_chunkers else out


def query_groups(results: DataFrame, across_datasets: bool = False) -> DataFrame:
    """Results of a query together, per dataset or across them; question and answer are those of the first experiment.

    ``results``: exp, dataset, query_id, question, free_text_answer.
    """
    keys = ["query_id"] if across_datasets else ["dataset", "query_id"]
    out = results.groupBy(*keys).agg(F.min_by("question", "exp").alias("question"), F.min_by("free_text_answer", "exp").alias("free_text_answer"), F.array_sort(F.collect_list("exp")).alias("exps"))
    return out.withColumn("dataset", F.lit("MULTI")) if across_datasets else out


def passages_per_document(passages: DataFrame, parent: str = "parent_id") -> DataFrame:
    """One row: the most passages of a document (1 without passages) and how many documents have any."""
    return passages.groupBy(parent).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("max_passages"), F.count(F.lit(1)).alias("documents"))


def runs_per_method(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy("chunker").agg(F.count(F.lit(1)).alias("runs"))
