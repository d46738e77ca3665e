"""Preparing datasets and exporting runs, end to end."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.operators import prepare, relevance
from chunkwright.plans.runs import with_time_limit
from chunkwright.sources import jsonl, sinks

# Spellings of yes/no answers and of answers that there are none.
YES, NO, NONE = ("yes", "true"), ("no", "false"), ("unanswerable", "no answer", "none")


def stated_answers(answers: F.Column) -> F.Column:
    """Yes/no and unanswerable answers in one spelling each, repeats left out."""

    def one(a):
        word = F.lower(F.btrim(a))
        return F.when(word.isin(*YES), "yes").when(word.isin(*NO), "no").when(word.isin(*NONE), "unanswerable").otherwise(a)

    return F.array_distinct(F.filter(F.transform(answers, one), lambda a: a.isNotNull()))


def annotation_list(columns: dict[str, F.Column]) -> F.Column:
    """Parallel arrays as an array of structs, short ones filled with null."""
    return F.arrays_zip(*[c.alias(k) for k, c in columns.items()])


def prepared(docs: DataFrame, queries: DataFrame, max_documents: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The coverage filter, then the first documents and the queries that still have a relevant one."""
    kept = prepare.coverage_filtered(queries)
    return (docs, kept) if max_documents is None else prepare.first_documents(docs, kept, max_documents)


def write_dataset(docs: DataFrame, queries: DataFrame, root: str, overwrite: bool = False) -> None:
    sinks.write_jsonl(docs, f"{root}/documents", overwrite)
    sinks.write_jsonl(queries, f"{root}/queries", overwrite)


def merged_dataset(docs: DataFrame, queries: DataFrame, merged_id: str = "merged") -> tuple[DataFrame, DataFrame]:
    answers = "extractive_span_text_answer" if "extractive_span_text_answer" in queries.columns else "answers"
    return prepare.super_document(docs, merged_id=merged_id), prepare.merged_queries(queries, docs, merged_id, answers)


def exported_run(spark: SparkSession, run_dir: str, out: str, overwrite: bool = False) -> dict:
    """Read a run's passages and queries, remap relevance, write both; counts of what was written."""
    passages = jsonl.passages(spark, f"{run_dir}/passages.jsonl").withColumnRenamed("line", "passage_ord")
    asked = jsonl.queries(spark, f"{run_dir}/queries/queries.jsonl").withColumnRenamed("line", "query_ord")
    asked = asked.withColumn("answers", relevance.answers_of(own="own_answers"))
    numbered = relevance.renumbered(passages).persist()
    joined = asked.select("query_id", "contents").join(relevance.passage_relevance(asked, numbered), "query_id").persist()
    try:
        p, q = sinks.export_rows(numbered, joined)
        sinks.write_jsonl(p, f"{out}/passages", overwrite)
        sinks.write_jsonl(q, f"{out}/queries", overwrite)
        counts = joined.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("extractive")).alias("extractive"), F.count_if(F.array_contains("relevant", "-1")).alias("not_found")).first()
        return {"passages": numbered.count(), **counts.asDict()}
    finally:
        joined.unpersist()
        numbered.unpersist()


def export_runs(spark: SparkSession, root: str, out: str, timeout: float | None = 300.0, export: Callable = exported_run) -> list[dict]:
    """Every valid run below a local root, each within its time; a failure is noted and the next run follows."""
    rows = []
    for run in jsonl.run_dirs(root):
        row = {"run": run.name, "status": "finished", "exit_code": 0, "note": ""}
        started = time.monotonic()
        missing = jsonl.missing_files(run)
        try:
            if missing:
                raise FileNotFoundError(f"missing {', '.join(missing)}")
            row |= with_time_limit(spark, lambda run=run: export(spark, str(run), str(Path(out) / run.name)), timeout)
        except TimeoutError:
            row |= {"status": "timed_out", "exit_code": 124, "note": f">{timeout:g}s"}
        except Exception as e:
            row |= {"status": "failed", "exit_code": 1, "note": str(e)[:500]}
        rows.append(row | {"duration_sec": int(time.monotonic() - started)})
    return rows
