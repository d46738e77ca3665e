"""JSON lines, TSV and sidecar sinks."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False, single_file_order: list | None = None) -> None:
    """JSON lines; a single ordered file only on request, as all rows then pass one task."""
    out = df.orderBy(*single_file_order).coalesce(1) if single_file_order else df
    out.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_tsv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").csv(path, sep="\t", header=True)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def stamped(path: str, now: datetime | None = None) -> str:
    """The path with a UTC stamp before its suffix."""
    p = Path(path)
    return str(p.with_name(f"{p.stem}_{(now or datetime.now(timezone.utc)):%Y%m%dT%H%M%SZ}{p.suffix}"))


def sidecar(path: str, payload: dict) -> str:
    to = f"{path}.meta.json"
    Path(to).write_text(json.dumps(payload, ensure_ascii=False, indent=2), encoding="utf-8")
    return to


def missing_report(report: DataFrame) -> DataFrame:
    """Rows of the missing-relevance report, the share with two decimals."""
    return report.select("dataset", "run", "missing_count", "total", F.format_string("%.2f", "percent").alias("percent"))


def export_rows(passages: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of an export: passages with parent and original id, queries with parallel relevance and scores."""
    p = passages.select(F.col("passage_id").alias("id"), "contents", F.struct(F.col("parent_id").alias("parentId"), "original_id").alias("metadata"))
    return p, queries.select(F.col("query_id").alias("id"), "contents", "relevant", "relevant_scores")
