"""From document-level to passage-level relevance.

Queries that share their (ordered, distinct) relevant documents share a bin.
Per bin the passages of these documents are merged in order, each at its
longest overlap with what stands before; answers are then looked up in the
merged text, and every smallest run of passages that covers an occurrence
scores 1 / (its length).  A bin is read once, whatever its queries.

Shuffles: passages to bins, queries to bins.  Frequent bins stay one row of
passages; queries are exploded only after scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.text import match_form
from chunkwright.operators.numbering import with_running_number

SEED = 24


def overlap_length(before: str, following: str) -> int:
    """The longest end of ``before`` that ``following`` begins with."""
    most = min(len(before), len(following))
    seed = following[: min(SEED, most)]
    at = before.find(seed, len(before) - most) if most else -1
    while at >= 0 and len(before) - at >= len(seed):
        if following.startswith(before[at:]):
            return len(before) - at
        at = before.find(seed, at + 1)
    return next((n for n in range(min(len(seed), most), 0, -1) if before.endswith(following[:n])), 0)


def merge_spans(texts: list[str], offsets: list[tuple[int, int]] | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """Merged text and (start, end, overlap) of each.

    With ``offsets`` (positions in one document) overlaps come from these
    instead of from what the texts look like.
    """
    merged, spans = "", []
    tail, longest = "", max(map(len, texts), default=0)
    parts, length = [], 0
    for i, text in enumerate(texts):
        if offsets is None:
            n = overlap_length(tail, text)
        else:
            n = min(len(text), max(0, offsets[i - 1][1] - offsets[i][0])) if i else 0
        start = length - n
        spans.append((start, start + len(text), n))
        parts.append(text[n:])
        length += len(text) - n
        tail = (tail + text[n:])[-longest:] if longest else ""
    merged = "".join(parts)
    return merged, spans


def positions(text: str, needle: str) -> list[int]:
    out, at = [], text.find(needle) if needle else -1
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + 1)
    return out


def covering(spans: list[tuple[int, int, int]], start: int, end: int) -> list[range]:
    """Runs of spans: each begins at one that holds ``start`` and ends at the first from there that reaches ``end``."""
    out = []
    for i, (a, b, _) in enumerate(spans):
        if a <= start < b:
            last = next((j for j in range(i, len(spans)) if spans[j][1] >= end), None)
            if last is not None:
                out.append(range(i, last + 1))
    return out


def answer_scores(spans: list[tuple[int, int, int]], merged: str, answers: list[str]) -> dict[int, float]:
    best: dict[int, float] = {}
    for answer in answers:
        for at in positions(merged, answer):
            for run in covering(spans, at, at + len(answer)):
                for i in run:
                    best[i] = max(best.get(i, 0.0), 1 / len(run))
    return best


def renumbered(passages: DataFrame) -> DataFrame:
    """passage_id "0".."n-1" in the order of passage_ord; the id before stays as original_id."""
    numbered = with_running_number(passages, ["passage_ord"], "__n")
    return numbered.withColumn("original_id", F.col("passage_id").cast("string")).withColumn("passage_id", F.col("__n").cast("string")).withColumn("passage_ord", F.col("__n")).drop("__n")


def bins(queries: DataFrame) -> DataFrame:
    """Distinct ordered lists of relevant documents: bin, docs."""
    docs = F.array_distinct(F.coalesce("relevant", F.array().cast("array<string>")))
    return queries.select(F.sha2(F.to_json(docs), 256).alias("bin"), docs.alias("docs")).distinct()


def bin_passages(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """bin, items: the passages of each bin in the order of its documents, then of the passages, without repeats."""
    at = bins(queries).select("bin", F.posexplode("docs").alias("doc_pos", "parent_id"))
    rows = at.join(passages.select("parent_id", "passage_id", "passage_ord", "contents"), "parent_id")
    item = F.struct("doc_pos", "passage_ord", "passage_id", "contents")
    return rows.groupBy("bin").agg(F.array_sort(F.collect_list(item)).alias("items"))


def merged_bins(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """bin, text, spans of the merged passages in matching form."""
    own = bin_passages(queries, passages.withColumn("contents", match_form(F.col("contents"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b, items in zip(batch.column("bin").to_pylist(), batch.column("items").to_pylist(), strict=True):
                text, spans = merge_spans([x["contents"] for x in items])
                rows.append({"bin": b, "text": text, "spans": [{"passage_id": x["passage_id"], "start": s, "end": e, "overlap": n} for x, (s, e, n) in zip(items, spans, strict=True)]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    span = pa.struct([("passage_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("overlap", pa.int32())])
    schema = pa.schema([("bin", pa.string()), ("text", pa.string()), ("spans", pa.list_(span))])
    return own.mapInArrow(run, "bin string, text string, spans array<struct<passage_id: string, start: int, end: int, overlap: int>>")


def passage_relevance(queries: DataFrame, passages: DataFrame, patch_empty: bool = True) -> DataFrame:
    """query_id, relevant, relevant_scores, extractive.

    ``queries``: query_id, query_ord, relevant (document ids), answers (null:
    the query has no answer key; an empty list: it has the key and nothing in
    it), optional metadata.  Queries without the key get every passage of their
    documents at 1.0; with it, the passages that cover an answer; none found
    gives ["-1"] and [0.0] if ``patch_empty``.
    """
    docs = F.array_distinct(F.coalesce("relevant", F.array().cast("array<string>")))
    asked = queries.withColumn("bin", F.sha2(F.to_json(docs), 256)).withColumn("__answers", F.transform("answers", match_form))
    own = asked.groupBy("bin").agg(F.collect_list(F.struct("query_id", "__answers")).alias("asked"))
    found = bin_passages(queries, passages.withColumn("contents", match_form(F.col("contents")))).join(own, "bin", "right")
    scored = pa.schema([("query_id", pa.string()), ("extractive", pa.bool_()), ("relevant", pa.list_(pa.string())), ("relevant_scores", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for items, wanted in zip(batch.column("items").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                items = items or []
                text, spans = merge_spans([x["contents"] for x in items]) if any(q["__answers"] for q in wanted) else ("", [])
                for q in wanted:
                    if q["__answers"] is None:
                        best = dict.fromkeys(range(len(items)), 1.0)
                    else:
                        best = answer_scores(spans, text, q["__answers"])
                    at = sorted(best)
                    rows.append({"query_id": q["query_id"], "extractive": q["__answers"] is not None, "relevant": [items[i]["passage_id"] for i in at], "relevant_scores": [best[i] for i in at]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=scored)

    out = found.select("items", "asked").mapInArrow(run, "query_id string, extractive boolean, relevant array<string>, relevant_scores array<double>")
    return patched(out) if patch_empty else out


def patched(queries: DataFrame) -> DataFrame:
    """Empty relevance becomes ["-1"] with score 0."""
    none = F.size("relevant") == 0
    return queries.withColumn("relevant_scores", F.when(none, F.array(F.lit(0.0))).otherwise(F.col("relevant_scores"))).withColumn("relevant", F.when(none, F.array(F.lit("-1"))).otherwise(F.col("relevant")))


def exported_metadata(metadata: str = "metadata") -> list:
    """The two answer keys that an export keeps, from JSON metadata."""
    m = F.col(metadata)
    return [F.from_json(F.get_json_object(m, f"$.{k}"), "array<string>").alias(k) for k in ("extractive_span_text_answer", "free_text_answer")]


def answers_of(metadata: str = "metadata", own: str | None = None) -> F.Column:
    """Answers by key presence: null without the key, a list (empty for null or []) with it.

    ``own``: JSON of the same key beside the metadata, null where it is absent;
    it serves where the metadata has no value.
    """
    m = F.coalesce(F.col(metadata), F.lit("{}"))
    key = F.lit("extractive_span_text_answer")
    has = F.array_contains(F.coalesce(F.json_object_keys(m), F.array().cast("array<string>")), key)
    found = F.get_json_object(m, "$.extractive_span_text_answer")
    if own:
        has, found = has | F.col(own).isNotNull(), F.coalesce(found, F.col(own))
    as_list = F.from_json(found, "array<string>")
    scalar = F.when(found.isNotNull() & ~found.startswith("["), F.array(found))
    return F.when(has, F.coalesce(scalar, as_list, F.array().cast("array<string>")))
