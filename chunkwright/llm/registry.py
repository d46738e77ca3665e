"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkwright.llm import bwt_dedup, exact_dedup, html_extract, mixing, packing, quality, simhash, topk, tree_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1,
    "op2_html_extract": html_extract.op2,
    "op3_exact_topk": topk.op3,
    "op4_simhash": simhash.op4,
    "op5_url_filter": url_filter.op5,
    "op6_quality": quality.op6,
    "op7_mixing": mixing.op7,
    "op8_suffix_array_dedup": bwt_dedup.op8,
    "op9_packing": packing.op9,
    "op10_substring_dedup": tree_dedup.op10,
}
ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op3_exact_topk": topk.OP3_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
}
