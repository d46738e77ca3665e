"""JSON lines, JSON and TSV sources, and discovery of runs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chunkwright.functions.text import truthy

_RAW = "id string, doc_id string, contents string, text string, parentId string, parent_id string, chunk_id string, metadata string, meta string, relevant string, relevant_scores string"
REQUIRED = ("metadata.json", "passages.jsonl", "documents/documents.jsonl", "queries/queries.jsonl")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lenient scan; nested values stay JSON text, blank lines are skipped."""
    return spark.read.schema(_RAW).json(path)


def strings(c: F.Column) -> F.Column:
    """JSON text of a scalar or a list as a list of strings; null is empty."""
    listed = F.from_json(c, "array<string>")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(c.startswith("["), listed).otherwise(F.array(c))


def documents(spark: SparkSession, path: str) -> DataFrame:
    r = raw_lines(spark, path)
    return r.select(F.coalesce(truthy(F.col("id")), F.expr("uuid()")).alias("doc_id"), F.coalesce(truthy(F.col("contents"), F.col("text")), F.lit("")).alias("contents"), F.coalesce("metadata", F.lit("{}")).alias("metadata"))


def line_order() -> F.Column:
    """Orders the rows of a scan as their lines stand: by file, block of the file, and place in the block."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def chunker_rows(docs: DataFrame) -> DataFrame:
    """Documents as chunkers take them: a doc_id in the metadata overrides the document's own, even with null."""
    named = F.array_contains(F.coalesce(F.json_object_keys("metadata"), F.array().cast("array<string>")), "doc_id")
    return docs.select(F.when(named, F.get_json_object("metadata", "$.doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.col("contents").alias("text"), "metadata")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries, ``line`` (their order) and ``own_answers``: JSON of an answer key beside the metadata, [] for null."""
    key = "extractive_span_text_answer"
    lines = spark.read.text(path).select("value", line_order().alias("line")).filter(F.trim("value") != "")
    r = lines.select("value", "line", F.from_json("value", _RAW).alias("r")).select("value", "line", "r.*")
    scores = F.transform(strings(F.col("relevant_scores")), lambda x: x.cast("double"))
    beside = F.contains("value", F.lit(key)) & F.array_contains(F.json_object_keys("value"), key)
    filled = lambda c: F.when(~F.btrim(c).isin("", "{}", "[]", "0", "false"), F.col(c))
    return r.select(
        F.coalesce(truthy(F.col("id")), F.expr("uuid()")).alias("query_id"), F.coalesce(truthy(F.col("contents"), F.col("text")), F.lit("")).alias("contents"),
        strings(F.col("relevant")).alias("relevant"), scores.alias("relevant_scores"), F.coalesce(filled("metadata"), filled("meta"), F.lit("{}")).alias("metadata"),
        F.when(beside, F.coalesce(F.get_json_object("value", f"$.{key}"), F.lit("[]"))).alias("own_answers"), "line",
    )


def passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages, and ``line``, their order."""
    r = raw_lines(spark, path)
    m = F.col("metadata")
    parent = truthy(F.col("parentId"), F.col("parent_id"), F.get_json_object(m, "$.parentId"), F.get_json_object(m, "$.doc_id"))
    return r.select(F.coalesce(truthy(F.col("id"), F.col("chunk_id")), F.expr("uuid()")).alias("passage_id"), F.coalesce(parent, F.lit("")).alias("parent_id"), F.coalesce(truthy(F.col("contents"), F.col("text")), F.lit("")).alias("contents"), F.coalesce(m, F.lit("{}")).alias("metadata"), line_order().alias("line"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    r = raw_lines(spark, path)
    return r.select(F.coalesce("chunk_id", "id").alias("chunk_id"), F.coalesce("text", "contents", F.lit("")).alias("text"), F.coalesce("metadata", F.lit("{}")).alias("metadata"))


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line must be an object of the schema, or the read fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no JSON objects: file and text."""
    schema = StructType([StructField("__bad", StringType())])
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).filter(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return lines.filter(F.coalesce(parsed["__bad"].isNotNull() | ~F.ltrim("value").startswith("{"), F.lit(True))).select("file", "value")


def json_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON, with the name of its folder as exp."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.withColumn("exp", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def timing_report(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True)
    number = lambda c: F.coalesce(F.try_to_number(F.col(c), F.lit("999999999")).cast("int"), F.lit(0)).alias(c)
    return rows.select(*[number(c) if c in ("exit_code", "duration_sec") else F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def run_dirs(root: str) -> list[Path]:
    """Folders run_* below a local root, resolved, once each, in order."""
    return sorted({p.resolve() for p in Path(root).rglob("run_*") if p.is_dir()})


def missing_files(run: Path) -> list[str]:
    return [x for x in REQUIRED if not (run / x).is_file()]


def valid_run_dirs(root: str) -> list[Path]:
    return [p for p in run_dirs(root) if not missing_files(p)]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
