"""Record types as Spark schemas.  Order is explicit: every table has an ordinal."""

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

DOCUMENT = StructType.fromDDL("doc_id string, contents string, metadata string, doc_ord bigint")
QUERY = StructType.fromDDL("query_id string, contents string, relevant array<string>, metadata string, query_ord bigint")
PASSAGE = StructType.fromDDL("passage_id string, parent_id string, contents string, start_char int, end_char int, start_sentence int, end_sentence int, metadata string, passage_ord bigint")
EXPORTED_QUERY = StructType(
    [StructField("id", StringType()), StructField("contents", StringType()), StructField("relevant", ArrayType(StringType())), StructField("relevant_scores", ArrayType(DoubleType()))]
)
CHUNK = StructType(
    [StructField("doc_id", LongType()), StructField("chunk_index", IntegerType()), StructField("chunk_id", StringType()), StructField("text", StringType())]
)
RUN_SIGNATURE = StructType.fromDDL(
    "run string, dataset_slug string, query_count bigint, minus_one_query_count bigint, passage_count bigint, query_ids_sha256 string, relevance_sha256 string, mapping_sha256 string"
)
TIMING = StructType.fromDDL("run string, status string, exit_code int, duration_sec int, successfully_converted string, failed string, note string, log_path string")
