"""Fixed schemas of the raw tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType


def text_columns(*names: str) -> StructType:
    """A table whose columns are all text, as raw files have them."""
    return StructType([StructField(n, StringType()) for n in names])


SEARCH_LOG = text_columns("talentNo", "ks", "c0", "d0", "search_time", "empStr")
VIEW_LOG = text_columns("organNo", "employeeNo", "dateIn", "talentNo")
APPLY_LOG = text_columns("LogTitle", "empNo", "empName", "talentNo", "datein")
DUTY_CODES = text_columns("CodeNo", "CodeNameA", "CodeNameB", "CodeNameC")
NODE = StructType([StructField("id", StringType()), StructField("type", StringType()), StructField("status", StringType()), StructField("label", StringType()), StructField("aliases", ArrayType(StringType()))])
EDGE = StructType([StructField(n, t) for n, t in (("id", StringType()), ("source_id", StringType()), ("target_id", StringType()), ("type", StringType()), ("modified_at", TimestampNTZType()), ("provenance", StringType()))])
PAIR_ROW = StructType([StructField("query_id", StringType()), StructField("job_id", StringType()), StructField("label", IntegerType()), StructField("exposure_rank", IntegerType()), StructField("features", StringType())])
CANDIDATE = StructType([StructField(n, t) for n, t in (("source_id", StringType()), ("target_id", StringType()), ("support_jobs", LongType()), ("support_companies", LongType()), ("lift", DoubleType()), ("npmi", DoubleType()), ("confidence", DoubleType()))])
