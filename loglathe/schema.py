"""Columns of the normalized event and of the driver-side tables."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_hash", T.StringType()),
        T.StructField("event_ts", T.StringType()),
        T.StructField("ts_source", T.StringType()),
        T.StructField("source_host", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("actor_user", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("extras", T.VariantType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("review_flag", T.BooleanType()),
        T.StructField("validation_issues", T.ArrayType(T.StringType())),
        T.StructField("format_hint", T.StringType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

# A line table may carry these; together they order the lines of one read.
LINEAGE_COLUMNS = ["source_rank", "file_path", "block_start", "line_id"]
