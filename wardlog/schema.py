"""Schemas of the entry, alert and job tables."""

from pyspark.sql import types as T

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_time_local", T.TimestampNTZType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("response_size", T.LongType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw_line", T.StringType()),
        T.StructField("extra_fields", T.MapType(T.StringType(), T.StringType())),
    ]
)

# ``order_line`` is the line that raised the alert first; with ``detector_order``
# it gives alerts of one severity a stable order.
ALERT_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("severity_rank", T.IntegerType()),
        T.StructField("detector", T.StringType()),
        T.StructField("detector_order", T.IntegerType()),
        T.StructField("order_line", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("target_account", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("recommended_actions", T.ArrayType(T.StringType())),
        T.StructField("is_resolved", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

JOB_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("log_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_lines", T.LongType()),
        T.StructField("parsed_lines", T.LongType()),
        T.StructField("created_by_user_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
