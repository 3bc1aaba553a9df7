"""Canonical schemas.

The stable envelope of every log record is a fixed ``StructType``; open
parts (payload params, metadata) stay JSON text or MAP and are read with
``get_json_object`` / ``from_json`` where an operator needs them.  Times are
TIMESTAMP in UTC.  ``time_limit`` stays text on read because numbers, null,
quoted numbers and booleans all occur in job documents; operators decide
what is numeric.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, I, TS = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.IntegerType(),
    T.TimestampType(),
)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


JOB_INFO = T.StructType(
    [
        _f("id", S),
        _f("job_queue", S),
        _f("time_queued", TS),
        _f("time_start", TS),
        _f("time_end", TS),
        _f("cmd_start", TS),
        _f("cmd_end", TS),
        _f("time_limit", S),
        _f("soft_time_limit", S),
        _f("status", I),
        _f("pid", I),
        _f("execute_node", S),
        _f("duration", D),
    ]
)

JOB = T.StructType(
    [
        _f("name", S),
        _f("type", S),
        _f("tag", S),
        _f("priority", I),
        _f("params", S),  # JSON text of the payload
        _f("job_info", JOB_INFO),
    ]
)

# One row per status write of a job (S1).  ``seq`` orders writes with equal
# event time; ``supervisory`` marks writes made by a watchdog or event
# processor rather than by the worker that ran the job.
JOB_EVENT = T.StructType(
    [
        _f("payload_id", S),
        _f("uuid", S),
        _f("job_id", S),
        _f("payload_hash", S),
        _f("dedup", B),
        _f("status", S),
        _f("tags", T.ArrayType(S)),
        _f("error", S),
        _f("short_error", S),
        _f("traceback", S),
        _f("celery_hostname", S),
        _f("resource", S),
        _f("type", S),
        _f("ts", TS),
        _f("seq", L),
        _f("supervisory", B),
        _f("job", JOB),
    ]
)

TASK_EVENT = T.StructType(
    [
        _f("uuid", S),
        _f("status", S),
        _f("celery_hostname", S),
        _f("type", S),
        _f("ts", TS),
        _f("seq", L),
        _f("event", T.StructType([_f("exception", S), _f("traceback", S), _f("name", S), _f("args", S)])),
    ]
)

WORKER_EVENT = T.StructType(
    [
        _f("celery_hostname", S),
        _f("status", S),
        _f("tags", T.ArrayType(S)),
        _f("ts", TS),
        _f("seq", L),
    ]
)

CUSTOM_EVENT = T.StructType(
    [
        _f("uuid", S),
        _f("type", S),
        _f("status", S),
        _f("hostname", S),
        _f("tags", T.ArrayType(S)),
        _f("event", S),
        _f("ts", TS),
    ]
)

# Allowed fields of the per-job metric document (S3), in the order they are
# written.  Fixed values.
JOB_INFO_METRIC_FIELDS = (
    "job_queue",
    "time_queued",
    "time_start",
    "time_end",
    "duration",
    "execute_node",
    "job_dir_size",
    "metrics",
    "facts",
    "status",
)

RULE = T.StructType(
    [
        _f("rule_name", S),
        _f("query_string", S),
        _f("enabled", B),
        _f("job_type", S),
        _f("priority", I),
        _f("query_all", B),
        _f("index_pattern", S),
        _f("job_name_path", S),
        _f("username", S),
        _f("kwargs", S),
    ]
)

DATASET_CONFIG = T.StructType(
    [
        _f("position", I),
        _f("match_pattern", S),
        _f("alt_match_pattern", S),
        _f("ipath", S),
        _f("version", S),
        _f("level", S),
        _f("type", S),
        _f("extractor", S),
        _f("publish_location", S),
        _f("publish_urls", T.ArrayType(S)),
        _f("browse_location", S),
        _f("browse_urls", T.ArrayType(S)),
    ]
)

LEASE = T.StructType(
    [
        _f("payload_id", S),
        _f("lock_exists", B),
        _f("task_id", S),
        _f("worker", S),
        _f("acquired_at", D),
        _f("last_renewed_at", D),
    ]
)

METRIC_ROW = T.StructType(
    [
        _f("sdswatch_timestamp", TS),
        _f("host", S),
        _f("source_type", S),
        _f("source_id", S),
        _f("metric_key", S),
        _f("metric_value_string", S),
        _f("metric_value_float", D),
        _f("log_path", S),
    ]
)

QUEUE_STATS = T.StructType(
    [
        _f("queue", S),
        _f("messages", L),
        _f("messages_ready", L),
        _f("messages_unacknowledged", L),
    ]
)

LOG_CHUNK_LINE = T.StructType(
    [
        _f("id", S),
        _f("type", S),
        _f("seq", L),
        _f("ts", TS),
        _f("hostname", S),
        _f("pid", I),
        _f("chunk", S),
    ]
)
