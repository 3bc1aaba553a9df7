"""Registered queries: streaming operators, run over the driver tables read
as file streams (``availableNow``: every available file, then stop).

Each run checkpoints under ``spark.checkpoint.dir`` in a fresh folder, so a
rerun reprocesses the input instead of resuming a finished stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobscope import TERMINAL_JOB_STATUSES
from jobscope.functions.columns import failure_class
from jobscope.operators.rules import rules_frame
from jobscope.plans.oracle import with_adapters
from jobscope.plans.q_state import STATE_COLS
from jobscope.plans.registry import register
from jobscope.sources import adapters as A
from jobscope.streaming import ops as T


def _run(df, tag: str, mode: str = "append"):
    name = f"{tag}_{uuid.uuid4().hex[:8]}"
    return T.run_available(df, name, mode=mode)


@register(
    "t1_stream_current_state",
    with_adapters("""
SELECT payload_id, status, ts, seq, celery_hostname, type FROM (
  SELECT *, row_number() OVER (
      PARTITION BY payload_id
      ORDER BY (status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked')) DESC,
               (status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked') AND NOT supervisory) DESC,
               ts DESC, seq DESC) AS rn
  FROM job_events) WHERE rn = 1"""),
)
def t1_stream_current_state(spark, sf):
    """Guarded current state maintained by a streaming aggregation."""
    ev = A.job_events(spark, sf, streaming=True).select(*STATE_COLS, "supervisory")
    out = _run(T.stream_current_state(ev, "payload_id"), "t1", mode="update")
    return T.latest_output(out, "payload_id").select(*STATE_COLS)


@register("t2_stream_first_by_hash", with_adapters("""
WITH RECURSIVE r AS (
  SELECT payload_hash, min(ts) AS ts FROM job_events GROUP BY payload_hash
  UNION ALL
  SELECT r.payload_hash, min(j.ts) FROM r JOIN job_events j
    ON j.payload_hash = r.payload_hash AND j.ts >= r.ts + INTERVAL 86400 SECOND GROUP BY r.payload_hash, r.ts)
SELECT r.payload_hash, r.ts, arg_min(j.payload_id, j.seq) AS payload_id
FROM r JOIN job_events j ON j.payload_hash = r.payload_hash AND j.ts = r.ts GROUP BY r.payload_hash, r.ts"""))
def t2_stream_first_by_hash(spark, sf):
    """First submission per payload hash and day from it."""
    ev = A.job_events(spark, sf, streaming=True).select("payload_hash", "payload_id", "ts", "seq")
    return _run(T.stream_first_by_hash(ev), "t2").select("payload_hash", "payload_id", "ts")


@register(
    "t3_worker_alive_batch",
    with_adapters("""
SELECT celery_hostname, seq, status, next_ts,
       status <> 'worker-offline' AND (next_ts IS NULL OR (epoch_us(next_ts) - epoch_us(ts)) / 1e6 > 3600) AS expires
FROM (SELECT *, lead(ts) OVER (PARTITION BY celery_hostname ORDER BY ts, seq) AS next_ts FROM worker_events)"""),
)
def t3_worker_alive_batch(spark, sf):
    """T3 (batch form): heartbeats followed by more than an hour of silence."""
    w = A.worker_events(spark, sf).select("celery_hostname", "seq", "status", "ts")
    return T.worker_alive_batch(w, ttl_secs=3600).select("celery_hostname", "seq", "status", "next_ts", "expires")


@register("t3_stream_worker_alive", with_adapters("""
WITH w AS (
  SELECT celery_hostname, status = 'worker-offline' AS off, ts, lag(ts) OVER x AS p,
         lag(status = 'worker-offline') OVER x AS p_off, lead(ts) OVER x AS n
  FROM worker_events WINDOW x AS (PARTITION BY celery_hostname ORDER BY ts, seq)),
f AS (SELECT *, p IS NOT NULL AND NOT p_off AND epoch_us(ts) - epoch_us(p) <= 3600000000 AS alive FROM w),
m AS (SELECT max(epoch_us(ts) // 1000) - 3600000 AS mark FROM worker_events)
SELECT celery_hostname, 'alive' AS status, ts FROM f WHERE NOT off AND NOT alive
UNION ALL SELECT celery_hostname, 'offline', ts FROM f WHERE off AND alive
UNION ALL SELECT celery_hostname, 'expired', ts + INTERVAL 3600 SECOND FROM f, m
WHERE NOT off AND (epoch_us(n) - epoch_us(ts) > 3600000000 OR n IS NULL AND epoch_us(ts) // 1000 + 3600000 < mark)"""))
def t3_stream_worker_alive(spark, sf):
    """Worker liveness changes by gaps and event-time timers."""
    w = A.worker_events(spark, sf, streaming=True)
    return _run(T.stream_worker_alive(w, ttl_secs=3600), "t3").drop("batch")


@register("t4_stream_timeouts", with_adapters("""
WITH e AS (
  SELECT payload_id, status, ts, seq,
         status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked') AS term,
         max(CASE WHEN status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked') THEN ts END)
           OVER (PARTITION BY payload_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
  FROM job_events),
a AS (SELECT * FROM e WHERE term OR ended IS NULL OR epoch_us(ts) - epoch_us(ended) > 7200000000),
n AS (SELECT *, lead(ts) OVER (PARTITION BY payload_id ORDER BY ts, seq) AS nxt FROM a),
m AS (SELECT max(epoch_us(ts) // 1000) - 7200000 AS mark FROM job_events)
SELECT payload_id AS "key", status AS last_status, ts AS last_ts, ts + INTERVAL 7200 SECOND AS timed_out_at
FROM n, m WHERE NOT term AND (epoch_us(nxt) - epoch_us(ts) > 7200000000 OR nxt IS NULL AND epoch_us(ts) // 1000 + 7200000 < mark)"""))
def t4_stream_timeouts(spark, sf):
    """T4: jobs silent for two hours, by gaps and event-time timers."""
    ev = A.job_events(spark, sf, streaming=True).select("payload_id", "status", "ts", "seq")
    return _run(T.stream_timeouts(ev, 7200), "t4").drop("batch")


@register("t5_stream_failed_tasks", with_adapters("""
WITH f AS (
  SELECT uuid, ts, exception, CASE WHEN exception LIKE 'WorkerLostError%' THEN 'WorkerLostError'
         WHEN exception LIKE 'TimeLimitExceeded%' THEN 'TimeLimitExceeded' END AS cls
  FROM task_events WHERE status = 'task-failed' AND (exception LIKE 'WorkerLostError%' OR exception LIKE 'TimeLimitExceeded%')),
j AS (SELECT uuid, ts FROM job_events WHERE status IN ('job-completed','job-deduped','job-offline','job-revoked')
      OR status = 'job-failed' AND NOT coalesce(error LIKE 'WorkerLostError%' OR error LIKE 'TimeLimitExceeded%', false)),
u AS (SELECT uuid, ts FROM f UNION ALL SELECT uuid, ts FROM j),
l AS (SELECT uuid, max(ts) AS last FROM u GROUP BY uuid),
m AS (SELECT max(epoch_us(ts) // 1000) - 300000 AS mark FROM u)
SELECT f.uuid, f.exception AS error, f.cls AS short_error, f.ts AS failed_at
FROM f JOIN l USING (uuid), m
WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.uuid = f.uuid AND j.ts >= f.ts - INTERVAL 86400 SECOND AND j.ts <= f.ts + INTERVAL 300 SECOND)
  AND (l.last > f.ts + INTERVAL 300 SECOND OR epoch_us(f.ts) // 1000 + 300000 < mark)"""))
def t5_stream_failed_tasks(spark, sf):
    """T5: supervisory failures applied after the grace period unless a
    terminal status came first.  A lost worker and one killed at its limit write
    no status: of the job log those failure rows, which the adapted data has at
    the instant of the task failure, are what the operator is to find."""
    t = A.task_events(spark, sf, streaming=True)
    j = A.job_events(spark, sf, streaming=True).where((F.col("status") != "job-failed") | failure_class(F.col("error")).isNull()).select("uuid", "status", "ts")
    return _run(T.stream_failed_tasks(t, j, grace_secs=300), "t5").drop("batch")


@register("t8_stream_job_drain", with_adapters("""
WITH RECURSIVE ev AS (
  SELECT celery_hostname AS host, status = 'job-failed' AS failed, ts,
         row_number() OVER (PARTITION BY celery_hostname ORDER BY ts, seq) AS rn
  FROM job_events WHERE status IN ('job-failed', 'job-completed', 'job-deduped')),
r AS (
  SELECT host, ts, rn, failed, CAST(failed AS BIGINT) AS c, ts AS start, false AS drain FROM ev WHERE rn = 1
  UNION ALL
  SELECT host, ts, rn, failed, c, start,
         c > 3 AND (ts = start OR c / ((epoch_us(ts) - epoch_us(start)) / 1e6) >= 3 / 3600.0)
  FROM (SELECT e.host, e.ts, e.rn, e.failed,
               CASE WHEN NOT e.failed THEN 0 WHEN r.drain THEN 1 ELSE r.c + 1 END AS c,
               CASE WHEN r.drain OR r.c = 0 THEN e.ts ELSE r.start END AS start
        FROM r JOIN ev e ON e.host = r.host AND e.rn = r.rn + 1))
SELECT host, ts, c AS "count", drain FROM r WHERE failed"""))
def t8_stream_job_drain(spark, sf):
    """Drain detection with running per-worker state."""
    ev = A.job_events(spark, sf, streaming=True).select("celery_hostname", "status", "ts", "seq")
    name = f"t8_{uuid.uuid4().hex}"
    T.stream_job_drain(ev, name, threshold=3, window_secs=3600.0).awaitTermination()
    return T.drain_rows(spark, name).drop("batch")


@register(
    "t9_log_chunks",
    with_adapters("""
SELECT id, type, time_bucket(INTERVAL '1 second', ts) AS window_start,
       time_bucket(INTERVAL '1 second', ts) + INTERVAL '1 second' AS window_end,
       string_agg(chunk, '' ORDER BY seq) AS chunk, CAST(count(*) AS INTEGER) AS n_lines
FROM log_lines GROUP BY id, type, time_bucket(INTERVAL '1 second', ts)"""),
    bench=True,
)
def t9_log_chunks(spark, sf):
    """Job output concatenated per stream and 1-second send interval."""
    return T.log_chunks(A.log_lines(spark, sf), "1 second")


@register("t9_stream_log_chunks", with_adapters("""
WITH m AS (SELECT max(epoch_us(ts)) - 1000000 AS mark FROM log_lines)
SELECT id, type, time_bucket(INTERVAL '1 second', ts) AS window_start,
       time_bucket(INTERVAL '1 second', ts) + INTERVAL '1 second' AS window_end,
       string_agg(chunk, '' ORDER BY seq) AS chunk, CAST(count(*) AS INTEGER) AS n_lines
FROM log_lines, m WHERE epoch_us(time_bucket(INTERVAL '1 second', ts)) + 1000000 <= mark
GROUP BY id, type, time_bucket(INTERVAL '1 second', ts)"""))
def t9_stream_log_chunks(spark, sf):
    """T9 as a stream: the intervals that the watermark has passed."""
    lines = A.log_lines(spark, sf, streaming=True)
    return _run(T.log_chunks(lines, "1 second", watermark="1 second"), "t9").drop("batch")


T6_RULES = [
    dict(rule_name="failed_t1", query_string="status = 'job-failed' AND type = 'job-t1'", enabled=True, job_type="io-retry", priority=2, query_all=False, job_name_path="_source.celery_hostname"),
    dict(rule_name="revoked", query_string="status = 'job-revoked' AND celery_hostname IN ('w1', 'w7')", enabled=True, job_type="io-audit", priority=1, query_all=False, job_name_path=None),
    dict(rule_name="broken", query_string="status = = 'x'", enabled=True, job_type="io-x", priority=0, query_all=False, job_name_path=None),
]


@register("t6_stream_rules", with_adapters("""
SELECT CAST(seq AS VARCHAR) AS event, 'failed_t1' AS rule_name, 'io-retry' AS job_type, 2 AS priority, 'retry-' || celery_hostname AS job_name, CAST(seq AS VARCHAR) AS hit_id
FROM job_events WHERE status = 'job-failed' AND type = 'job-t1'
UNION ALL
SELECT CAST(seq AS VARCHAR), 'revoked', 'io-audit', 1, 'audit-' || CAST(seq AS VARCHAR), CAST(seq AS VARCHAR)
FROM job_events WHERE status = 'job-revoked' AND celery_hostname IN ('w1', 'w7')"""))
def t6_stream_rules(spark, sf):
    """Rules on the log's terminal writes, read for each micro-batch."""
    ev = A.job_events(spark, sf, streaming=True).where(F.col("status").isin(*TERMINAL_JOB_STATUSES))
    ev = ev.select(F.col("seq").cast("string").alias("event"), "status", "type", "celery_hostname")
    name = f"t6_{uuid.uuid4().hex}"
    T.stream_rules(ev, lambda s: rules_frame(s, T6_RULES), T.batch_files(spark, name), f"{T.stream_base(spark, name)}/checkpoint", id_col="event", name_prefix="io-").awaitTermination()
    return T.batch_rows(spark, name).drop("batch", "batch_id")
