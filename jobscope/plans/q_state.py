"""Registered queries: current state, timeline, latest/earliest, top-n."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.operators import state
from jobscope.plans.oracle import with_adapters
from jobscope.plans.registry import register
from jobscope.sources import adapters as A

STATE_COLS = ["payload_id", "status", "ts", "seq", "celery_hostname", "type"]


@register(
    "a1_current_state",
    with_adapters("""
SELECT payload_id, status, ts, seq, celery_hostname, type FROM jobs_current"""),
    bench=True,
)
def a1_current_state(spark, sf):
    """A1: last write per job key over the whole job event log."""
    ev = A.job_events(spark, sf).select(*STATE_COLS)
    return state.current_state(ev, "payload_id")


@register(
    "a2_current_state_guarded",
    with_adapters("""
SELECT payload_id, status, ts, seq, celery_hostname, type FROM (
  SELECT *, row_number() OVER (
      PARTITION BY payload_id
      ORDER BY (status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked')) DESC,
               (status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked') AND NOT supervisory) DESC,
               ts DESC, seq DESC) AS rn
  FROM job_events) WHERE rn = 1"""),
    bench=True,
)
def a2_current_state_guarded(spark, sf):
    """A2: terminal writes are not replaced by later non-terminal ones."""
    ev = A.job_events(spark, sf).select(*STATE_COLS, "supervisory")
    return state.current_state_guarded(ev, "payload_id").drop("supervisory")


TIMELINE_SQL = """
SELECT payload_id,
       min(CASE WHEN status = 'job-queued' THEN ts END) AS time_queued,
       min(CASE WHEN status = 'job-started' THEN ts END) AS time_start,
       max(CASE WHEN status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked') THEN ts END) AS time_end,
       count(*) AS n_events,
       arg_max(status, struct_pack(t := status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked'),
               a := status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked') AND NOT supervisory,
               ts := ts, seq := seq)) AS final_status,
       (epoch_us(min(CASE WHEN status = 'job-started' THEN ts END)) - epoch_us(min(CASE WHEN status = 'job-queued' THEN ts END))) / 1e6 AS wait_secs,
       (epoch_us(max(CASE WHEN status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked') THEN ts END))
        - epoch_us(min(CASE WHEN status = 'job-started' THEN ts END))) / 1e6 AS run_secs
FROM job_events GROUP BY payload_id"""


@register("a3_job_timeline", with_adapters(TIMELINE_SQL), bench=True)
def a3_job_timeline(spark, sf):
    """A3: per job queued/started/ended, wait, run time, final status."""
    ev = A.job_events(spark, sf).select("payload_id", "status", "ts", "seq", "supervisory")
    return state.job_timeline(ev, "payload_id")


def timeline_with_state(spark, sf):
    """Flagship: every job's timeline with its guarded current state.

    Timeline and current state come out of one aggregation over the log
    (one scan, one shuffle on ``payload_id``, partial aggregation map-side);
    no join is needed.
    """
    ev = A.job_events(spark, sf).select(*STATE_COLS, "supervisory")
    return state.timeline_and_state(ev, "payload_id", ["celery_hostname", "type"])


register(
    "a3_timeline_with_state",
    with_adapters(f"""
WITH tl AS ({TIMELINE_SQL}),
cur AS (
  SELECT payload_id, status AS current_status, ts AS last_update, celery_hostname, type FROM (
    SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY
        (status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked')) DESC,
        (status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked') AND NOT supervisory) DESC,
        ts DESC, seq DESC) AS rn FROM job_events) WHERE rn = 1)
SELECT tl.*, cur.current_status, cur.last_update, cur.celery_hostname, cur.type
FROM tl JOIN cur USING (payload_id)"""),
    bench=True,
)(timeline_with_state)


@register(
    "w1_latest_task_per_job",
    with_adapters("""
SELECT uuid, status, celery_hostname, ts, seq, exception FROM (
  SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ts DESC, seq DESC) AS rn FROM task_events)
WHERE rn = 1"""),
)
def w1_latest_task_per_job(spark, sf):
    """Newest task event per task id."""
    t = A.task_events(spark, sf).select("uuid", "status", "celery_hostname", "ts", "seq", F.col("event.exception").alias("exception"))
    return state.latest_per(t, "uuid", ["ts", "seq"])


@register(
    "w1_latest3_per_worker",
    with_adapters("""
SELECT celery_hostname, status, ts, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY celery_hostname ORDER BY ts DESC, seq DESC) AS rn FROM worker_events)
WHERE rn <= 3"""),
)
def w1_latest3_per_worker(spark, sf):
    """W1 with n=3: three newest worker events per worker (WindowGroupLimit)."""
    w = A.worker_events(spark, sf).select("celery_hostname", "status", "ts", "seq")
    return state.latest_per(w, "celery_hostname", ["ts", "seq"], n=3)


@register(
    "w2_earliest_per_hash",
    with_adapters("""
SELECT payload_hash, payload_id, status, time_queued FROM (
  SELECT *, row_number() OVER (PARTITION BY payload_hash ORDER BY time_queued ASC, payload_id ASC) AS rn FROM jobs)
WHERE rn = 1"""),
)
def w2_earliest_per_hash(spark, sf):
    """Oldest job per payload hash (queue time, then id)."""
    j = A.jobs(spark, sf).select("payload_hash", "payload_id", "status", "time_queued")
    return state.earliest_per(j, "payload_hash", ["time_queued", "payload_id"])


@register(
    "w8_top_n_limits",
    with_adapters("""
SELECT payload_id, job_type, time_limit FROM jobs ORDER BY time_limit DESC, payload_id DESC LIMIT 100"""),
)
def w8_top_n_limits(spark, sf):
    """The 100 jobs with the largest time limits (a top-k report)."""
    j = A.jobs(spark, sf).select("payload_id", "job_type", "time_limit")
    return state.top_n(j, ["time_limit", "payload_id"], 100)
