"""Registered queries: supervision (timeouts, orphans, failures, divergence,
freshness, redelivery, dead nodes, drain, idle hosts, flags, leases, tags)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.operators import state, supervise as S
from jobscope.plans.oracle import EV_AS_OF, ORD_AS_OF, TERMINAL_SQL, with_adapters
from jobscope.plans.registry import register
from jobscope.sources import adapters as A

EV_AS_OF_PY = A.EVENTS_AS_OF
ORD_AS_OF_PY = A.ORDERS_AS_OF


def job_events_flat(spark, sf):
    ev = A.job_events(spark, sf)
    return ev.select(
        "payload_id", "uuid", "status", "tags", "celery_hostname", "ts", "seq", "supervisory", "error",
        F.col("job.job_info.time_limit").alias("time_limit"),
        F.col("job.job_info.time_start").alias("time_start"),
        F.col("job.job_info.time_end").alias("time_end"),
    )


def _current_and_live(spark, sf):
    """Last write (A1) and guarded live status (A2) per job from one aggregation."""
    ev = job_events_flat(spark, sf)
    rest = [c for c in ev.columns if c != "payload_id"]
    term = state.is_terminal("status")
    auth = term & ~F.coalesce(F.col("supervisory"), F.lit(False))
    return ev.groupBy("payload_id").agg(
        F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("cur"),
        F.max_by(F.struct("uuid", "status"), F.struct(term, auth, F.col("ts"), F.col("seq"))).alias("live"),
    )


def jobs_current(spark, sf):
    return _current_and_live(spark, sf).select("payload_id", "cur.*")


def jobs_with_live(spark, sf):
    """Current jobs with the live status beside them: one scan, one shuffle, no join."""
    return _current_and_live(spark, sf).select("payload_id", "cur.*", F.col("live.status").alias("live_status"))


def live_status(spark, sf):
    return _current_and_live(spark, sf).select(F.col("live.uuid").alias("uuid"), F.col("live.status").alias("live_status"))


# ---------------------------------------------------------------- J3 -----

J3_SQL = f"""
WITH c AS (
  SELECT j.*, t.status AS task_status, t.ts AS task_ts, t.exception, t.traceback AS task_tb,
         w.status AS worker_status, l.live_status,
         CASE WHEN regexp_full_match(trim(j.time_limit), '-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][-+]?[0-9]+)?')
              THEN CAST(trim(j.time_limit) AS DOUBLE) END AS lim,
         (epoch_us({EV_AS_OF}) - epoch_us(j.time_start)) / 1e6 AS duration
  FROM jobs_current j
  LEFT JOIN task_latest t ON t.uuid = j.uuid
  LEFT JOIN worker_latest w ON w.celery_hostname = j.celery_hostname
  LEFT JOIN live l ON l.uuid = j.uuid
  WHERE j.status IN ('job-started', 'job-offline') AND j.ts < {EV_AS_OF} - INTERVAL 3600 SECOND),
d AS (
  SELECT *,
    CASE WHEN status = 'job-started' AND task_status = 'task-failed' THEN 'job-failed'
         WHEN status = 'job-started' AND ((worker_status IS NULL AND duration > lim)
              OR worker_status = 'worker-offline') THEN 'job-offline'
         ELSE status END AS ns,
    status = 'job-started' AND task_status = 'task-failed' AND task_ts IS NOT NULL
         AND (epoch_us({EV_AS_OF}) - epoch_us(task_ts)) / 1e6 < 300 AS deferred,
    NOT list_contains(tags, 'timedout') AS untagged,
    coalesce(live_status IN {TERMINAL_SQL}, false) AS live_term
  FROM c),
e AS (
  SELECT *,
    CASE WHEN status IS NULL OR uuid IS NULL OR celery_hostname IS NULL OR time_start IS NULL OR lim IS NULL THEN 'skipped'
         WHEN deferred THEN 'deferred'
         WHEN ns <> status AND live_term THEN 'declined'
         WHEN ns <> status THEN 'update'
         WHEN untagged AND duration > lim AND live_term THEN 'declined'
         WHEN untagged AND duration > lim THEN 'tag'
         ELSE 'none' END AS action
  FROM d)
SELECT payload_id, uuid, status, celery_hostname, action,
       CASE WHEN action = 'update' THEN ns END AS new_status,
       CAST(to_json(CASE WHEN (action = 'update' AND duration > lim AND untagged) OR action = 'tag'
            THEN list_append(tags, 'timedout') ELSE tags END) AS VARCHAR) AS new_tags,
       CASE WHEN action = 'update' AND status = 'job-started' AND task_status = 'task-failed'
            THEN coalesce(exception, 'undetermined by watchdog') END AS error,
       CASE WHEN action = 'update' AND status = 'job-started' AND task_status = 'task-failed'
            THEN CASE WHEN length(coalesce(exception, 'undetermined by watchdog')) > 35
                      THEN left(coalesce(exception, 'undetermined by watchdog'), 20) || '.....' || right(coalesce(exception, 'undetermined by watchdog'), 10)
                      ELSE coalesce(exception, 'undetermined by watchdog') END END AS short_error,
       CASE WHEN action = 'update' AND status = 'job-started' AND task_status = 'task-failed'
            THEN coalesce(task_tb, 'undetermined by watchdog') END AS traceback,
       coalesce(action = 'declined' AND live_status <> status, false) AS divergence,
       duration
FROM e"""


def _j3(spark, sf):
    ev_tasks = A.task_events(spark, sf)
    # task hosts carry the broker's host form; the job docs carry the bare name
    return S.reconcile_timeouts(
        jobs_with_live(spark, sf), ev_tasks, A.worker_events(spark, sf), EV_AS_OF_PY, timeout=3600, grace=300,
    )


@register("j3_reconcile_timeouts", with_adapters(J3_SQL), bench=True)
def j3_reconcile_timeouts(spark, sf):
    """The job watchdog's decision for every old started/offline job."""
    return _j3(spark, sf)


@register(
    "a12_divergence_count",
    with_adapters(f"WITH j3 AS ({J3_SQL}) SELECT CAST(count(*) FILTER (WHERE divergence) AS BIGINT) AS divergence_count FROM j3"),
)
def a12_divergence_count(spark, sf):
    """Per-sweep divergence count of the J3 decisions."""
    return S.divergence_count(_j3(spark, sf))


# ---------------------------------------------------------------- J4 -----


@register(
    "j4_reconcile_orphans",
    with_adapters(f"""
SELECT j.payload_id, j.uuid, j.status, t.status AS task_status,
  CASE WHEN t.status IN ('task-sent', 'task-started') THEN 'keep'
       WHEN t.status IS NOT NULL AND t.status NOT IN ('task-failed', 'task-succeeded') THEN 'report'
       WHEN coalesce(l.live_status IN {TERMINAL_SQL}, false) THEN 'declined'
       ELSE 'update' END AS action,
  CASE WHEN t.status IN ('task-sent', 'task-started') THEN NULL
       WHEN t.status IS NOT NULL AND t.status NOT IN ('task-failed', 'task-succeeded') THEN NULL
       WHEN coalesce(l.live_status IN {TERMINAL_SQL}, false) THEN NULL
       WHEN t.status = 'task-failed' THEN 'job-failed'
       WHEN t.status = 'task-succeeded' THEN 'job-completed'
       ELSE 'job-offline' END AS new_status
FROM jobs_current j LEFT JOIN (
  SELECT uuid, CASE seq % 6 WHEN 1 THEN 'task-failed' WHEN 2 THEN 'task-succeeded' WHEN 3 THEN 'task-retried' ELSE status END AS status
  FROM task_latest) t ON t.uuid = j.uuid AND j.seq % 5 <> 0 LEFT JOIN live l ON l.uuid = j.uuid
WHERE j.status IN ('job-started', 'job-queued')"""),
)
def j4_reconcile_orphans(spark, sf):
    """queued/started jobs reconciled with their latest task state.  The
    adapted tasks mirror their jobs; here they end in every state, and some
    jobs are known by an id that no task has."""
    t, k = A.task_events(spark, sf), F.col("seq") % 6
    status = F.when(k == 1, "task-failed").when(k == 2, "task-succeeded").when(k == 3, "task-retried").otherwise(F.col("status"))
    jobs = jobs_with_live(spark, sf).withColumn("uuid", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("lost-"), "uuid")).otherwise(F.col("uuid")))
    out = S.reconcile_orphans(jobs, t.withColumn("status", status))
    return out.withColumn("uuid", F.regexp_replace("uuid", "^lost-", ""))


# ---------------------------------------------------------------- J5 -----


@register(
    "j5_offline_jobs",
    with_adapters("""
WITH off AS (SELECT celery_hostname, max(ts) AS offline_at FROM worker_events
             WHERE status = 'worker-offline' GROUP BY celery_hostname)
SELECT j.payload_id, j.uuid, j.celery_hostname, 'job-offline' AS new_status,
       'Received worker-offline event during job execution.' AS error, 'worker-offline' AS short_error,
       off.offline_at AS time_end
FROM jobs_current j JOIN off USING (celery_hostname)
WHERE j.status = 'job-started' AND off.offline_at >= j.ts"""),
)
def j5_offline_jobs(spark, sf):
    """Started jobs on workers that went offline after the job's last write."""
    return S.offline_jobs(A.worker_events(spark, sf), jobs_current(spark, sf))


@register("j5_offline_jobs_live", with_adapters(f"""
WITH off AS (SELECT celery_hostname, max(ts) AS offline_at FROM worker_events WHERE status = 'worker-offline' GROUP BY celery_hostname)
SELECT j.payload_id, j.uuid, j.celery_hostname, 'job-offline' AS new_status,
       'Received worker-offline event during job execution.' AS error, 'worker-offline' AS short_error, off.offline_at AS time_end
FROM jobs_current j JOIN off USING (celery_hostname) JOIN live l ON l.uuid = j.uuid
WHERE j.status = 'job-started' AND off.offline_at >= j.ts AND l.live_status = 'job-started' AND j.seq % 3 <> 0"""))
def j5_offline_jobs_live(spark, sf):
    """J5 with the live status and the task's own worker, which must still agree;
    a third of the adapted tasks has moved to another worker."""
    jobs = jobs_current(spark, sf)
    at = jobs.select("uuid", F.when(F.col("seq") % 3 == 0, "elsewhere").otherwise(F.col("celery_hostname")).alias("worker"))
    return S.offline_jobs(A.worker_events(spark, sf), jobs, live_status(spark, sf), at)


# ---------------------------------------------------------------- J6 -----

J6_SQL = f"""
WITH f AS (
  SELECT uuid, ts, seq, exception, traceback,
         nullif(regexp_extract(coalesce(exception, ''), '(^|[^A-Za-z])(WorkerLostError|TimeLimitExceeded|ConnectionError)', 2), '') AS cls
  FROM task_events WHERE status = 'task-failed'),
n AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ts DESC, seq DESC) AS rn FROM f WHERE cls IS NOT NULL)
  WHERE rn = 1)
SELECT j.payload_id, j.uuid, 'job-failed' AS new_status, n.exception AS error, n.cls AS short_error,
       coalesce(n.traceback, '') AS traceback, n.ts AS time_end
FROM jobs_current j JOIN n ON n.uuid = j.uuid
WHERE j.status IN ('job-started', 'job-queued')"""


@register("j6_fail_jobs", with_adapters(J6_SQL))
def j6_fail_jobs(spark, sf):
    """Supervisory task failures applied to queued/started jobs (the
    finalised guard is J10, registered on its own)."""
    return S.fail_jobs(A.task_events(spark, sf), jobs_current(spark, sf))


@register(
    "p11_failure_class",
    with_adapters("""
SELECT uuid, seq, exception,
       nullif(regexp_extract(coalesce(exception, ''), '(^|[^A-Za-z])(WorkerLostError|TimeLimitExceeded|ConnectionError)', 2), '') AS failure_class
FROM task_events WHERE status = 'task-failed'"""),
)
def p11_failure_class(spark, sf):
    """Supervisory failure class of every task failure."""
    from jobscope.functions.columns import failure_class

    t = A.task_events(spark, sf).filter(F.col("status") == "task-failed")
    return t.select("uuid", "seq", F.col("event.exception").alias("exception"),
                    failure_class(F.col("event.exception")).alias("failure_class"))


# ---------------------------------------------------------------- J10/J11 -


@register(
    "j10_drop_finalized",
    with_adapters(f"""
SELECT payload_id, uuid, status FROM jobs_current
WHERE status IN ('job-started', 'job-queued')
  AND uuid NOT IN (SELECT uuid FROM live WHERE live_status IN {TERMINAL_SQL})"""),
)
def j10_drop_finalized(spark, sf):
    """Candidate supervisory rewrites (live jobs) minus finalised jobs."""
    upd = jobs_current(spark, sf).filter(F.col("status").isin("job-started", "job-queued")).select("payload_id", "uuid", "status")
    return S.drop_finalized(upd, live_status(spark, sf))


@register(
    "j11_divergence",
    with_adapters(f"""
SELECT j.payload_id, j.uuid, j.status AS stored_status, l.live_status
FROM jobs_current j JOIN live l ON l.uuid = j.uuid
WHERE l.live_status IN {TERMINAL_SQL} AND j.status <> l.live_status"""),
)
def j11_divergence(spark, sf):
    """Jobs whose stored (last-write) status diverges from the terminal
    live status."""
    return S.divergence(jobs_with_live(spark, sf))


# ---------------------------------------------------------------- J12 ----

SERVED_CUTOFF = "2024-01-25 00:00:00"


@register(
    "j12_settled",
    with_adapters(f"""
WITH src AS (SELECT payload_id AS key, max(seq) AS latest_version FROM job_events GROUP BY 1),
srv AS (SELECT payload_id AS key, max(seq) AS served_version FROM job_events
        WHERE ts < TIMESTAMP '{SERVED_CUTOFF}' GROUP BY 1)
SELECT src.key, src.latest_version, srv.served_version,
  CASE WHEN srv.key IS NULL THEN 'missing'
       WHEN srv.served_version IS NULL OR src.latest_version IS NULL THEN 'settled'
       WHEN srv.served_version < src.latest_version THEN 'stale' ELSE 'settled' END AS state
FROM src LEFT JOIN srv USING (key)"""),
)
def j12_settled(spark, sf):
    """Freshness of a served copy (writes before a cutoff) against the log."""
    ev = A.job_events(spark, sf).select(F.col("payload_id").alias("key"), F.col("seq").alias("version"), "ts")
    served = ev.filter(F.col("ts") < F.lit(SERVED_CUTOFF).cast("timestamp"))
    return S.settled(served.drop("ts"), ev.drop("ts"), "key", "version")


# ---------------------------------------------------------------- J18/J19 -


@register(
    "j18_redelivery_duplicates",
    with_adapters("""
WITH d AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS uuid, event_id, value > 25 AS redelivered
           FROM events WHERE event_type = 'click'),
tw AS (SELECT uuid, celery_hostname AS worker FROM jobs_current),
alive AS (SELECT celery_hostname AS worker FROM worker_latest WHERE status <> 'worker-offline')
SELECT d.uuid, d.event_id, d.redelivered, l.live_status,
       coalesce(d.redelivered AND (l.live_status = 'job-completed'
                OR (l.live_status = 'job-started' AND alive.worker IS NOT NULL)), false) AS duplicate
FROM d LEFT JOIN live l ON l.uuid = d.uuid LEFT JOIN tw ON tw.uuid = d.uuid LEFT JOIN alive ON alive.worker = tw.worker"""),
)
def j18_redelivery_duplicates(spark, sf):
    """Redelivered task messages that duplicate a completed job or one
    still running on a live worker."""
    ev = A.table(spark, sf, "events").filter(F.col("event_type") == "click")
    deliveries = ev.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")).alias("uuid"),
        "event_id", (F.col("value") > 25).alias("redelivered"),
    )
    tw = jobs_current(spark, sf).select("uuid", F.col("celery_hostname").alias("worker"))
    alive = S.latest_workers(A.worker_events(spark, sf)).filter(F.col("status") != "worker-offline").select("celery_hostname")
    out = S.redelivery_duplicates(deliveries, live_status(spark, sf), tw, alive)
    return out.select("uuid", "event_id", "redelivered", "live_status", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


@register(
    "j19_dead_node_jobs",
    with_adapters(f"""
SELECT payload_id, uuid, celery_hostname, status FROM jobs_current j
WHERE status = 'job-started' AND celery_hostname NOT IN (
  SELECT celery_hostname FROM worker_events
  WHERE ts <= {EV_AS_OF} AND ts >= {EV_AS_OF} - INTERVAL 1800 SECOND)"""),
)
def j19_dead_node_jobs(spark, sf):
    """Started jobs on nodes without a heartbeat in the last 30 minutes."""
    j = jobs_current(spark, sf).select("payload_id", "uuid", "celery_hostname", "status")
    return S.dead_node_jobs(j, A.worker_events(spark, sf), EV_AS_OF_PY, alive_secs=1800)


# ---------------------------------------------------------------- W3-W6 --


@register("w3_job_drain", with_adapters("""
WITH RECURSIVE ev AS (
  SELECT celery_hostname AS host, status = 'job-failed' AS failed, ts, seq,
         row_number() OVER (PARTITION BY celery_hostname ORDER BY ts, seq) AS rn
  FROM job_events WHERE status IN ('job-failed', 'job-completed', 'job-deduped')),
r AS (
  SELECT host, ts, seq, rn, failed, CAST(failed AS BIGINT) AS c, ts AS start, false AS drain, 1 AS run FROM ev WHERE rn = 1
  UNION ALL
  SELECT host, ts, seq, rn, failed, c, start,
         c > 3 AND (ts = start OR c / ((epoch_us(ts) - epoch_us(start)) / 1e6) >= 3 / 3600.0), run
  FROM (SELECT e.host, e.ts, e.seq, e.rn, e.failed, r.run + CAST(NOT e.failed AS INTEGER) AS run,
               CASE WHEN NOT e.failed THEN 0 WHEN r.drain THEN 1 ELSE r.c + 1 END AS c,
               CASE WHEN r.drain OR r.c = 0 THEN e.ts ELSE r.start END AS start
        FROM r JOIN ev e ON e.host = r.host AND e.rn = r.rn + 1))
SELECT host AS celery_hostname, CAST(run AS BIGINT) AS run, ts, seq, c AS "count", drain FROM r WHERE failed"""))
def w3_job_drain(spark, sf):
    """Contiguous failure counts and drain flags per worker (drain after
    more than 3 failures at >= 3 per hour)."""
    ev = A.job_events(spark, sf).select("celery_hostname", "status", "ts", "seq")
    return S.job_drain(ev, threshold=3, window_secs=3600.0)


@register(
    "w4_idle_hosts",
    with_adapters(f"""
SELECT 'c' || custkey AS celery_hostname, bool_or(time_end IS NULL) AS running, max(time_end) AS last_done,
       (epoch_us({ORD_AS_OF}) - epoch_us(max(time_end))) / 1e6 AS idle_secs,
       CASE WHEN bool_or(time_end IS NULL) THEN false
            WHEN max(time_end) IS NOT NULL THEN (epoch_us({ORD_AS_OF}) - epoch_us(max(time_end))) / 1e6 > 600
            ELSE false END AS idle
FROM jobs GROUP BY custkey"""),
)
def w4_idle_hosts(spark, sf):
    """Idle hosts (no unfinished job, newest finish older than 600 s); a
    customer's jobs are a host's."""
    j = A.jobs(spark, sf).select(F.concat(F.lit("c"), F.col("custkey").cast("string")).alias("celery_hostname"), "time_end")
    return S.idle_hosts(j, ORD_AS_OF_PY, inactivity=600)


@register(
    "w5_flag_changes",
    with_adapters("""
SELECT celery_hostname, ts, seq, offline, CASE WHEN offline THEN 'set' ELSE 'unset' END AS change FROM (
  SELECT celery_hostname, ts, seq, status = 'worker-offline' AS offline,
         lag(status = 'worker-offline') OVER (PARTITION BY celery_hostname ORDER BY ts, seq) AS prev,
         row_number() OVER (PARTITION BY celery_hostname ORDER BY ts, seq) AS rn
  FROM worker_events)
WHERE rn = 1 OR prev <> offline"""),
)
def w5_flag_changes(spark, sf):
    """Per worker, the moments its offline flag flips."""
    w = A.worker_events(spark, sf).select("celery_hostname", "ts", "seq", (F.col("status") == "worker-offline").alias("offline"))
    return S.flag_changes(w, "celery_hostname", ["ts", "seq"], "offline")


LEASE_AS_OF = "2024-01-30 23:00:00"


@register(
    "w6_lease_staleness",
    with_adapters(f"""
WITH l AS (
  SELECT payload_id, true AS lock_exists, CASE WHEN max(seq) % 9 > 0 THEN epoch_us(TIMESTAMP '{LEASE_AS_OF}') / 1e6 - max(seq) % 120 END AS last_renewed_at
  FROM job_events WHERE ts <= TIMESTAMP '{LEASE_AS_OF}' GROUP BY payload_id),
a AS (SELECT *, epoch_us(TIMESTAMP '{LEASE_AS_OF}') / 1e6 - last_renewed_at AS age FROM l)
SELECT payload_id, lock_exists, last_renewed_at, age,
  CASE WHEN last_renewed_at IS NULL OR age >= 90 THEN NULL
       WHEN age < 30 THEN (30 - age) + 60 + 10 ELSE (90 - age) + 10 END AS observe_secs,
  CASE WHEN last_renewed_at IS NULL OR age >= 90 THEN 'stale' ELSE 'observe' END AS state
FROM a"""),
)
def w6_lease_staleness(spark, sf):
    """Lease state of every job's lock; renewals of the adapted data lie up to two minutes back."""
    ev = A.job_events(spark, sf).filter(F.col("ts") <= F.lit(LEASE_AS_OF).cast("timestamp"))
    leases = ev.groupBy("payload_id").agg(
        F.lit(True).alias("lock_exists"),
        F.when(F.max("seq") % 9 > 0, F.unix_micros(F.lit(LEASE_AS_OF).cast("timestamp")) / 1e6 - F.max("seq") % 120).alias("last_renewed_at"),
    )
    return S.lease_staleness(leases, LEASE_AS_OF)


# ---------------------------------------------------------------- R3 -----


@register(
    "r3_tag_timed_out",
    with_adapters(f"""
SELECT payload_id, status, ts, CAST(to_json(list_append(tags, 'timedout')) AS VARCHAR) AS tags FROM jobs_current
WHERE status IN ('job-started', 'job-offline') AND ts < {EV_AS_OF} - INTERVAL 86400 SECOND
  AND NOT list_contains(tags, 'timedout')"""),
)
def r3_tag_timed_out(spark, sf):
    """started/offline jobs idle for a day, tagged ``timedout`` once."""
    j = jobs_current(spark, sf).select("payload_id", "status", "ts", "tags")
    return S.tag_timed_out(j, ["job-started", "job-offline"], 86400, EV_AS_OF_PY)
