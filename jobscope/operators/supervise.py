"""Supervision: timeouts, orphans, offline workers, failures, divergence,
drain, idle hosts, leases (J3-J6, J10-J12, J18, J19, W3-W6, R3).

The reference runs these as sweeps that issue two follow-up lookups per job.
Here the lookups are decorrelated into joins against *latest rows* (one row
per task / worker, computed with partial aggregation), so a sweep over any
number of jobs is a fixed number of shuffles.  The decision tables are one
ordered ``when`` chain each; every row gets exactly one ``action``.

"Live" status (the authoritative, synchronously written job status the
reference keeps in a key-value store) is an optional input with columns
``uuid, live_status``; it is usually the guarded current state (A2) of the
log.  Where one aggregation gives both (``jobs`` has a ``live_status`` column)
no join is made.  Without either no write is declined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope import TERMINAL_JOB_STATUSES
from jobscope.functions.columns import failure_class, numeric_limit, short_error
from jobscope.functions.predicates import older_than
from jobscope.operators.drain import job_drain  # noqa: F401
from jobscope.operators.ranges import neighbour
from jobscope.operators.state import current_state

UNDETERMINED = "undetermined by watchdog"
TIMEDOUT = "timedout"


def _secs(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def _as_of(as_of) -> Column:
    return F.lit(as_of).cast("timestamp")


def _terminal(c: Column) -> Column:
    return c.isin(*TERMINAL_JOB_STATUSES)


def _with_live(df: DataFrame, live: DataFrame | None) -> DataFrame:
    """``df`` with ``live_status``: its own, else that of ``live`` by uuid, else null."""
    if live is not None:
        return df.drop("live_status").join(live.select("uuid", "live_status"), "uuid", "left")
    return df if "live_status" in df.columns else df.withColumn("live_status", F.lit(None).cast("string"))


def latest_tasks(tasks: DataFrame) -> DataFrame:
    """Newest task event per task id, flattened (status, ts, exception, traceback)."""
    t = tasks.select(
        "uuid", "status", "ts", "seq",
        F.col("event.exception").alias("exception") if "event" in tasks.columns else F.col("exception"),
        F.col("event.traceback").alias("traceback") if "event" in tasks.columns else F.col("traceback"),
    )
    return current_state(t, "uuid")


def latest_workers(workers: DataFrame) -> DataFrame:
    w = workers.select("celery_hostname", "status", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "ts", "seq")
    return current_state(w, "celery_hostname")


# ------------------------------------------------------------------ J3 ----


def reconcile_timeouts(jobs: DataFrame, tasks: DataFrame, workers: DataFrame, as_of,
                       timeout: float = 86400, grace: float = 300, live: DataFrame | None = None) -> DataFrame:
    """Decide every old started/offline job's fate.

    ``jobs`` (current docs): payload_id, uuid, status, tags, celery_hostname,
    time_limit (number or text), time_start (TIMESTAMP), ts.
    Returns one row per candidate with ``action`` in skipped / deferred /
    update / tag / declined / none, the new status and tags, error fields,
    and ``divergence`` (live terminal status differs from the stored one).
    """
    now = _as_of(as_of)
    cand = jobs.filter(F.col("status").isin("job-started", "job-offline") & older_than("ts", timeout, as_of))
    lt = latest_tasks(tasks).select(
        "uuid", F.col("status").alias("task_status"), F.col("ts").alias("task_ts"), "exception", "traceback"
    )
    lw = latest_workers(workers).select(
        "celery_hostname", F.col("status").alias("worker_status"), F.col("tags").alias("worker_tags")
    )
    df = cand.join(lt, "uuid", "left").join(lw, "celery_hostname", "left")
    df = _with_live(df, live)

    limit = numeric_limit(F.col("time_limit"))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    duration = _secs(now, F.col("time_start"))
    over = duration > limit
    started = F.col("status") == "job-started"
    has_worker = F.col("worker_status").isNotNull()
    worker_lost = has_worker & (
        F.array_contains(F.coalesce("worker_tags", F.array().cast("array<string>")), TIMEDOUT)
        | (F.col("worker_status") == "worker-offline")
    )
    task_failed = F.col("task_status") == "task-failed"
    task_age = _secs(now, F.col("task_ts"))
    deferred = started & task_failed & F.col("task_ts").isNotNull() & (task_age < grace)
    new_status = (
        F.when(started & task_failed, F.lit("job-failed"))
        .when(started & ((~has_worker & over) | worker_lost), F.lit("job-offline"))
        .otherwise(F.col("status"))
    )
    partial = (
        F.col("status").isNull() | F.col("uuid").isNull() | F.col("celery_hostname").isNull()
        | F.col("time_start").isNull() | limit.isNull()
    )
    changes = new_status != F.col("status")
    live_term = _terminal(F.coalesce(F.col("live_status"), F.lit("")))
    untagged = ~F.array_contains(tags, TIMEDOUT)
    action = (
        F.when(partial, "skipped")
        .when(deferred, "deferred")
        .when(changes & live_term, "declined")
        .when(changes, "update")
        .when(untagged & over & live_term, "declined")
        .when(untagged & over, "tag")
        .otherwise("none")
    )
    add_tag = (action.isin("update") & over & untagged) | (action == "tag")
    err = F.when(started & task_failed & ~deferred, F.coalesce(F.col("exception"), F.lit(UNDETERMINED)))
    out = df.select(
        "payload_id", "uuid", "status", "celery_hostname",
        action.alias("action"),
        F.when(action == "update", new_status).alias("new_status"),
        F.when(add_tag, F.array_append(tags, F.lit(TIMEDOUT))).otherwise(tags).alias("new_tags"),
        F.when(action == "update", err).alias("error"),
        F.when(action == "update", short_error(err)).alias("short_error"),
        F.when(action == "update", F.when(err.isNotNull(), F.coalesce(F.col("traceback"), F.lit(UNDETERMINED)))).alias("traceback"),
        ((action == "declined") & (F.col("live_status") != F.col("status"))).alias("divergence"),
        duration.alias("duration"),
    )
    return out


def divergence_count(decisions: DataFrame) -> DataFrame:
    """The per-sweep health count (declined writes whose live status differs)."""
    return decisions.agg(F.count_if(F.col("divergence")).alias("divergence_count"))


# ------------------------------------------------------------------ J4 ----


def reconcile_orphans(jobs: DataFrame, tasks: DataFrame, task_meta: DataFrame | None = None,
                      live: DataFrame | None = None) -> DataFrame:
    """queued/started jobs against their task's state.

    task-failed -> job-failed; task-succeeded -> job-completed; task-sent or
    task-started -> keep; any other task state -> report; no task event and no
    task metadata -> job-offline.  A job the live status shows finalised is
    never rewritten (``declined``).
    """
    cand = jobs.filter(F.col("status").isin("job-started", "job-queued"))
    lt = latest_tasks(tasks).select("uuid", F.col("status").alias("task_status"))
    df = cand.join(lt, "uuid", "left")
    if task_meta is not None:
        df = df.join(task_meta.select("uuid").distinct().withColumn("has_meta", F.lit(True)), "uuid", "left")
    else:
        df = df.withColumn("has_meta", F.lit(None).cast("boolean"))
    df = _with_live(df, live)
    ts_ = F.col("task_status")
    target = (
        F.when(ts_ == "task-failed", "job-failed")
        .when(ts_ == "task-succeeded", "job-completed")
        .when(ts_.isNull() & ~F.coalesce(F.col("has_meta"), F.lit(False)), "job-offline")
    )
    live_term = _terminal(F.coalesce(F.col("live_status"), F.lit("")))
    action = (
        F.when(ts_.isin("task-sent", "task-started"), "keep")
        .when(ts_.isNotNull() & target.isNull(), "report")
        .when(target.isNull(), "none")
        .when(live_term, "declined")
        .otherwise("update")
    )
    return df.select(
        "payload_id", "uuid", "status", F.col("task_status"), action.alias("action"),
        F.when(action == "update", target).alias("new_status"),
    )


# ------------------------------------------------------------ J5, J6 ------


def offline_jobs(worker_events: DataFrame, jobs: DataFrame, live: DataFrame | None = None,
                 task_worker: DataFrame | None = None) -> DataFrame:
    """Started jobs on a worker that went offline after the job's last update.

    Offline events are reduced to the newest one per host first (a partial
    aggregate: one row per host), so the join never multiplies jobs by
    events.  With live inputs, a job is offlined only while its live status
    is still job-started and its live worker is still that host.
    """
    off = (
        worker_events.filter(F.col("status") == "worker-offline")
        .groupBy("celery_hostname")
        .agg(F.max("ts").alias("offline_at"))
    )
    df = jobs.filter(F.col("status") == "job-started").join(off, "celery_hostname")
    df = df.filter(F.col("offline_at") >= F.col("ts"))
    if live is not None:
        df = df.join(live.select("uuid", "live_status"), "uuid", "left").filter(F.col("live_status") == "job-started")
    if task_worker is not None:
        df = df.join(task_worker.select("uuid", F.col("worker").alias("live_worker")), "uuid", "left").filter(
            F.col("live_worker") == F.col("celery_hostname")
        )
    return df.select(
        "payload_id", "uuid", "celery_hostname",
        F.lit("job-offline").alias("new_status"),
        F.lit("Received worker-offline event during job execution.").alias("error"),
        F.lit("worker-offline").alias("short_error"),
        F.col("offline_at").alias("time_end"),
    )


def drop_finalized(updates: DataFrame, live: DataFrame, key: str = "uuid") -> DataFrame:
    """Discard supervisory updates for jobs whose live status is
    terminal; jobs with unknown live status pass (fail open)."""
    fin = live.filter(_terminal(F.col("live_status"))).select(F.col("uuid").alias(key))
    return updates.join(fin, key, "left_anti")


def fail_jobs(task_events: DataFrame, jobs: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Supervisory failures applied to queued/started jobs.

    A task-failed event whose exception names WorkerLostError,
    TimeLimitExceeded or ConnectionError (not a soft limit) fails the job:
    error = exception, short error = the class, traceback and end time from
    the event.  Terminal jobs are untouched; with ``live`` the finalised
    guard (J10) applies too.  One row per job: its newest such failure.
    """
    failed = task_events.filter(F.col("status") == "task-failed").select(
        "uuid", "ts", "seq",
        F.col("event.exception").alias("exception") if "event" in task_events.columns else F.col("exception"),
        F.col("event.traceback").alias("traceback") if "event" in task_events.columns else F.col("traceback"),
    )
    failed = failed.withColumn("cls", failure_class(F.col("exception"))).filter(F.col("cls").isNotNull())
    newest = current_state(failed, "uuid")
    df = jobs.filter(F.col("status").isin("job-started", "job-queued")).select("payload_id", "uuid", "status").join(newest, "uuid")
    out = df.select(
        "payload_id", "uuid", F.lit("job-failed").alias("new_status"),
        F.col("exception").alias("error"), F.col("cls").alias("short_error"),
        F.coalesce(F.col("traceback"), F.lit("")).alias("traceback"), F.col("ts").alias("time_end"),
    )
    return drop_finalized(out, live) if live is not None else out


# ------------------------------------------------------------ J11, J12 ----


def divergence(current: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Live status terminal but the stored copy is non-terminal or
    different.  A filter where ``current`` has its ``live_status``."""
    df = _with_live(current, live).select("payload_id", "uuid", F.col("status").alias("stored_status"), "live_status")
    return df.filter(_terminal(F.col("live_status")) & (F.col("stored_status") != F.col("live_status")))


def settled(served: DataFrame, source: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """Is the served copy at least as new as the latest write?

    ``missing``: no served copy; ``stale``: served version older than the
    source's newest; ``settled`` otherwise (an unknown version counts as
    settled).
    """
    src = source.groupBy(key).agg(F.max(version).alias("latest_version"))
    srv = served.groupBy(key).agg(F.max(version).alias("served_version"), F.count(F.lit(1)).alias("_n"))
    df = src.join(srv, key, "left")
    state = (
        F.when(F.col("_n").isNull(), "missing")
        .when(F.col("served_version").isNull() | F.col("latest_version").isNull(), "settled")
        .when(F.col("served_version") < F.col("latest_version"), "stale")
        .otherwise("settled")
    )
    return df.select(key, "latest_version", "served_version", state.alias("state"))


# ------------------------------------------------------------ J18, J19 ----


def redelivery_duplicates(deliveries: DataFrame, live: DataFrame, task_worker: DataFrame | None = None,
                          worker_alive: DataFrame | None = None) -> DataFrame:
    """A redelivered job is a duplicate when it already completed, or it
    is started on a worker that is still alive."""
    df = deliveries.join(live.select("uuid", "live_status"), "uuid", "left")
    alive = F.lit(False)
    if task_worker is not None and worker_alive is not None:
        df = df.join(task_worker.select("uuid", "worker"), "uuid", "left").join(
            worker_alive.select(F.col("celery_hostname").alias("worker"), F.lit(True).alias("_alive")), "worker", "left"
        )
        alive = F.coalesce(F.col("_alive"), F.lit(False))
    red = F.coalesce(F.col("redelivered"), F.lit(False))
    dup = red & ((F.col("live_status") == "job-completed") | ((F.col("live_status") == "job-started") & alive))
    return df.select(*deliveries.columns, "live_status", dup.alias("duplicate"))


def dead_node_jobs(jobs: DataFrame, heartbeats: DataFrame, as_of, alive_secs: float = 60,
                   node: str = "celery_hostname") -> DataFrame:
    """Started jobs on nodes without a heartbeat in the last ``alive_secs``."""
    recent = heartbeats.filter(
        (F.col("ts") <= _as_of(as_of)) & ~older_than("ts", alive_secs, as_of)
    ).select(F.col("celery_hostname").alias(node)).distinct()
    return jobs.filter(F.col("status") == "job-started").join(recent, node, "left_anti")


# ------------------------------------------------------------ W4, W5 ------


def idle_hosts(jobs: DataFrame, as_of, inactivity: float = 600, hosts: DataFrame | None = None,
               host: str = "celery_hostname", done: str = "time_end") -> DataFrame:
    """A host is idle when none of its jobs is unfinished and its newest
    finish is older than ``inactivity``; a watched host with no jobs is idle
    once it has been watched for longer than that (``hosts``: host,
    watch_start)."""
    now = _as_of(as_of)
    per = jobs.groupBy(host).agg(
        F.bool_or(F.col(done).isNull()).alias("running"),
        F.max(done).alias("last_done"),
    )
    if hosts is not None:
        per = hosts.select(host, "watch_start").join(per, host, "full")
    else:
        per = per.withColumn("watch_start", F.lit(None).cast("timestamp"))
    age = _secs(now, F.col("last_done"))
    idle = (
        F.when(F.coalesce(F.col("running"), F.lit(False)), F.lit(False))
        .when(F.col("last_done").isNotNull(), age > inactivity)
        .otherwise(F.coalesce(_secs(now, F.col("watch_start")) > inactivity, F.lit(False)))
    )
    return per.select(host, F.coalesce("running", F.lit(False)).alias("running"), "last_done",
                      age.alias("idle_secs"), idle.alias("idle"))


def flag_changes(df: DataFrame, key: str, order, flag: str, ranges: int | None = None) -> DataFrame:
    """Emit ``set``/``unset`` only when a flag changes (the first
    observation always emits).

    A key's rows may lie in many ranges, whose border rows are exchanged."""
    order = [order] if isinstance(order, str) else list(order)
    out = neighbour(df, key, order, flag, "_prev", ranges=ranges)
    return out.filter(F.col("_prev").isNull() | (F.col("_prev.value") != F.col(flag))).select(
        *df.columns, F.when(F.col(flag), "set").otherwise("unset").alias("change")
    )


# ------------------------------------------------------------------ W6 ----


def lease_staleness(leases: DataFrame, as_of, heartbeat: float = 30, retries: int = 3, buffer: float = 10,
                    max_wait: float | None = None) -> DataFrame:
    """W6, observation form.

    ``leases``: payload_id, lock_exists, last_renewed_at (epoch s), and
    optionally ``renewed_after`` (epoch s of the renewal seen after waiting).
    A lock without lease data is stale; age >= retries*heartbeat is stale;
    otherwise observe for (heartbeat-age) + heartbeat*(retries-1) + buffer
    when age < heartbeat, else (retries*heartbeat - age) + buffer (capped by
    ``max_wait``); a renewal seen meanwhile means alive, none means stale.
    """
    now = F.unix_micros(_as_of(as_of)) / F.lit(1e6)
    age = now - F.col("last_renewed_at")
    wait = F.when(age < heartbeat, (heartbeat - age) + heartbeat * (retries - 1) + buffer).otherwise(
        (retries * heartbeat - age) + buffer
    )
    if max_wait is not None:
        wait = F.least(wait, F.lit(float(max_wait)))
    has_after = "renewed_after" in leases.columns
    renewed = (F.col("renewed_after") > F.col("last_renewed_at")) if has_after else F.lit(None).cast("boolean")
    state = (
        F.when(F.col("last_renewed_at").isNull(), "stale")
        .when(age >= retries * heartbeat, "stale")
        .when(renewed.isNull(), "observe")
        .when(renewed, "alive")
        .otherwise("stale")
    )
    return leases.select(
        *leases.columns, age.alias("age"),
        F.when(state == "observe", wait).when(renewed.isNotNull() & (age < retries * heartbeat), wait).alias("observe_secs"),
        state.alias("state"),
    )


def lease_staleness_direct(leases: DataFrame, as_of, holder_state: str = "task_state", expire: float = 600,
                           grace: float = 120, heartbeat: float = 30) -> DataFrame:
    """W6, direct form: not renewed for > expire -> stale; holder task
    terminal -> stale; running -> alive; unknown: total age < grace -> alive,
    age < 1.2*heartbeat -> alive, else stale."""
    now = F.unix_micros(_as_of(as_of)) / F.lit(1e6)
    age = now - F.coalesce(F.col("last_renewed_at"), F.lit(0.0))
    total = now - F.coalesce(F.col("acquired_at"), F.lit(0.0))
    st = F.upper(F.col(holder_state))
    terminal = st.isin("SUCCESS", "FAILURE", "REVOKED")
    running = st.isin("STARTED", "RETRY", "RECEIVED")
    state = (
        F.when(age > expire, "stale")
        .when(terminal, "stale")
        .when(running, "alive")
        .when(total < grace, "alive")
        .when(age < 1.2 * heartbeat, "alive")
        .otherwise("stale")
    )
    return leases.select(*leases.columns, age.alias("age"), state.alias("state"))


# ------------------------------------------------------------------ R3 ----


def tag_timed_out(df: DataFrame, statuses, seconds: float, as_of, ts: str = "ts", tag: str = TIMEDOUT) -> DataFrame:
    """Rows in ``statuses`` not updated for ``seconds`` that lack the tag,
    with the tag added once (the rows to write back)."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    return (
        df.filter(F.col("status").isin(list(statuses)) & older_than(ts, seconds, as_of) & ~F.array_contains(tags, tag))
        .withColumn("tags", F.array_append(tags, F.lit(tag)))
    )
