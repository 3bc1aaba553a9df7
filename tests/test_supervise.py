"""Decision tables of the supervisors (job watchdog, freshness, leases, drain)."""

import random
from datetime import datetime, timedelta

from jobscope.operators import supervise as S

AS_OF = "2024-01-10 12:00:00"
NOW = datetime(2024, 1, 10, 12, 0, 0)


def ts(secs_ago):
    return NOW - timedelta(seconds=secs_ago)


JOBS = "payload_id string, uuid string, status string, tags array<string>, celery_hostname string, time_limit string, time_start timestamp, ts timestamp"
TASKS = "uuid string, status string, ts timestamp, seq bigint, exception string, traceback string"
WORKERS = "celery_hostname string, status string, tags array<string>, ts timestamp, seq bigint"


def decide(spark, jobs, tasks=(), workers=(), live=None, grace=300):
    j = spark.createDataFrame(jobs, JOBS)
    t = spark.createDataFrame(list(tasks), TASKS)
    w = spark.createDataFrame(list(workers), WORKERS)
    lv = spark.createDataFrame(live, "uuid string, live_status string") if live is not None else None
    out = S.reconcile_timeouts(j, t, w, AS_OF, timeout=600, grace=grace, live=lv)
    return {r.payload_id: r for r in out.collect()}


def job(pid, status="job-started", limit="600", start=3600, tags=(), host="h1"):
    return (pid, pid, status, list(tags), host, limit, ts(start), ts(3000))


def test_timeouts_decision_table(spark):
    jobs = [
        job("offline_no_worker"),                       # no worker row, over limit -> offline
        job("within_limit", limit="100000"),            # not over, worker alive -> none
        job("worker_lost", limit="100000", host="h2"),  # worker offline -> offline
        job("grace", host="h1"),                        # task failed 30 s ago -> deferred
        job("failed_old", host="h1"),                   # task failed 600 s ago -> failed
        job("partial_limit", limit=None),               # skipped
        job("non_numeric", limit='"600"'),              # quoted number is text -> skipped
        job("bool_limit", limit="true"),                # skipped
        job("offline_untagged", status="job-offline"),  # tag
        job("offline_tagged", status="job-offline", tags=["timedout"]),  # none
        job("finalized", host="h1"),                    # would change, live terminal -> declined
    ]
    tasks = [("grace", "task-failed", ts(30), 1, "WorkerLostError()", "tb"),
             ("failed_old", "task-failed", ts(600), 2, "TimeLimitExceeded(3600,)", "tb2"),
             ("finalized", "task-failed", ts(900), 3, None, None)]
    workers = [("h1", "worker-heartbeat", [], ts(10), 1), ("h2", "worker-offline", [], ts(10), 2)]
    live = [("finalized", "job-completed")]
    got = decide(spark, [j for j in jobs if j[0] != "offline_no_worker"], tasks, workers, live)
    got.update(decide(spark, [jobs[0]], tasks, []))
    assert got["offline_no_worker"].action == "update" and got["offline_no_worker"].new_status == "job-offline"
    assert "timedout" in got["offline_no_worker"].new_tags
    assert got["within_limit"].action == "none"
    assert got["worker_lost"].new_status == "job-offline" and "timedout" not in got["worker_lost"].new_tags
    assert got["grace"].action == "deferred" and got["grace"].new_status is None
    r = got["failed_old"]
    assert r.action == "update" and r.new_status == "job-failed" and r.error == "TimeLimitExceeded(3600,)"
    assert r.traceback == "tb2"
    for k in ("partial_limit", "non_numeric", "bool_limit"):
        assert got[k].action == "skipped", k
    assert got["offline_untagged"].action == "tag" and got["offline_untagged"].new_tags == ["timedout"]
    assert got["offline_tagged"].action == "none"
    f = got["finalized"]
    assert f.action == "declined" and f.divergence is True and f.new_status is None


def test_missing_task_time_does_not_defer(spark):
    got = decide(spark, [job("j")], [("j", "task-failed", None, 1, None, None)], [("h1", "worker-heartbeat", [], ts(5), 1)])
    assert got["j"].action == "update" and got["j"].error == "undetermined by watchdog"


def test_settled_truth_table(spark):
    served = spark.createDataFrame([("a", 7), ("b", 5), ("d", None)], "key string, version bigint")
    source = spark.createDataFrame([("a", 7), ("b", 7), ("c", 1), ("d", None)], "key string, version bigint")
    got = {r.key: r.state for r in S.settled(served, source).collect()}
    assert got == {"a": "settled", "b": "stale", "c": "missing", "d": "settled"}


def test_lease_staleness(spark):
    now = NOW.timestamp()
    rows = [("none", True, None, None), ("old", True, now - 120, None), ("fresh", True, now - 10, None),
            ("mid", True, now - 45, None), ("renewed", True, now - 10, now - 1), ("silent", True, now - 10, now - 10)]
    df = spark.createDataFrame(rows, "payload_id string, lock_exists boolean, last_renewed_at double, renewed_after double")
    got = {r.payload_id: r for r in S.lease_staleness(df, AS_OF).collect()}
    assert got["none"].state == "stale" and got["old"].state == "stale"
    assert got["fresh"].state == "alive" or got["fresh"].state == "observe"
    assert abs(got["mid"].observe_secs - ((90 - 45) + 10)) < 1e-6
    assert got["renewed"].state == "alive" and got["silent"].state == "stale"
    assert abs(got["renewed"].observe_secs - ((30 - 10) + 60 + 10)) < 1e-6


def brute_drain(events, threshold, window):
    out = {}
    rate = threshold / window
    by_host = {}
    for e in sorted(events, key=lambda e: (e[0], e[2], e[3])):
        by_host.setdefault(e[0], []).append(e)
    for h, evs in by_host.items():
        count, start = 0, 0.0
        for host, status, t, seq in evs:
            if status in ("job-completed", "job-deduped"):
                count = 0
                continue
            if status != "job-failed":
                continue
            tt = t.timestamp()
            if count == 0:
                count, start = 1, tt
            else:
                count += 1
            diff = tt - start
            drain = count > threshold and (diff <= 0 or count / diff >= rate)
            out[seq] = (count, drain)
            if drain:
                count = 0
    return out


def test_job_drain_matches_brute_force(spark):
    rnd = random.Random(7)
    events, t, seq = [], datetime(2024, 1, 1), 0
    for _ in range(600):
        seq += 1
        t += timedelta(seconds=rnd.choice([0.05, 0.1, 0.2, 0.3, 2]))
        st = "job-failed" if rnd.random() < 0.97 else rnd.choice(["job-completed", "job-deduped", "job-started"])
        events.append((rnd.choice(["h1", "h2"]), st, t, seq))
    df = spark.createDataFrame(events, "celery_hostname string, status string, ts timestamp, seq bigint")
    got = {r.seq: (r["count"], r.drain) for r in S.job_drain(df, threshold=4, window_secs=5.0).collect()}
    want = brute_drain(events, 4, 5.0)
    assert got == want
    assert sum(d for _, d in want.values()) >= 2  # several drains, so restarts are exercised


def test_fail_jobs_and_finalized_guard(spark):
    jobs = spark.createDataFrame([("j1", "j1", "job-started"), ("j2", "j2", "job-completed"), ("j3", "j3", "job-queued")],
                                 "payload_id string, uuid string, status string")
    tasks = spark.createDataFrame([("j1", "task-failed", ts(5), 1, "WorkerLostError()", "tb"),
                                   ("j2", "task-failed", ts(5), 2, "WorkerLostError()", "tb"),
                                   ("j3", "task-failed", ts(5), 3, "SoftTimeLimitExceeded()", "tb")], TASKS)
    live = spark.createDataFrame([("j1", "job-failed")], "uuid string, live_status string")
    assert [r.uuid for r in S.fail_jobs(tasks, jobs).collect()] == ["j1"]
    assert S.fail_jobs(tasks, jobs, live=live).count() == 0
