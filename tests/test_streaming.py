"""Streams: the rows do not depend on how a log is cut into files."""

import random
import uuid

import pandas as pd
import pytest

from jobscope.streaming import ops as T

JOB = "payload_id string, uuid string, payload_hash string, celery_hostname string, status string, ts timestamp, seq long"
TASK = "uuid string, status string, ts timestamp, event struct<exception:string>"
DAY = pd.Timestamp("2024-01-01")


def at(minutes):
    return (DAY + pd.Timedelta(minutes=minutes)).to_pydatetime()


def log(seed=3, n=240):
    rng = random.Random(seed)
    statuses = ["job-queued", "job-started", "job-completed", "job-failed", "worker-offline", "worker-heartbeat"]
    minute, rows = 0, []
    for i in range(n):
        minute += rng.choice([0, 1, 3, 20, 90])
        p = f"p{rng.randrange(12)}"
        rows.append((p, p, f"h{rng.randrange(4)}", f"w{rng.randrange(3)}", rng.choice(statuses), at(minute), i))
    return rows


def stream(spark, tmp_path, rows, schema, files):
    """The rows as a file stream of ``files`` files in time order, one micro-batch each."""
    d = tmp_path / uuid.uuid4().hex
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(d))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(d))


def run(df, drop=("batch",)):
    out = T.run_available(df, f"t_{uuid.uuid4().hex}")
    return sorted(tuple(r) for r in out.drop(*drop).collect())


STREAMS = {
    "t2": lambda e: T.stream_first_by_hash(e, ttl_secs=7200),
    "t3": lambda e: T.stream_worker_alive(e, ttl_secs=1800),
    "t4": lambda e: T.stream_timeouts(e, 3600),
}


@pytest.mark.parametrize("name", list(STREAMS))
def test_one_file_and_many_give_the_same_rows(spark, tmp_path, name):
    rows = log()
    one = run(STREAMS[name](stream(spark, tmp_path, rows, JOB, 1)))
    many = run(STREAMS[name](stream(spark, tmp_path, rows, JOB, 3)))
    assert one and one == many


def test_submissions_a_day_apart_each_count(spark, tmp_path):
    rows = [(f"p{i}", f"p{i}", "h", "w", "job-queued", at(1440 * i), i) for i in range(5)]
    for files in (1, 5):
        got = run(T.stream_first_by_hash(stream(spark, tmp_path, rows, JOB, files), ttl_secs=86400))
        assert [r[1] for r in got] == ["p0", "p1", "p2", "p3", "p4"]


def test_both_silences_of_a_key_are_seen(spark, tmp_path):
    """A gap inside a batch, and one that the timer ends; a terminal status is not undone."""
    rows = [("a", "a", "h", "w", "job-started", at(0), 0), ("a", "a", "h", "w", "job-started", at(120), 1),
            ("b", "b", "h", "w", "job-completed", at(121), 2), ("b", "b", "h", "w", "job-started", at(122), 3),
            ("c", "c", "h", "w", "job-started", at(600), 4)]
    for files in (1, 5):
        got = run(T.stream_timeouts(stream(spark, tmp_path, rows, JOB, files), 600))
        assert [(r[0], r[2]) for r in got] == [("a", at(0)), ("a", at(120))]


def test_a_finished_job_is_not_failed_by_a_late_task_failure(spark, tmp_path):
    jobs = [("a", "a", "h", "w", "job-completed", at(1), 0), ("x", "x", "h", "w", "job-completed", at(400), 1)]
    tasks = [("a", "task-failed", at(2), ("WorkerLostError('x')",)), ("b", "task-failed", at(3), ("TimeLimitExceeded(1,)",)),
             ("c", "task-failed", at(4), ("ValueError()",)), ("y", "task-succeeded", at(400), (None,))]
    for files in (1, 2):
        got = run(T.stream_failed_tasks(stream(spark, tmp_path, tasks, TASK, files), stream(spark, tmp_path, jobs, JOB, files), 300))
        assert [(r[0], r[2]) for r in got] == [("b", "TimeLimitExceeded")]


def test_metric_logs_are_parsed_as_they_arrive(spark, tmp_path):
    from jobscope.sources import readers as RD

    (tmp_path / "log").mkdir()
    for k in range(2):
        lines = [f"2024-01-02T03:04:0{i}.123456Z,host{k},worker,w1,cpu,'{i}'" for i in range(5)] + ["no time,h,worker,w1,cpu,3"]
        (tmp_path / "log" / f"{k}.fullkv.sdswatch.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "log" / "other.log").write_text("2024-01-02T03:04:05.1Z,h,w,w,cpu,1\n")
    columns = ["host", "metric_key", "metric_value_string", "metric_value_float", "sdswatch_timestamp"]
    want = sorted(tuple(r) for r in RD.read_metric_log(spark, str(tmp_path)).select(*columns).collect())
    got = run(T.stream_metric_log(spark, str(tmp_path)).select(*columns), drop=("batch",))
    assert got == want and len(got) == 10


def test_log_chunks_come_when_the_watermark_has_passed(spark, tmp_path):
    schema = "id string, type string, seq long, ts timestamp, chunk string"
    rows = [("j", "stdout", i, DAY + pd.Timedelta(milliseconds=300 * i), f"c{i}") for i in range(40)]
    rows = [(*r[:3], r[3].to_pydatetime(), r[4]) for r in rows]
    want = sorted((r.id, r.window_start, r.chunk) for r in T.log_chunks(spark.createDataFrame(rows, schema), "1 second").collect())
    for files in (1, 3):
        df = T.log_chunks(stream(spark, tmp_path, rows, schema, files), "1 second", watermark="2 seconds")
        got = sorted((r.id, r.window_start, r.chunk) for r in T.run_available(df, f"t_{uuid.uuid4().hex}").collect())
        assert got == want[: len(got)] and len(got) == 9
