"""Scans over ranges of a key's rows: equal to a scan of the whole key, however the ranges are cut."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from jobscope.operators import drain as D
from jobscope.operators import ops as O
from jobscope.operators import ranges as R
from jobscope.operators import supervise as S
from jobscope.streaming import ops as T

EVENTS = "celery_hostname string, status string, ts timestamp, seq long, pid string"


def brute(events, threshold, window_us, states=None):
    """The decision table row by row, in integers: {seq: (count, drain, run)}."""
    out, states = {}, dict(states or {})
    for host, status, t, seq, pid in sorted(events, key=lambda e: (e[2], e[3])):
        count, start, last, run = states.get(host, (0, 0, "first", 0))
        us = round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
        if status not in ("job-failed", "job-completed", "job-deduped"):
            continue
        if status != "job-failed" or last == "first" or pid != last:
            count, run = 0, run + 1
        if status == "job-failed":
            count, start = (1, us) if count == 0 else (count + 1, start)
            drain = count > threshold and count * window_us >= threshold * (us - start)
            out[seq] = (count, drain, run)
            count = 0 if drain else count
        states[host] = (count, start, pid, run)
    return out


def hot_log(seed, n=900, quiet=0.02):
    """One worker holds most of the log; long runs of failures, bursts and pauses, several process ids."""
    rng = random.Random(seed)
    t, rows = datetime(2024, 1, 1), []
    for i in range(n):
        t += timedelta(milliseconds=rng.choice([300, 900] if (i // 30) % 4 == 0 else [0, 0, 20, 40, 60, 90]))
        host = rng.choice(["hot"] * 8 + ["a", "b", None])
        status = "job-failed" if rng.random() > quiet else rng.choice(["job-completed", "job-deduped", "job-started"])
        rows.append((host, status, t, i, None if (i // 200) % 3 == 2 else f"p{i // 250}"))
    return rows


@pytest.mark.parametrize("seed,ranges,threshold,window,pid", [(1, 1, 4, 2.0, None), (2, 7, 4, 2.0, None), (3, 23, 10, 5.0, "pid"), (4, 60, 3, 1.0, "pid"), (5, 150, 4, 2.0, None)])
def test_drain_over_any_ranges(spark, seed, ranges, threshold, window, pid):
    rows = hot_log(seed, quiet=0.003 if seed % 2 else 0.05)
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    got = {r.seq: (r["count"], r.drain, r.run) for r in S.job_drain(df, threshold, window, pid=pid, ranges=ranges).collect()}
    want = brute(rows if pid else [(*r[:4], None) for r in rows], threshold, round(window * 1e6))
    assert got == want
    assert sum(d for _, d, _ in want.values()) > 3


def test_a_hot_worker_lies_in_many_ranges(spark):
    df = spark.createDataFrame(hot_log(1), EVENTS)
    rows = R.ranged(df, "celery_hostname", ["ts", "seq"], 20)
    per = {(r.celery_hostname, r[R.RANGE]): r["count"] for r in rows.groupBy("celery_hostname", R.RANGE).count().collect()}
    assert len([k for k in per if k[0] == "hot"]) >= 10
    assert max(per.values()) < 0.15 * sum(per.values())


@pytest.mark.parametrize("seed", range(30))
def test_summaries_give_the_state_for_every_state_before(seed):
    """The sum of a run answers for any count and start as a scan of its rows does."""
    rng = np.random.default_rng(seed)
    n, threshold, window = int(rng.integers(1, 60)), int(rng.integers(1, 6)), 1000
    t = np.cumsum(rng.choice([0, 50, 200, 600], n)) + 5000
    run = D.Run(t, threshold, window)
    at, g, ends, starts = run.outcomes()
    for count in range(1, 12):
        for start in range(-4000, 5001, 250):
            hit = np.flatnonzero((at >= threshold - count) & (g <= threshold * start + window * count))
            got = (ends[hit[0]], starts[hit[0]]) if len(hit) else (count + n, start)
            c, s = count, start
            for x in t.tolist():
                c, s = (1, x) if c == 0 else (c + 1, s)
                if c > threshold and c * window >= threshold * (x - s):
                    c, s = 0, 0
            assert (got[0], got[1] if got[0] else 0) == (c, s if c else 0)


def test_drain_goes_on_from_a_state(spark):
    rows = hot_log(9, quiet=0.01)
    cut = len(rows) // 3
    first, state = D.drained(spark.createDataFrame(rows[:cut], EVENTS), 4, 2.0, pid="pid", ranges=5)
    rest, _ = D.drained(spark.createDataFrame(rows[cut:], EVENTS), 4, 2.0, pid="pid", state=state, ranges=9)
    got = {r.seq: (r["count"], r.drain, r.run) for r in first.unionByName(rest).collect()}
    assert got == brute(rows, 4, 2_000_000)


def test_drain_of_nothing(spark):
    assert S.job_drain(spark.createDataFrame([], EVENTS)).count() == 0
    one = [("h", "job-completed", datetime(2024, 1, 1), 1, None), ("h", "job-started", datetime(2024, 1, 1), 2, None), ("h", "job-failed", None, 3, None)]
    assert S.job_drain(spark.createDataFrame(one, EVENTS)).count() == 0


def test_streamed_drain_however_the_log_is_cut(spark, tmp_path):
    rows = hot_log(12, quiet=0.02)
    want = sorted((c, d) for c, d, _ in brute(rows, 4, 2_000_000).values())
    for files in (1, 6):
        d, size = str(tmp_path / str(files)), -(-len(rows) // files)
        for k in range(files):
            spark.createDataFrame(rows[k * size : (k + 1) * size], EVENTS).coalesce(1).write.mode("append").parquet(d)
        ev = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(d)
        name = f"t8-{files}-{random.random()}"
        T.stream_job_drain(ev, name, 4, 2.0, pid="pid").awaitTermination()
        out = T.drain_rows(spark, name).collect()
        assert sorted((r["count"], r.drain) for r in out) == want
        assert len({r.batch for r in out}) == files


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_running_sums(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), i * 11 % 301, rng.choice([1, 5, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v long")
    got = {(r.k, r.o): r.s for r in R.running(df, "k", ["o"], "v", "s", ranges).collect()}
    for k, o, _ in rows:
        assert got[k, o] == sum(v or 0 for k2, o2, v in rows if k2 == k and o2 < o)


@pytest.mark.parametrize("ranges", [1, 5, 40])
@pytest.mark.parametrize("back", [True, False])
def test_neighbours_across_ranges(spark, ranges, back):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), i * 11 % 301, rng.choice([1, 5, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v long")
    got = {(r.k, r.o): r.p for r in R.neighbour(df, "k", ["o"], "v", "p", back, ranges).collect()}
    for key in ("hot", "a", None):
        mine = sorted((o, v) for k, o, v in rows if k == key) if back else sorted(((o, v) for k, o, v in rows if k == key), reverse=True)
        for i, (o, _) in enumerate(mine):
            assert (got[key, o] is None) == (i == 0)
            assert i == 0 or got[key, o].value == mine[i - 1][1]


def test_delete_batches_of_one_bucket(spark):
    keys = [f"k{i:05d}" for i in range(2503)]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([("b", k) for k in keys] + [("c", "x")], "bucket string, key string")
    got = sorted((r.bucket, r.batch, r.n_keys, r["keys"]) for r in O.delete_batches(df, 1000, ranges=13).collect())
    assert [g[:3] for g in got] == [("b", 0, 1000), ("b", 1, 1000), ("b", 2, 503), ("c", 0, 1)]
    assert sum((g[3] for g in got[:3]), []) == sorted(keys)


def test_eviction_of_one_hot_host(spark):
    rng = random.Random(2)
    rows = [("h", f"/p/{i:04d}", float(rng.randint(1, 99)), datetime(2024, 1, 1) + timedelta(seconds=i), rng.choice(["task", "job_ok", "job_other", "cache"])) for i in range(400)]
    df = spark.createDataFrame(rows, "host string, path string, bytes double, ts timestamp, class string")
    got = O.eviction_plan(df, 5000, ranges=17).collect()
    order = sorted(rows, key=lambda r: (O.EVICTION_ORDER.index(r[4]), -r[3].timestamp() if r[4] == "cache" else 0, r[1]))
    freed, want = 0.0, {}
    for r in order:
        want[r[1]] = (freed, freed < 5000)
        freed += r[2]
    assert {r.path: (r.freed_before, r.delete) for r in got} == want


def test_flags_and_gaps_of_one_hot_worker(spark):
    rows = [("w", "worker-offline" if (i // 9) % 2 else "worker-heartbeat", datetime(2024, 1, 1) + timedelta(seconds=i * i % 997 + 61 * i), i) for i in range(300)]
    df = spark.createDataFrame(rows, "celery_hostname string, status string, ts timestamp, seq long")
    flagged = df.selectExpr("celery_hostname", "ts", "seq", "status = 'worker-offline' as off")
    mine = sorted(rows, key=lambda r: (r[2], r[3]))
    want = [r[3] for i, r in enumerate(mine) if i == 0 or (r[1] != mine[i - 1][1])]
    assert [r.seq for r in S.flag_changes(flagged, "celery_hostname", ["ts", "seq"], "off", ranges=11).orderBy("ts", "seq").collect()] == want
    got = T.worker_alive_batch(df, 100, ranges=11).orderBy("ts", "seq").collect()
    nxt = [*(r[2] for r in mine[1:]), None]
    assert [r.next_ts for r in got] == nxt
    assert [r.expires for r in got] == [r[1] != "worker-offline" and (n is None or (n - r[2]).total_seconds() > 100) for r, n in zip(mine, nxt, strict=True)]
    assert pd.Series([r.expires for r in got]).any()
