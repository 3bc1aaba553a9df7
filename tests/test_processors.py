"""Stream processors without Spark: what a slot passes on is enough, whatever the state and however a log is cut."""

import random

import numpy as np
import pandas as pd
import pytest

from jobscope.streaming import processors as P

S = P.SECOND


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = tuple(v)

    def clear(self):
        self.v = None


class Many(Value):
    def put(self, v):
        self.v = list(v)


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Value()

    def getListState(self, *_):
        return Many()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def play(make, batches, slot, keep, by, delay_us):
    """Rows of one key through the processor, batch by batch; with ``slot`` each batch's rows go through the slots first."""
    handle, proc, out, mark = Handle(), make(), [], 0
    proc.init(handle)
    for pdf in batches:
        if slot:
            compact = P.Compact(keep, by, list(pdf.columns))
            parts = [x for _, g in pdf.groupby(P.micros(pdf["ts"]) // slot) for x in compact.handleInputRows(("k",), iter([g.sample(frac=1, random_state=1)]), None)]
            random.Random(3).shuffle(parts)
        else:
            parts = [pdf]
        out += list(proc.handleInputRows(("k",), iter(parts), Watermark(mark)))
        for at in sorted(t for t in handle.timers if t < mark):
            handle.timers.remove(at)
            out += list(proc.handleExpiredTimer(("k",), Watermark(mark), None))
        mark = max(mark, (int(P.micros(pdf["ts"]).max()) - delay_us) // 1000)
    return sorted(map(repr, pd.concat(out).itertuples(index=False, name=None))) if out else []


def log(seed, statuses):
    rng = random.Random(seed)
    us, rows = 10**15, []
    for i in range(rng.randint(1, 150)):
        us += rng.choice([0, 1, 5, 30, 60, 61, 200]) * S * rng.choice([0, 1, 1])
        rows.append((rng.choice(statuses), P.stamps([us])[0], i, f"p{i}"))
    return pd.DataFrame(rows, columns=["status", "ts", "seq", "payload_id"])


def cuts(pdf, n):
    return [pdf.iloc[list(c)] for c in np.array_split(np.arange(len(pdf)), n) if len(c)]


CASES = {
    "t2": (lambda: P.FirstByHash(120), P.first_of_each_time, ["ts", "seq", "payload_id"], 5, ["job-queued"]),
    "t3": (lambda: P.WorkerAlive(60), P.ends_of_stretches, ["ts", "seq"], 60, ["worker-heartbeat"] * 5 + ["worker-offline"]),
    "t4": (lambda: P.Timeouts(60), P.ends_of_work, ["ts", "seq"], 60, ["job-started"] * 6 + ["job-failed", "job-completed"]),
}


@pytest.mark.parametrize("name", list(CASES))
@pytest.mark.parametrize("seed", range(12))
def test_slots_pass_on_enough(name, seed):
    make, keep, by, slot, statuses = CASES[name]
    pdf = log(seed, statuses)
    for n in (1, 2, 7):
        whole = play(make, cuts(pdf, n), 0, keep, by, 10 * S)
        assert play(make, cuts(pdf, n), slot * S, keep, by, 10 * S) == whole


@pytest.mark.parametrize("seed", range(12))
def test_failed_tasks_pass_on_enough(seed):
    pdf = log(seed, [False] * 3 + [True]).rename(columns={"status": "terminal"})
    pdf["exception"], pdf["cls"] = pdf["payload_id"], "WorkerLostError"
    for n in (1, 2, 7):
        args = (lambda: P.FailedTasks(60, 300), cuts(pdf, n))
        whole = play(*args, 0, P.failures_and_ends, ["ts"], 10 * S)
        assert play(*args, 60 * S, P.failures_and_ends, ["ts"], 10 * S) == whole


def test_a_busy_slot_is_a_few_rows():
    pdf = pd.DataFrame({"status": "worker-heartbeat", "ts": P.stamps(10**15 + np.arange(5000) * 1000), "seq": range(5000)})
    assert len(np.unique(P.ends_of_stretches(pdf))) == 2
    assert len(np.unique(P.ends_of_work(pdf.assign(status=["job-started"] * 2000 + ["job-failed"] * 1000 + ["job-started"] * 2000)))) == 4
    assert len(P.first_of_each_time(pdf.assign(ts=pdf["ts"].dt.floor("s")))) == 5
