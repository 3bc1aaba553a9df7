"""Stream processors over buckets: many keys in a call give what each key alone gives, and calls do not grow with keys."""

import random
import uuid

import numpy as np
import pandas as pd
import pytest

from jobscope.streaming import ops as T
from jobscope.streaming import processors as P
from tests.test_processors import Handle, S, Watermark, log

MAKE = {
    "t2": (lambda key: P.FirstByHash(120, key), ["job-queued"]),
    "t4": (lambda key: P.Timeouts(60, key), ["job-started"] * 6 + ["job-failed", "job-completed"]),
    "t5": (lambda key: P.FailedTasks(60, 300, key), [False] * 3 + [True]),
}
KEYS = ["a", "b", None, "c"]


def events(seed, statuses):
    parts = []
    for i, k in enumerate(KEYS):
        pdf = log(seed + 100 * i, statuses).assign(k=pd.Series([k], dtype=object).repeat(1).iloc[0])
        pdf["k"] = pdf["k"].astype(object).where(pdf["k"].notna(), None)
        parts.append(pdf.assign(terminal=pdf["status"] if statuses[0] is False else False, exception=pdf["payload_id"], cls="WorkerLostError"))
    return pd.concat(parts).sort_values(["ts", "seq"], kind="stable", ignore_index=True)


def play(proc, batches, marks, group):
    handle, out = Handle(), []
    proc.init(handle)
    for pdf, mark in zip(batches, marks, strict=True):
        if len(pdf):
            out += list(proc.handleInputRows(group, iter(np.array_split(pdf, 2) if len(pdf) > 1 else [pdf]), Watermark(mark)))
        for at in sorted(t for t in handle.timers if t < mark):
            handle.timers.remove(at)
            out += list(proc.handleExpiredTimer(group, Watermark(mark), None))
    return [tuple(r) for x in out for r in x.itertuples(index=False, name=None)]


@pytest.mark.parametrize("name", list(MAKE))
@pytest.mark.parametrize("seed", range(6))
def test_a_bucket_is_its_keys(name, seed):
    make, statuses = MAKE[name]
    pdf = events(seed, statuses)
    for n in (1, 3, 8):
        batches = [pdf.iloc[list(c)] for c in np.array_split(np.arange(len(pdf)), n)] + [pdf.iloc[:0]]
        marks, mark = [], 0
        for b in batches:
            marks.append(mark)
            mark = max([mark, *((P.micros(b["ts"]) - 10 * S) // 1000).tolist()])
        alone = []
        for k in KEYS:
            own = pdf["k"].isna() if k is None else pdf["k"] == k
            alone += play(make(None), [b[own.loc[b.index]] for b in batches], marks, (k,))
        assert sorted(map(repr, play(make("k"), batches, marks, (7,)))) == sorted(map(repr, alone)) and alone


@pytest.mark.parametrize("keep,by", [(P.first_of_each_time, ["ts", "seq"]), (P.ends_of_stretches, ["ts", "seq"]), (P.ends_of_work, ["ts", "seq"]), (P.failures_and_ends, ["ts"])])
def test_slots_of_many_keys_pass_on_what_each_does(keep, by):
    pdf = events(3, ["worker-heartbeat", "worker-offline", "job-failed"])
    pdf["terminal"] = pdf["status"] == "job-failed"
    columns = list(pdf.columns)
    whole = list(P.Compact(keep, by, columns, "k", 60).handleInputRows((7,), iter([pdf.sample(frac=1, random_state=1).sort_values("seq", kind="stable")]), None))[0]
    alone = [list(P.Compact(keep, by, columns).handleInputRows((k,), iter([g]), None))[0] for (k, _), g in pdf.groupby([pdf["k"].fillna("-"), P.micros(pdf["ts"]) // (60 * S)])]
    assert sorted(map(repr, whole.itertuples(index=False, name=None))) == sorted(map(repr, pd.concat(alone).itertuples(index=False, name=None)))


def test_calls_do_not_grow_with_keys(spark, tmp_path, monkeypatch):
    """With two buckets the processors are called at most twice a level, however many keys there are."""
    monkeypatch.setattr(T, "BUCKETS", 2)
    calls = spark.sparkContext.accumulator(0)

    class Counted(P.FirstByHash):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(P, "FirstByHash", Counted)
    at = pd.Timestamp("2024-01-01").to_pydatetime()
    rng = random.Random(1)
    rows = [(f"p{i}", None if i % 40 == 0 else f"h{rng.randrange(90)}", at, i) for i in range(300)]
    schema = "payload_id string, payload_hash string, ts timestamp, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = T.run_available(T.stream_first_by_hash(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), f"t_{uuid.uuid4().hex}").collect()
    want = {}
    for p, h, _, _ in rows:
        want.setdefault(h, p)
    assert {(r.payload_hash, r.payload_id) for r in got} == set(want.items()) and len(got) == len(want)
    assert 1 <= calls.value <= 2
