"""Drain detection (W3, T8) as an automaton whose runs are composed.

A worker's state is its count of failures and the time of the first of them.
Over a range of a worker's rows the state after it follows from the state
before it:

* a range with a reset (a finished job, another process) ends in a state that
  does not depend on what came before;
* in a range of failures only, the state before decides where the first drain
  is; the rest then runs as from a clear state.  With integers, the drain
  condition ``count / elapsed >= threshold / window`` at row ``i`` reads
  ``g(i) <= k`` with ``g(i) = threshold * t(i) - window * (i + 1)`` and ``k`` the
  same form of the state before.  So the range is summed to the rows at which
  ``g`` falls to a new least value, each with the state the range ends in.

``summaries`` makes a row of this for each (worker, range) in parallel,
``carries`` passes the state through a worker's summaries, one row at a time,
and ``job_drain`` then scans all ranges in parallel, each from its carried state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.operators.ranges import RANGE, ranged

#: State of a worker: failures counted, microseconds of the first, process id, resets so far (null before the first row).
STATE = "host string, count long, start long, pid string, runs long"
DRAIN = "host string, run long, ts timestamp, seq long, count long, drain boolean"


def first_at_most(g: np.ndarray, at: int, limit: int) -> int:
    """The first index from ``at`` on with ``g <= limit``, or -1."""
    step = 64
    while at < len(g):
        hit = g[at : at + step] <= limit
        if hit.any():
            return at + int(np.argmax(hit))
        at += step
        step *= 4
    return -1


class Run:
    """Consecutive failures at times ``t`` (ascending microseconds) without a reset."""

    def __init__(self, t: np.ndarray, threshold: int, window: int):
        self.t, self.threshold, self.window = t, threshold, window
        self.g = threshold * t - window * np.arange(1, len(t) + 1)

    def drain_after(self, at: int, count: int, start: int) -> int:
        """The first row from ``at`` on that drains when ``count`` failures since ``start`` stand before row ``at``; -1 if none does."""
        first = at + max(0, self.threshold - count)
        return first_at_most(self.g, first, self.threshold * start + self.window * (count - at))

    def fresh(self, at: int) -> int:
        return self.drain_after(at, 0, int(self.t[at])) if at < len(self.t) else -1

    def drains(self, count: int, start: int) -> list[int]:
        """All rows that drain."""
        at = self.drain_after(0, count, start) if count else self.fresh(0)
        out = []
        while at >= 0:
            out.append(at)
            at = self.fresh(at + 1)
        return out

    def end(self, count: int, start: int) -> tuple[int, int]:
        """The state after the run."""
        drains = self.drains(count, start) if count + len(self.t) > self.threshold else []
        if drains:
            return self.rest(drains[-1] + 1)
        return (count + len(self.t), start) if count else self.rest(0)

    def rest(self, at: int) -> tuple[int, int]:
        """The state at the end if nothing from ``at`` on drains any more and it is clear there."""
        return (len(self.t) - at, int(self.t[at])) if at < len(self.t) else (0, 0)

    def outcomes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row that can be the first to drain: row, g, and the state at the end."""
        n = len(self.t)
        head = np.arange(min(self.threshold, n))
        tail = self.g[len(head) :]
        least = np.minimum.accumulate(tail) if n > len(head) else tail
        falls = np.flatnonzero(np.concatenate([[True], least[1:] < least[:-1]])) + len(head) if n > len(head) else np.zeros(0, np.int64)
        rows = np.concatenate([head, falls]).astype(np.int64)
        known: dict[int, tuple[int, int]] = {}
        for i in rows[::-1].tolist():
            path, at = [], i + 1
            while at not in known:
                path.append(at)
                drain = self.fresh(at)
                if drain < 0:
                    known[at] = self.rest(at)
                    path.pop()
                else:
                    at = drain + 1
            for p in path:
                known[p] = known[at]
        ends = np.array([known[i + 1] for i in rows.tolist()], np.int64).reshape(-1, 2)
        return rows, self.g[rows], ends[:, 0], ends[:, 1]


def flags(failed: np.ndarray, pid: np.ndarray) -> np.ndarray:
    """Whether each row clears the count before it is counted, by what stands before it in the range (the first row: not known)."""
    reset = ~failed
    same = np.array([a == b for a, b in zip(pid[1:], pid[:-1], strict=True)], bool)
    reset[1:] |= ~same
    return reset


def scan(t: np.ndarray, failed: np.ndarray, reset: np.ndarray, count: int, start: int, threshold: int, window: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Counts and drains of all rows, and the state at the end; ``reset[0]`` says whether the state before counts."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool), count, start
    drain = np.zeros(n, bool)
    cuts = np.flatnonzero(reset)
    starts = np.concatenate([[0], cuts[cuts > 0]])
    ends = np.append(starts[1:], n)
    skip = (~failed[starts]).astype(np.int64)  # a run begins with its reset row, which counts itself only if it failed
    counts = np.arange(n) + 1 - np.repeat(starts + skip, ends - starts)
    carry, since = (0, 0) if reset[0] else (count, start)
    # others are too short to drain
    for k in np.flatnonzero((ends - starts + np.where(starts == 0, carry, 0) > threshold) | ((starts == 0) & (carry > 0))):
        a, b = int(starts[k] + skip[k]), int(ends[k])
        c, s = (carry, since) if starts[k] == 0 else (0, 0)
        if a == b:
            continue
        counts[a:b] = np.arange(c + 1, c + b - a + 1)
        for i in Run(t[a:b], threshold, window).drains(c, s):
            drain[a + i] = True
            counts[a + i + 1 : b] = np.arange(1, b - a - i)
    last = Run(t[starts[-1] + skip[-1] :], threshold, window)
    return counts, drain, *last.end(*((carry, since) if starts[-1] == 0 else (0, 0)))


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pdf["ts"].to_numpy("datetime64[us]").astype("int64"), pdf["failed"].to_numpy(bool), pdf["pid"].to_numpy(object)


SUMMARY = f"host string, {RANGE} int, rows long, resets long, first_failed boolean, first_pid string, last_pid string, closed boolean, count long, start long, at array<long>, g array<long>, ends array<long>, starts array<long>"


def summaries(rows: DataFrame, threshold: int, window: int) -> DataFrame:
    """A row for each (host, range): what it does to a state."""

    def summed(key, pdf):
        pdf = pdf.sort_values(["ts", "seq"], kind="stable")
        t, failed, pid = _arrays(pdf)
        reset = flags(failed, pid)
        closed = bool(reset.any())
        _, _, count, start = scan(t, failed, np.concatenate([[True], reset[1:]]), 0, 0, threshold, window)
        at, g, ends, starts = ([], [], [], []) if closed else (x.tolist() for x in Run(t, threshold, window).outcomes())
        return pd.DataFrame([(key[0], key[1], len(t), int(reset[1:].sum()), bool(failed[0]), pid[0], pid[-1], closed, count, start, at, g, ends, starts)], columns=[x.split()[0] for x in SUMMARY.split(", ")])

    return rows.groupBy("host", RANGE).applyInPandas(summed, SUMMARY)


CARRY = f"host string, {RANGE} int, reset boolean, count long, start long, runs long, out_count long, out_start long, out_pid string, out_runs long"


def carries(parts: DataFrame, state: DataFrame | None, threshold: int, window: int) -> DataFrame:
    """The state before and after each (host, range), and whether its first row resets."""
    if state is not None:
        known = state.select(F.col("host").alias("_host"), F.col("count").alias("c0"), F.col("start").alias("s0"), F.col("pid").alias("p0"), F.col("runs").alias("r0"))
        parts = parts.join(known, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    else:
        parts = parts.withColumns({c: F.lit(None).cast(k) for c, k in (("c0", "long"), ("s0", "long"), ("p0", "string"), ("r0", "long"))})
    names = [x.split()[0] for x in CARRY.split(", ")]

    def passed(batches):
        host, begun = None, False
        count = start = runs = 0
        pid = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not begun or r["host"] != host:
                    host, begun = r["host"], True
                    known = r["r0"] is not None
                    count, start, pid, runs = (r["c0"], r["s0"], r["p0"], r["r0"]) if known else (0, 0, None, 0)
                else:
                    known = True
                reset = not known or not r["first_failed"] or r["first_pid"] != pid
                before = (0, 0) if reset else (count, start)
                row = [host, r[RANGE], reset, *before, runs]
                if r["closed"] or reset or not before[0]:
                    count, start = r["count"], r["start"]
                else:
                    at, g = np.array(r["at"], np.int64), np.array(r["g"], np.int64)
                    hit = np.flatnonzero((at >= threshold - count) & (g <= threshold * start + window * count))
                    count, start = (r["ends"][hit[0]], r["starts"][hit[0]]) if len(hit) else (count + r["rows"], start)
                runs += r["resets"] + reset
                pid = r["last_pid"]
                out.append((*row, count, start, pid, runs))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], names=names)

    return parts.repartition("host").sortWithinPartitions("host", RANGE).mapInArrow(passed, CARRY)


KINDS = [pa.string(), pa.int32(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.int64()]


def drained(events: DataFrame, threshold: int = 10, window_secs: float = 5.0, host: str = "celery_hostname",
            pid: str | None = None, state: DataFrame | None = None, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``job_drain``, and the state (``STATE``) of each host that has events.

    ``state``: what an earlier part of the log left behind.
    """
    from jobscope.session import stored

    window = round(window_secs * 1_000_000)
    rows = events.filter(F.col("status").isin("job-failed", "job-completed", "job-deduped") & F.col("ts").isNotNull()).select(
        F.col(host).alias("host"), "ts", "seq", (F.col("status") == "job-failed").alias("failed"),
        (F.col(pid).cast("string") if pid else F.lit(None).cast("string")).alias("pid"),
    )
    rows = ranged(rows, "host", ["ts", "seq"], ranges)
    carry = stored(carries(summaries(rows, threshold, window), state, threshold, window), "carries")

    def apply(key, pdf, before):
        pdf = pdf.sort_values(["ts", "seq"], kind="stable")
        t, failed, pids = _arrays(pdf)
        reset = flags(failed, pids)
        reset[0] = bool(before["reset"].iloc[0])
        counts, drain, _, _ = scan(t, failed, reset, int(before["count"].iloc[0]), int(before["start"].iloc[0]), threshold, window)
        return pd.DataFrame({"host": key[0], "run": int(before["runs"].iloc[0]) + np.cumsum(reset), "ts": pdf["ts"].to_numpy(), "seq": pdf["seq"].to_numpy(), "count": counts, "drain": drain})[failed]

    found = rows.groupBy("host", RANGE).cogroup(carry.groupBy("host", RANGE)).applyInPandas(apply, DRAIN)
    last = carry.groupBy("host").agg(F.max_by(F.struct(F.col("out_count").alias("count"), F.col("out_start").alias("start"), F.col("out_pid").alias("pid"), F.col("out_runs").alias("runs")), RANGE).alias("s"))
    return found, last.select("host", "s.*")


def job_drain(events: DataFrame, threshold: int = 10, window_secs: float = 5.0,
              host: str = "celery_hostname", pid: str | None = None, ranges: int | None = None) -> DataFrame:
    """Contiguous-failure drain detection per worker.

    A completed/deduped job clears a worker's failure counter, and so does a
    new worker process id (null ids are one).  Each failure increments it; the
    first failure sets the start time.  The worker drains when count >
    threshold and count / (t - start) >= threshold / window_secs; a drain
    clears the counter too.  Events without a time are left out.  Returns one row per failure with its running
    ``count`` and ``drain`` flag, and ``run``, the number of resets up to it.
    """
    return drained(events, threshold, window_secs, host, pid, ranges=ranges)[0].withColumnRenamed("host", host)
