"""Stateful processors of the keyed streams T2-T5.

A key's rows of a micro-batch come in two levels.  ``Compact`` sorts the rows
of each (key, time slot) and passes on those that a state machine could tell
from the rest, whatever state it is in; it keeps no state.  So a key that holds
a large share of a micro-batch is dealt out by slot.  The processor of the key
then gets a few rows for each slot (its docstring says which), and keeps state
in the state store with event-time timers.  What it does depends on the order
of a batch's rows by time, not on how they arrive.

A call of a processor costs milliseconds, so with many keys (T2, T4, T5) and
slots a call takes a bucket of them, and steps through its keys (``Bucket``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from pyspark.sql.streaming import StatefulProcessor

from jobscope import TERMINAL_JOB_STATUSES

SECOND = 1_000_000


def micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype("int64")


def stamps(us) -> pd.Series:
    return pd.Series(np.asarray(us, "int64").astype("datetime64[us]").astype("datetime64[ns]"))


def ordered(pdfs: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    pdf = pd.concat(list(pdfs), ignore_index=True)
    return pdf.sort_values([c for c in by if c in pdf.columns], kind="stable", ignore_index=True)


def numbered(pdfs: Iterator[pd.DataFrame], key: str | None) -> Iterator[pd.DataFrame]:
    """The rows with the number of their key as ``_k`` (null is a key of its own; without ``key`` all have one)."""
    pdf = pd.concat(list(pdfs), ignore_index=True)
    yield pdf.assign(_k=pd.factorize(pdf[key], use_na_sentinel=False)[0] if key else 0)


def borders(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def segments(n: int, new: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last row of each segment, and the segment of each row."""
    if new is None:
        new = np.arange(n) == 0
    first = np.flatnonzero(new)
    return first, np.append(first[1:] - 1, n - 1), np.cumsum(new) - 1


class Compact(StatefulProcessor):
    """Of the rows of a (key, slot) in a batch, sorted by ``by``, those at the places that ``keep`` gives.

    With ``key`` a call has the rows of many keys and slots (of ``slot`` seconds), and ``keep`` gets which rows are the first of one.
    """

    def __init__(self, keep: Callable[..., np.ndarray], by: list[str], columns: list[str], key: str | None = None, slot: int = 1):
        self.keep, self.by, self.columns, self.key, self.slot = keep, by, columns, key, slot

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = ordered(numbered(rows, self.key), ["_k", *self.by])
        new = borders(pdf["_k"].to_numpy(), micros(pdf["ts"]) // (self.slot * SECOND)) if self.key else None
        yield pdf[self.columns].iloc[np.unique(self.keep(pdf, new))]

    def close(self) -> None:
        pass


class Keyed(StatefulProcessor):
    """A processor with one event-time timer for each key."""

    def init(self, handle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.open(handle)

    def open(self, handle) -> None:
        raise NotImplementedError

    def arm(self, at_ms: int | None, timerValues) -> None:
        """Set the key's timer, which may not lie before the watermark, in place of any it has."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if at_ms is not None:
            at = max(int(at_ms), timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


class Bucket(StatefulProcessor):
    """Many keys with one event-time timer, for the earliest of what they wait for.

    State: a list of rows, the first column the key.  ``step`` takes a key's
    state rows and its new rows, ``lapse`` a key's state rows when the
    watermark has passed what ``due`` gives; both return the state rows that
    stay and the rows to emit, as ``columns`` behind the key.  Without ``key``
    (the column) all rows are of the group's key.
    """

    state: str
    order: list[str]
    columns: list[str]

    def __init__(self, key: str | None = None):
        self.key = key

    def init(self, handle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.rows = handle.getListState("keys", f"key string, {self.state}")

    def columns_of(self, pdf: pd.DataFrame) -> list[list]:
        """What ``step`` needs of the rows, as lists."""
        raise NotImplementedError

    def step(self, known: list[tuple], lo: int, hi: int, *columns: list) -> tuple[list[tuple], list[tuple]]:
        raise NotImplementedError

    def due(self, known: list[tuple]) -> int:
        """The time (ms) that the watermark has to pass for a key's state to lapse."""
        raise NotImplementedError

    def lapse(self, known: list[tuple], now: int) -> tuple[list[tuple], list[tuple]]:
        raise NotImplementedError

    def known(self) -> dict[str | None, list[tuple]]:
        out: dict[str | None, list[tuple]] = {}
        for k, *rest in self.rows.get() if self.rows.exists() else []:
            out.setdefault(k, []).append(tuple(rest))
        return out

    def lapsed(self, known: dict, now: int, but: set) -> list[tuple]:
        """Rows of the keys whose time is over; ``but`` have had rows just now."""
        found = []
        for k in [k for k, v in known.items() if v and k not in but and self.due(v) < now]:
            known[k], rows = self.lapse(known[k], now)
            found += [(k, *r) for r in rows]
        return found

    def keep(self, known: dict, now: int) -> None:
        """Keep what is left, with a timer, which may not lie before the watermark, in place of any there is."""
        left = [(k, *r) for k, v in known.items() for r in v]
        self.rows.put(left) if left else self.rows.clear()
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if left:
            at = max(min(self.due(v) for v in known.values() if v), now + 1)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def frame(self, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=self.columns, dtype=object)
        return out.assign(**{c: stamps(out[c].astype("int64")) for c in self.columns if c in ("ts", "last_ts", "timed_out_at", "failed_at")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = ordered(numbered(rows, self.key), ["_k", *self.order])
        lists = self.columns_of(pdf)
        first, last, _ = segments(len(pdf), borders(pdf["_k"].to_numpy()))
        keys = [None if pd.isna(k) else k for k in pdf[self.key].iloc[first]] if self.key else [key[0]]
        known, now, found = self.known(), timerValues.getCurrentWatermarkInMs(), []
        for k, lo, hi in zip(keys, first.tolist(), last.tolist(), strict=True):
            known[k], out = self.step(known.get(k, []), lo, hi + 1, *lists)
            found += [(k, *r) for r in out]
        found += self.lapsed(known, now, set(keys))
        self.keep(known, now)
        if found:
            yield self.frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        known, now = self.known(), timerValues.getCurrentWatermarkInMs()
        found = self.lapsed(known, now, set())
        self.keep(known, now)
        if found:
            yield self.frame(found)

    def close(self) -> None:
        pass


def first_of_each_time(pdf: pd.DataFrame, new: np.ndarray | None = None) -> np.ndarray:
    times = borders(micros(pdf["ts"]))
    return np.flatnonzero(times if new is None else times | new)


class FirstByHash(Bucket):
    """T2.  Of a slot, the first row of each time.  State: the time of the current first submission."""

    state, order, columns = "us long", ["ts", "seq", "payload_id"], ["payload_hash", "payload_id", "ts"]

    def __init__(self, ttl_secs: int, key: str | None = None):
        super().__init__(key)
        self.ttl = ttl_secs * SECOND

    def columns_of(self, pdf):
        return [micros(pdf["ts"]).tolist(), pdf["payload_id"].tolist()]

    def step(self, known, lo, hi, us, ids):
        first = known[0][0] if known else None
        at = lo if first is None else bisect_left(us, first + self.ttl, lo, hi)
        chosen = []
        while at < hi:  # one step per row that is kept
            first = us[at]
            chosen.append((ids[at], first))
            at = bisect_left(us, first + self.ttl, lo, hi)
        return [(first,)], chosen

    def due(self, known):
        return (known[0][0] + self.ttl) // 1000

    def lapse(self, known, now):
        return [], []


def ends_of_stretches(pdf: pd.DataFrame, new: np.ndarray | None = None) -> np.ndarray:
    off = (pdf["status"] == "worker-offline").to_numpy()
    first, last, at = segments(len(off), new)
    turns = np.flatnonzero((off[1:] != off[:-1]) & (at[1:] == at[:-1]))
    return np.concatenate([first, last, turns, turns + 1])


class WorkerAlive(Keyed):
    """T3.  Of a slot no longer than the TTL, the first and last row of each
    stretch of heartbeats and of offline events: no heartbeat lapses inside
    one.  State: the time of the last heartbeat, while the worker is alive."""

    def __init__(self, ttl_secs: int):
        self.ttl = ttl_secs * SECOND

    def open(self, handle) -> None:
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = ordered(rows, ["ts", "seq"])
        us, off = micros(pdf["ts"]), (pdf["status"] == "worker-offline").to_numpy()
        known = self.last.exists()
        before = np.concatenate([[self.last.get()[0] if known else 0], us[:-1]])
        was = np.concatenate([[known], ~off[:-1]])
        lapsed = was & (us - before > self.ttl)
        alive = was & ~lapsed
        out = [(before[i] + self.ttl, "expired") for i in np.flatnonzero(lapsed)]
        out += [(us[i], "alive") for i in np.flatnonzero(~off & ~alive)]
        out += [(us[i], "offline") for i in np.flatnonzero(off & alive)]
        if off[-1]:
            self.last.clear()
            self.arm(None, timerValues)
        else:
            self.last.update((int(us[-1]),))
            self.arm((int(us[-1]) + self.ttl) // 1000, timerValues)
        if out:
            out.sort()
            yield pd.DataFrame({"celery_hostname": key[0], "status": [x for _, x in out], "ts": stamps([t for t, _ in out])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (last,) = self.last.get()
        self.last.clear()
        self.timer.clear()
        yield pd.DataFrame({"celery_hostname": [key[0]], "status": ["expired"], "ts": stamps([last + self.ttl])})


def first_and_last(places: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending places the first and last in each segment, and which segments have any."""
    which, i = np.unique(at[places], return_index=True)
    return places[i], places[np.append(i[1:], len(places))[: len(i)] - 1], which


def ends_of_work(pdf: pd.DataFrame, new: np.ndarray | None = None) -> np.ndarray:
    first, last, at = segments(len(pdf), new)
    begun, ended, which = first_and_last(np.flatnonzero(np.isin(pdf["status"].to_numpy(), TERMINAL_JOB_STATUSES)), at)
    return np.concatenate([first, np.delete(last, which), np.maximum(begun - 1, first[which]), begun, ended])


class Timeouts(Bucket):
    """T4.  Of a slot no longer than the timeout, the first row, the last one
    before a terminal status, and the first and last terminal one: what follows
    a terminal status in its slot is not watched, and no row before it is
    silent inside the slot.  State: the last row that is watched."""

    state, order, columns = "status string, us long, done boolean", ["ts", "seq"], ["key", "last_status", "last_ts", "timed_out_at"]

    def __init__(self, timeout_secs: int, key: str | None = None):
        super().__init__(key)
        self.limit = timeout_secs * SECOND

    def columns_of(self, pdf):
        return [micros(pdf["ts"]).tolist(), pdf["status"].tolist(), np.isin(pdf["status"].to_numpy(), TERMINAL_JOB_STATUSES).tolist()]

    def step(self, known, lo, hi, us, status, done):
        last = known[0] if known else None  # what was seen last stands before the new rows
        ended = last[1] if last and last[2] else None
        late = []
        for i in range(lo, hi):
            u = us[i]
            if done[i] or ended is None or u - ended > self.limit:  # it is watched
                if last and not last[2] and u - last[1] > self.limit:
                    late.append((last[0], last[1], last[1] + self.limit))
                last = (status[i], u, done[i])
            if done[i]:
                ended = u if ended is None else max(ended, u)
        return [(str(last[0]), last[1], last[2])], late

    def due(self, known):
        return (known[0][1] + self.limit) // 1000

    def lapse(self, known, now):
        status, us, done = known[0]
        return [], [] if done else [(status, us, us + self.limit)]


def failures_and_ends(pdf: pd.DataFrame, new: np.ndarray | None = None) -> np.ndarray:
    terminal = pdf["terminal"].to_numpy(bool)
    begun, ended, _ = first_and_last(np.flatnonzero(terminal), segments(len(pdf), new)[2])
    return np.concatenate([np.flatnonzero(~terminal), begun, ended])


class FailedTasks(Bucket):
    """T5.  Of a slot no longer than the grace period, all failures, and the
    first and last terminal status.  State: the failures that wait, and the
    time of the last terminal status (without a kind) until the watermark is
    ``keep_secs`` past it."""

    state, order, columns = "us long, exception string, kind string", ["ts"], ["uuid", "error", "short_error", "failed_at"]

    def __init__(self, grace_secs: int, keep_secs: int, key: str | None = None):
        super().__init__(key)
        self.grace, self.keep_us = grace_secs * SECOND, keep_secs * SECOND

    def columns_of(self, pdf):
        return [micros(pdf["ts"]).tolist(), pdf["terminal"].tolist(), pdf["exception"].tolist(), pdf["cls"].tolist()]

    def step(self, known, lo, hi, us, terminal, exception, kind):
        ends = sorted([u for u, _, c in known if c is None] + [us[i] for i in range(lo, hi) if terminal[i]])
        waiting = [w for w in known if w[2] is not None] + sorted((us[i], exception[i], kind[i]) for i in range(lo, hi) if not terminal[i])
        waiting = [w for w in waiting if bisect_left(ends, w[0] - self.keep_us) >= bisect_right(ends, w[0] + self.grace)]
        newest = us[hi - 1]
        failed = [(w[1], w[2], w[0]) for w in waiting if newest > w[0] + self.grace]
        return [w for w in waiting if newest <= w[0] + self.grace] + [(u, None, None) for u in ends[-1:]], failed

    def due(self, known):
        return min((u + (self.keep_us if c is None else self.grace)) // 1000 for u, _, c in known)

    def lapse(self, known, now):
        over = [self.due([w]) < now for w in known]
        return [w for w, o in zip(known, over, strict=True) if not o], [(w[1], w[2], w[0]) for w, o in zip(known, over, strict=True) if o and w[2] is not None]
