"""Current state from an append-only log, timelines, latest/earliest rows.

A1/A2 and W1/W2 are aggregations with ``max_by``/``min_by`` over a struct
ordering key.  These aggregates are partial (map-side combine): each task
keeps one candidate row per key before the shuffle, so a hot key (one job or
worker holding a third of all rows) costs one row per map task in the
exchange, never a group materialised in one task.  Order keys are made total
with a tiebreaker (``seq``) so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from jobscope import TERMINAL_JOB_STATUSES


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _pick(df: DataFrame, keys: Sequence[str], order: Column, agg=F.max_by) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    packed = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(agg(packed, order).alias("_row")).select(*keys, "_row.*")


def current_state(events: DataFrame, key="payload_id", order=("ts", "seq")) -> DataFrame:
    """A1: last write per key (event time, then sequence)."""
    keys = _cols(key)
    order_key = F.struct(*[F.col(c) for c in _cols(order)])
    return _pick(events, keys, order_key)


def is_terminal(status="status") -> Column:
    return F.col(status).isin(*TERMINAL_JOB_STATUSES) if isinstance(status, str) else status.isin(*TERMINAL_JOB_STATUSES)


def current_state_guarded(events: DataFrame, key="payload_id", order=("ts", "seq"),
                          supervisory: str | None = "supervisory") -> DataFrame:
    """A2: as A1, but once a terminal write exists no non-terminal write and no
    supervisory write replaces it.

    Precedence, highest first: terminal; among terminal writes the
    authoritative (non-supervisory) ones; then event time and sequence.  Among
    non-terminal writes the latest wins whoever wrote it.
    """
    keys = _cols(key)
    term = is_terminal("status")
    if supervisory and supervisory in events.columns:
        auth = term & ~F.coalesce(F.col(supervisory), F.lit(False))
    else:
        auth = term
    order_key = F.struct(term.alias("t"), auth.alias("a"), *[F.col(c) for c in _cols(order)])
    return _pick(events, keys, order_key)


def _guarded_order(events: DataFrame, supervisory: str | None) -> Column:
    """A2's precedence of a write."""
    term = is_terminal("status")
    known = supervisory and supervisory in events.columns
    sup = F.coalesce(F.col(supervisory), F.lit(False)) if known else F.lit(False)
    return F.struct(term.alias("t"), (term & ~sup).alias("a"), F.col("ts"), F.col("seq"))


def job_timeline(events: DataFrame, key="payload_id", supervisory: str | None = "supervisory") -> DataFrame:
    """A3: one row per job: queued / started / ended times, queue wait, run
    duration, number of writes and the final status (A2's precedence)."""
    keys = _cols(key)
    st, ts = F.col("status"), F.col("ts")
    term = is_terminal("status")
    out = events.groupBy(*keys).agg(
        F.min(F.when(st == "job-queued", ts)).alias("time_queued"),
        F.min(F.when(st == "job-started", ts)).alias("time_start"),
        F.max(F.when(term, ts)).alias("time_end"),
        F.count(F.lit(1)).alias("n_events"),
        F.max_by(st, _guarded_order(events, supervisory)).alias("final_status"),
    )
    secs = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)
    return out.withColumns(
        {
            "wait_secs": secs(F.col("time_start"), F.col("time_queued")),
            "run_secs": secs(F.col("time_end"), F.col("time_start")),
        }
    )


def timeline_and_state(events: DataFrame, key="payload_id", state_cols=(), supervisory: str | None = "supervisory") -> DataFrame:
    """A3 and A2 in ONE aggregation: the timeline columns plus the guarded
    current row (``current_status``, ``last_update`` and ``state_cols``).  One scan and one
    shuffle of the log instead of two."""
    keys = _cols(key)
    st, ts = F.col("status"), F.col("ts")
    term = is_terminal("status")
    guarded = _guarded_order(events, supervisory)
    packed = F.struct(*[F.col(c).alias(c) for c in ("status", "ts", *state_cols)])
    out = events.groupBy(*keys).agg(
        F.min(F.when(st == "job-queued", ts)).alias("time_queued"),
        F.min(F.when(st == "job-started", ts)).alias("time_start"),
        F.max(F.when(term, ts)).alias("time_end"),
        F.count(F.lit(1)).alias("n_events"),
        F.max_by(packed, guarded).alias("_cur"),
    )
    secs = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)
    return out.select(
        *keys, "time_queued", "time_start", "time_end", "n_events",
        F.col("_cur.status").alias("final_status"),
        secs(F.col("time_start"), F.col("time_queued")).alias("wait_secs"),
        secs(F.col("time_end"), F.col("time_start")).alias("run_secs"),
        F.col("_cur.status").alias("current_status"), F.col("_cur.ts").alias("last_update"),
        *[F.col(f"_cur.{c}").alias(c) for c in state_cols],
    )


def latest_per(df: DataFrame, keys, order, n: int = 1) -> DataFrame:
    """The newest ``n`` rows per key (sort descending, size n).

    ``n == 1`` is a partial aggregation (``max_by``).  ``n > 1`` is a ranked
    window; Spark plans it with ``WindowGroupLimit`` so each map task keeps at
    most ``n`` rows per key before the shuffle.
    """
    keys, order = _cols(keys), _cols(order)
    if n == 1:
        return _pick(df, keys, F.struct(*[F.col(c) for c in order]))
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def earliest_per(df: DataFrame, keys, order, n: int = 1) -> DataFrame:
    """The oldest ``n`` rows per key."""
    keys, order = _cols(keys), _cols(order)
    if n == 1:
        return _pick(df, keys, F.struct(*[F.col(c) for c in order]), agg=F.min_by)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_n(df: DataFrame, order, n: int, descending: bool = True) -> DataFrame:
    """Bounded result.  ``orderBy().limit()`` plans as
    ``TakeOrderedAndProject``: every task keeps its own top ``n`` and only
    those reach the final merge."""
    order = _cols(order)
    cols = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    return df.orderBy(*cols).limit(n)
