"""Duplicate submissions (J7); the streaming variant is T2.

The reference asks the store, per new job, for the earliest *other* job with
the same payload hash in some states.  Here that is one pass for all jobs:
the two earliest jobs per hash are kept (a ranked window that Spark plans
with ``WindowGroupLimit``, so every map task forwards at most two rows per
hash), then joined back on the hash.  The joined side has one row per hash,
so a hash shared by a third of all jobs multiplies nothing; the skewed
partition of the big side is split by AQE's skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEDUP_STATES = ("job-queued", "job-started", "job-completed")


def find_duplicates(jobs: DataFrame, states: Sequence[str] = DEDUP_STATES, exclude_self: bool = True,
                    id_col: str = "payload_id", hash_col: str = "payload_hash",
                    order: Sequence[str] = ("time_queued",)) -> DataFrame:
    """For every job, the earliest job with the same hash in ``states``
    (by queue time, then id), other than itself when ``exclude_self``.

    Returns all input columns plus ``dedup_job`` and ``dedup_status`` (null
    when there is no such job).
    """
    order_cols = [F.col(c).asc() for c in order] + [F.col(id_col).asc()]
    w = Window.partitionBy(hash_col).orderBy(*order_cols)
    k = 2 if exclude_self else 1
    top = (
        jobs.filter(F.col("status").isin(list(states)))
        .select(hash_col, id_col, "status", *order)
        .withColumn("_rk", F.row_number().over(w))
        .filter(F.col("_rk") <= k)
    )
    per_hash = top.groupBy(hash_col).agg(
        F.max(F.when(F.col("_rk") == 1, F.col(id_col))).alias("_id1"),
        F.max(F.when(F.col("_rk") == 1, F.col("status"))).alias("_st1"),
        F.max(F.when(F.col("_rk") == 2, F.col(id_col))).alias("_id2"),
        F.max(F.when(F.col("_rk") == 2, F.col("status"))).alias("_st2"),
    )
    df = jobs.join(per_hash, hash_col, "left")
    if exclude_self:
        use_second = F.col("_id1") == F.col(id_col)
        dup = F.when(use_second, F.col("_id2")).otherwise(F.col("_id1"))
        st = F.when(use_second, F.col("_st2")).otherwise(F.col("_st1"))
    else:
        dup, st = F.col("_id1"), F.col("_st1")
    return df.select(*jobs.columns, dup.alias("dedup_job"), st.alias("dedup_status"))


def mark_deduped(jobs: DataFrame, states: Sequence[str] = DEDUP_STATES, id_col: str = "payload_id",
                 hash_col: str = "payload_hash", order: Sequence[str] = ("time_queued",)) -> DataFrame:
    """Jobs that would be deduplicated on submission: status ``job-deduped``
    with ``dedup_job`` pointing at the earliest job in ``states`` with their
    hash.  Only an earlier job counts (by ``order``, then id), so the first of
    a hash always runs.  One row per hash crosses the join's small side."""
    place = F.struct(*order, id_col)
    first = (
        jobs.filter(F.col("status").isin(list(states)) & F.col(hash_col).isNotNull())
        .groupBy(hash_col)
        .agg(F.min_by(F.struct(F.col(id_col).alias("id"), "status", place.alias("place")), place).alias("_first"))
    )
    return (
        jobs.join(first, hash_col)
        .filter(F.col("_first.place") < place)
        .withColumns({"status": F.lit("job-deduped"), "dedup_job": F.col("_first.id"), "dedup_status": F.col("_first.status")})
        .select(*jobs.columns, "dedup_job", "dedup_status")
    )
