"""Operations queries: queue depth and scaling metric, job I/O totals, object
cleanup batches, counts, usage roll-ups, directory usage, periodicity
alerts, purges, the failed partition and disk eviction plans
(A5-A11, A13, R1, R2, R4, R5, W7).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.columns import daily_partition
from jobscope.functions.predicates import work_queues
from jobscope.operators.ranges import running
from jobscope.operators.state import latest_per


def _secs(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def queue_depth(jobs: DataFrame, queue: str = "job_queue") -> DataFrame:
    """A5: jobs waiting (queued) and in total (queued or started) per queue."""
    st = F.col("status")
    return jobs.groupBy(queue).agg(
        F.count_if(st == "job-queued").alias("waiting"),
        F.count_if(st.isin("job-queued", "job-started")).alias("total"),
    )


def jobs_per_instance(queues: DataFrame, groups: DataFrame, key: str = "group", jobs: str = "jobs",
                      desired: str = "desired", max_size: str = "max_size") -> DataFrame:
    """Target-tracking metric jobs / desired capacity.  A group at zero
    capacity with work is bootstrapped to min(jobs, max); without work the
    divisor is 1."""
    df = queues.join(groups, key, "left")
    d = F.coalesce(F.col(desired).cast("double"), F.lit(0.0))
    j = F.col(jobs).cast("double")
    eff = F.when(d == 0, F.when(j > 0, F.least(j, F.col(max_size).cast("double"))).otherwise(F.lit(1.0))).otherwise(d)
    return df.select(key, F.col(jobs).alias("jobs"), eff.alias("desired_capacity"), (j / eff).alias("metric"))


def job_io(items: DataFrame, job: str = "job_id", nbytes: str = "bytes", secs: str = "seconds") -> DataFrame:
    """Per job: number of inputs/products, total bytes and seconds, and
    the overall transfer rate (null when no time was spent)."""
    return items.groupBy(job).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum(nbytes).alias("total_bytes"),
        F.sum(secs).alias("total_seconds"),
    ).withColumn("rate", F.try_divide(F.col("total_bytes"), F.nullif(F.col("total_seconds"), F.lit(0.0))))


def append_step_metrics(jobs: DataFrame, metrics: DataFrame, job: str = "job_id", inputs: str = "inputs_localized",
                        products: str = "products_staged", download: str = "download", upload: str = "upload") -> DataFrame:
    """The transfers that a job's own steps report (``metrics``: arrays of
    the same structs, any number of rows a job) behind those the worker made."""
    def joined(c: str):
        return F.sort_array(F.flatten(F.collect_list(c)))

    m = metrics.groupBy(job).agg(joined(download).alias("_down"), joined(upload).alias("_up"))

    def both(own: str, more: str) -> Column:
        none = F.array().cast(jobs.schema[own].dataType)
        return F.concat(F.coalesce(F.col(own), none), F.coalesce(F.col(more).cast(jobs.schema[own].dataType), none))

    return jobs.join(m, job, "left").withColumns({inputs: both(inputs, "_down"), products: both(products, "_up")}).drop("_down", "_up")


def orphan_object_counts(objects: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Objects per bucket, largest first."""
    return objects.groupBy(bucket).agg(F.count(F.lit(1)).alias("n_objects")).orderBy(F.desc("n_objects"), F.asc(bucket))


DELETE_CHUNK = 1000


def delete_batches(objects: DataFrame, size: int = DELETE_CHUNK, bucket: str = "bucket", key: str = "key",
                   ranges: int | None = None) -> DataFrame:
    """Keys per bucket cut into delete requests of at most ``size``.

    Keys are numbered per bucket in key order, over ranges of a bucket's keys;
    each batch's ``collect_list`` holds at most ``size`` keys, however large
    the bucket.
    """
    before = running(objects.select(bucket, key), bucket, [key], F.lit(1), "_n", ranges)
    numbered = before.withColumn("batch", F.floor(F.col("_n") / size))
    return numbered.groupBy(bucket, "batch").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.sort_array(F.collect_list(key)).alias("keys"),
    )


def count_matching(df: DataFrame, pred: Column, name: str = "count") -> DataFrame:
    """A10: number of documents matching a condition (one partial aggregate)."""
    return df.agg(F.count_if(pred).alias(name))


def usage_rollup(stats: DataFrame, job: str = "job_id", numeric: Sequence[str] = ()) -> DataFrame:
    """Usage samples collected per job, in order of their fields, plus sum
    and max of typed fields.  A job has a bounded number of samples (one per
    container step)."""
    sample_cols = [c for c in stats.columns if c != job]
    aggs = [F.sort_array(F.collect_list(F.struct(*sample_cols))).alias("usage_stats"), F.count(F.lit(1)).alias("n_samples")]
    for c in numeric:
        aggs += [F.sum(c).alias(f"sum_{c}"), F.max(c).alias(f"max_{c}")]
    return stats.groupBy(job).agg(*aggs)


def dir_usage(files: DataFrame, roots: DataFrame, path: str = "path", length: str = "length",
              root: str = "root", ranges: int | None = None) -> DataFrame:
    """Bytes below each root directory (each distinct root once).

    In path order the files below ``d`` are those from ``d/`` up to ``d0``, the
    next text after all that begin with ``d/``.  So the bounds are placed among
    the files, the bytes before each are summed over ranges of paths, and a
    root's bytes are the difference of two sums: a file is one row however deep
    it lies, and no join is needed.
    """
    clean = F.regexp_replace(F.col(root), "/+$", "")
    bounds = F.array(F.struct(F.concat("_root", F.lit("/")).alias("p"), F.lit(-1).alias("sign")),
                     F.struct(F.concat("_root", F.lit("0")).alias("p"), F.lit(1).alias("sign")))
    marks = roots.select(clean.alias("_root")).where(F.col("_root").isNotNull()).distinct().withColumn("_b", F.explode(bounds)).select(
        F.lit(0).alias("_all"), F.col("_b.p").alias("_path"), F.lit(0).alias("_file"), F.lit(0).cast("long").alias("_bytes"), "_root", F.col("_b.sign").alias("_sign"))
    rows = files.where(F.col(path).isNotNull()).select(
        F.lit(0).alias("_all"), F.col(path).alias("_path"), F.lit(1).alias("_file"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("_bytes"),
        F.lit(None).cast("string").alias("_root"), F.lit(None).cast("int").alias("_sign"))
    before = running(marks.unionByName(rows), "_all", ["_path", "_file"], "_bytes", "_before", ranges).where(F.col("_file") == 0)
    shown = F.when(F.col("_root") == "", F.lit("/")).otherwise(F.col("_root"))
    return before.groupBy(shown.alias(root)).agg(F.sum(F.col("_sign") * F.col("_before")).alias("bytes"))


def overdue_job_types(jobs: DataFrame, as_of, periodicity: float = 0.0, job_type: str = "job_type",
                      id_col: str = "payload_id") -> DataFrame:
    """Per job type, alert when there is no completed job yet, or the last
    completed one ended longer ago than its own time limit (else the given
    periodicity).  The newest failure is attached."""
    now = F.lit(as_of).cast("timestamp")
    # one pass: of each type the newest finished and the newest failed job
    newest = F.struct("time_end", F.col(id_col).alias("id"))
    row = F.struct(F.col(id_col).alias("id"), "time_end", "time_limit")
    per = jobs.groupBy(job_type).agg(
        F.max_by(row, F.when(F.col("status") == "job-completed", newest)).alias("_done"),
        F.max_by(row, F.when(F.col("status") == "job-failed", newest)).alias("_failed"),
    )
    df = per.select(job_type, F.col("_done.id").alias("last_success_id"), F.col("_done.time_end").alias("last_success_end"), F.col("_done.time_limit").alias("limit"),
                    F.col("_failed.id").alias("last_failed_id"), F.col("_failed.time_end").alias("last_failed_end"))
    age = _secs(now, F.col("last_success_end"))
    allowed = F.coalesce(F.col("limit").cast("double"), F.lit(float(periodicity)))
    reason = F.when(F.col("last_success_id").isNull(), "no_success").when(age > allowed, "overdue")
    return df.select(job_type, "last_success_id", "last_success_end", age.alias("age_secs"), "last_failed_id",
                     "last_failed_end", reason.alias("reason")).filter(F.col("reason").isNotNull())


def stuck_queues(queue_stats: DataFrame, jobs: DataFrame, as_of, periodicity: float = 0.0,
                 internal: Sequence[str] = (), queue: str = "queue", job_queue: str = "job_queue",
                 id_col: str = "payload_id") -> DataFrame:
    """R2: work queues with messages ready and none being worked on; queues
    with no job ever; queues whose newest job started longer ago than its
    limit (else the given periodicity).  The periodicity applies per row."""
    now = F.lit(as_of).cast("timestamp")
    q = work_queues(queue_stats, internal, name=queue)
    newest = latest_per(
        jobs.filter(F.col("time_start").isNotNull()).select(F.col(job_queue).alias(queue), id_col, "time_start", "time_limit"),
        queue, ["time_start", id_col],
    )
    df = q.join(newest, queue, "left")
    age = _secs(now, F.col("time_start"))
    allowed = F.coalesce(F.col("time_limit").cast("double"), F.lit(float(periodicity)))
    reason = (
        F.when((F.col("messages_ready") > 0) & (F.col("messages_unacknowledged") == 0), "no_job_running")
        .when(F.col(id_col).isNull(), "no_job_found")
        .when(age > allowed, "job_hanging")
    )
    return df.select(queue, "messages", "messages_ready", "messages_unacknowledged", F.col(id_col).alias("last_job_id"),
                     age.alias("age_secs"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def purge(df: DataFrame, statuses: Sequence[str], before=None, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(kept, removed) for jobs of the given statuses older than
    ``before`` (all of them when ``before`` is None)."""
    cond = F.col("status").isin(list(statuses))
    if before is not None:
        cond = cond & (F.col(ts) < F.lit(before).cast("timestamp"))
    cond = F.coalesce(cond, F.lit(False))
    return df.filter(~cond), df.filter(cond)


FAILED_PARTITION = "job_failed"


def move_failed(jobs: DataFrame, index: str = "index") -> DataFrame:
    """Of current job documents with the ``index`` that stores them, failed
    ones move to the failed partition and remember where they were
    (``orig_index``); ``delete_from`` is the index their old copy goes from.
    Others, and failed ones that are there already, stay."""
    move = (F.col("status") == "job-failed") & (F.col(index) != FAILED_PARTITION)
    move = F.coalesce(move, F.lit(False))
    return jobs.withColumns({
        index: F.when(move, F.lit(FAILED_PARTITION)).otherwise(F.col(index)),
        "orig_index": F.when(move, F.col(index)),
        "delete_from": F.when(move, F.col(index)),
    })


# Eviction classes in the order they are cleaned.  Fixed values.
EVICTION_ORDER = ("task", "job_ok", "job_other", "cache")


def eviction_plan(items: DataFrame, need, host: str = "host", cls: str = "class", nbytes: str = "bytes",
                  order="path", cache_ts: str = "ts", ranges: int | None = None) -> DataFrame:
    """Which finished items a host deletes to free ``need`` bytes.

    Classes are cleaned in order: finished tasks, zero-exit jobs, other
    finished jobs, then the cache newest first; within a class in path
    order (then any further ``order`` columns, which should make the order
    total).  An item is deleted while the bytes freed before it are still
    short of the need.  ``need`` is a number or a column (per host).  The
    bytes before an item are summed over ranges of a host's items.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in EVICTION_ORDER]), F.col(cls))
    cache_key = F.when(F.col(cls) == "cache", -F.unix_micros(F.col(cache_ts)))
    order_cols = [order] if isinstance(order, str) else list(order)
    placed = items.withColumns({"_rank": rank, "_newest": cache_key})
    need_col = need if isinstance(need, Column) else F.lit(float(need))
    freed = running(placed, host, ["_rank", "_newest", *order_cols], nbytes, "freed_before", ranges)
    freed = freed.withColumn("freed_before", F.col("freed_before").cast("double"))
    return freed.withColumn("delete", F.col("freed_before") < need_col).drop("_rank", "_newest")
