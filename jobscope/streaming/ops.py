"""Structured Streaming operators.

Each takes a streaming DataFrame (``readStream`` of a log) and returns a
streaming DataFrame or starts a query.  State lives in Spark's state store
(RocksDB provider set by ``get_spark``), checkpointed under the cluster's
``spark.checkpoint.dir``, so a lost executor or a restarted driver resumes
from the last committed micro-batch.  Event-time watermarks bound state:
the reference has none (it applies records in arrival order); here late
records beyond the watermark are dropped by Spark, which is stated per
operator.

Keyed state is per job, hash or worker; T2-T5 are state machines on
``transformWithStateInPandas`` with event-time timers (see ``processors``).  A
log that arrives in time order gives the same rows however it is cut into
batches; gaps inside a batch are seen as well as those that a timer ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope import TERMINAL_JOB_STATUSES
from jobscope.functions.columns import failure_class
from jobscope.operators.drain import STATE, drained
from jobscope.operators.metrics import kind_of_path, parse_metric_lines
from jobscope.operators.ranges import neighbour
from jobscope.session import DEFAULT_CONF, checkpoint_dir
from jobscope.streaming import processors as P


def stream_base(spark: SparkSession, name: str) -> str:
    """A stream's folder below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def run_available(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a streaming query over everything available now into Parquet in the
    shared folder, and read that (for tests and registered checks).

    Each micro-batch overwrites its own ``batch=<id>`` folder, so a replayed
    one replaces its earlier output.  The result has the column ``batch``.
    """
    spark = df.sparkSession
    base = stream_base(spark, name)
    out, schema = f"{base}/out", df.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def batch(bdf: DataFrame, batch_id: int):
        bdf.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (df.writeStream.foreachBatch(batch).outputMode(mode)
         .option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).parquet(out)


def latest_output(out: DataFrame, key: str) -> DataFrame:
    """The newest row per key of an update-mode query's output."""
    rest = [c for c in out.columns if c not in (key, "batch")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(key, "_row.*")


def use_rocksdb(spark: SparkSession) -> None:
    """List state and timers need the RocksDB provider, whatever session the caller has."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, None) != DEFAULT_CONF[name]:
        spark.conf.set(name, DEFAULT_CONF[name])


def _seq(events: DataFrame) -> list[str]:
    return ["seq"] if "seq" in events.columns else []


#: Buckets that keys, and slots of keys, are dealt to: a call of a processor and a list in the state store each.
BUCKETS = 4096


def _bucket(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS))


def _compacted(events: DataFrame, key: str, slot_secs: int, delay: str, keep: Callable, by: Sequence[str]) -> DataFrame:
    """Events with a time and a watermark, of each (key, slot of ``slot_secs``) and batch those that ``keep`` picks.

    A slot of a key lies in one bucket, which a call of the processor takes whole.
    """
    use_rocksdb(events.sparkSession)
    ev = events.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
    columns, schema = ev.columns, ev.schema
    ev = ev.withColumn("_bucket", _bucket(key, F.floor(F.unix_micros("ts") / (slot_secs * 1_000_000))))
    by = [c for c in by if c in columns]
    return ev.groupBy("_bucket").transformWithStateInPandas(P.Compact(keep, by, columns, key, slot_secs), schema, "append", "eventTime", eventTimeColumnName="ts")


def _stateful(events: DataFrame, key: str, processor: P.Keyed, schema: str) -> DataFrame:
    return events.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


def _in_buckets(events: DataFrame, key: str, processor: P.Bucket, schema: str) -> DataFrame:
    return _stateful(events.withColumn("_bucket", _bucket(key)), "_bucket", processor, schema)


# ---------------------------------------------------------------- T1 -----


def stream_current_state(events: DataFrame, key: str = "payload_id", guarded: bool = True,
                         watermark: str | None = None) -> DataFrame:
    """A1/A2 continuously: a streaming aggregation keeping, per key, the
    write with the highest precedence ((terminal, authoritative,) ts, seq).
    Emit in ``update`` mode: each batch gives the keys it changed, and
    ``latest_output`` of them is the current state.  State is one row per key,
    as the current state is; give ``watermark`` and a time window as part of
    the key to let it expire."""
    cols = [c for c in events.columns if c != key]
    term = F.col("status").isin(*TERMINAL_JOB_STATUSES)
    if guarded:
        sup = F.coalesce(F.col("supervisory"), F.lit(False)) if "supervisory" in events.columns else F.lit(False)
        order = F.struct(term, term & ~sup, F.col("ts"), F.col("seq"))
    else:
        order = F.struct(F.col("ts"), F.col("seq"))
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_row")).select(key, "_row.*")


# ---------------------------------------------------------------- T2 -----


FIRST_SCHEMA = "payload_hash string, payload_id string, ts timestamp"


def stream_first_by_hash(specs: DataFrame, ttl_secs: int = 86400, hash_col: str = "payload_hash",
                         id_col: str = "payload_id") -> DataFrame:
    """The first submission per payload hash; later ones are dropped until
    the TTL, which runs from the first one, is over.  State: the time of the
    hash's current first submission, removed when the watermark passes its TTL."""
    ev = specs.select(F.col(hash_col).alias("payload_hash"), F.col(id_col).alias("payload_id"), "ts", *_seq(specs))
    ev = _compacted(ev, "payload_hash", max(1, ttl_secs // 24), f"{ttl_secs} seconds", P.first_of_each_time, ["ts", "seq", "payload_id"])
    return _in_buckets(ev, "payload_hash", P.FirstByHash(ttl_secs, "payload_hash"), FIRST_SCHEMA)


# ------------------------------------------------------------ T3, T4 -----

ALIVE_SCHEMA = "celery_hostname string, status string, ts timestamp"


def stream_worker_alive(events: DataFrame, ttl_secs: int = 60, host: str = "celery_hostname") -> DataFrame:
    """A worker is alive while heartbeats are at most ``ttl`` apart;
    ``worker-offline`` clears it at once; without a further event it expires
    when the watermark passes the last heartbeat + ttl.  A row per change:
    alive, offline, expired."""
    ev = events.select(F.col(host).alias("celery_hostname"), "status", "ts", *_seq(events))
    ev = _compacted(ev, "celery_hostname", ttl_secs, f"{ttl_secs} seconds", P.ends_of_stretches, ["ts", "seq"])
    return _stateful(ev, "celery_hostname", P.WorkerAlive(ttl_secs), ALIVE_SCHEMA)


def worker_alive_batch(events: DataFrame, ttl_secs: int = 60, host: str = "celery_hostname",
                       ranges: int | None = None) -> DataFrame:
    """T3 batch form: each heartbeat is followed by an expiry when the next
    event of the worker comes more than ``ttl`` later.  A worker's events may
    lie in many ranges, whose border rows are exchanged."""
    out = neighbour(events, host, ["ts", "seq"], "ts", "_next", back=False, ranges=ranges)
    gap = (F.unix_micros("_next.value") - F.unix_micros(F.col("ts"))) / 1e6
    expires = (F.col("status") != "worker-offline") & (F.col("_next").isNull() | (gap > ttl_secs))
    return out.withColumns({"next_ts": F.col("_next.value"), "expires": expires}).drop("_next")


TIMEOUT_SCHEMA = "key string, last_status string, last_ts timestamp, timed_out_at timestamp"


def stream_timeouts(events: DataFrame, timeout_secs: int, key: str = "payload_id") -> DataFrame:
    """T4: a key with no update for longer than ``timeout`` seconds (event
    time) yields a row.  A terminal status stops watching the key, and what
    comes within ``timeout`` of it does not start it again (A2)."""
    ev = events.select(F.col(key).alias("key"), "status", "ts", *_seq(events))
    ev = _compacted(ev, "key", timeout_secs, f"{timeout_secs} seconds", P.ends_of_work, ["ts", "seq"])
    return _in_buckets(ev, "key", P.Timeouts(timeout_secs, "key"), TIMEOUT_SCHEMA)


# ---------------------------------------------------------------- T5 -----

FAIL_SCHEMA = "uuid string, error string, short_error string, failed_at timestamp"


def stream_failed_tasks(task_events: DataFrame, job_events: DataFrame, grace_secs: int = 300,
                        keep_secs: int = 86400) -> DataFrame:
    """T5: a supervisory task failure fails the job once the grace period has
    passed, unless the job has a terminal status up to then, or has had one
    within ``keep_secs`` before.  State: the failures that wait, and the time
    of the last terminal status until the watermark is ``keep_secs`` past it."""
    t = task_events.select("uuid", "status", "ts", F.col("event.exception").alias("exception"))
    t = t.withColumn("cls", F.when(F.col("status") == "task-failed", failure_class(F.col("exception"))))
    t = t.filter(F.col("cls").isNotNull()).select("uuid", F.lit(False).alias("terminal"), "ts", "exception", "cls")
    j = job_events.filter(F.col("status").isin(*TERMINAL_JOB_STATUSES)).select(
        "uuid", F.lit(True).alias("terminal"), "ts", F.lit(None).cast("string").alias("exception"),
        F.lit(None).cast("string").alias("cls"))
    ev = _compacted(t.unionByName(j), "uuid", grace_secs, f"{grace_secs} seconds", P.failures_and_ends, ["ts"])
    return _in_buckets(ev, "uuid", P.FailedTasks(grace_secs, keep_secs, "uuid"), FAIL_SCHEMA)


# ---------------------------------------------------------------- T6 -----


def stream_rules(finished: DataFrame, rules_reader, sink, checkpoint: str, id_col: str = "payload_id",
                 name_prefix: str | None = None, trigger: dict | None = None):
    """Rule matches per micro-batch; rules are re-read every batch
    (``rules_reader(spark)`` returns the current rules table)."""
    from jobscope.operators.rules import match_job_rules

    def batch(bdf: DataFrame, batch_id: int):
        rules = rules_reader(bdf.sparkSession)
        sink(match_job_rules(bdf, rules, id_col=id_col, name_prefix=name_prefix).withColumn("batch_id", F.lit(batch_id)),
             batch_id)

    return (finished.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def batch_files(spark: SparkSession, name: str):
    """A sink for ``foreachBatch``: each batch's rows in its own folder of the stream's output."""
    def sink(df: DataFrame, batch_id: int):
        df.write.mode("overwrite").parquet(f"{stream_base(spark, name)}/out/batch={batch_id}")

    return sink


def batch_rows(spark: SparkSession, name: str) -> DataFrame:
    """What ``batch_files`` has written so far, with the column ``batch``."""
    return spark.read.option("mergeSchema", "true").parquet(f"{stream_base(spark, name)}/out")


# ---------------------------------------------------------------- T7 -----


def stream_metric_log(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    """Metric-log lines parsed as they arrive (same parser as S5)."""
    lines = (spark.readStream.format("text").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.sdswatch.log").load(path)
             .select("value", F.col("_metadata.file_path").alias("log_path")))
    lines = lines.withColumn("kind", kind_of_path("log_path"))
    return parse_metric_lines(lines.filter(F.col("kind").isNotNull()), host=host)


# ---------------------------------------------------------------- T8 -----

def stream_job_drain(events: DataFrame, name: str, threshold: int = 10, window_secs: float = 5.0,
                     host: str = "celery_hostname", pid: str | None = None, checkpoint: str | None = None,
                     trigger: dict | None = None):
    """W3 over a stream: starts the query and returns it.

    A micro-batch is scanned as W3 scans a log (a busy worker's rows are spread
    over tasks), from the workers' states that the batch before it left.  Each
    batch writes its rows to ``batch=<id>`` of the stream's ``out`` and the
    states of all workers to ``batch=<id>`` of ``state``, from which it never
    reads its own, so a batch that is run again gives the same.
    """
    spark = events.sparkSession
    base = stream_base(spark, name)

    def batch(bdf: DataFrame, batch_id: int):
        before = spark.read.schema(STATE).parquet(f"{base}/state/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], STATE)
        found, after = drained(bdf, threshold, window_secs, host, pid, before)
        found.select("host", "ts", "count", "drain").write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
        seen = after.select(F.col("host").alias("_host"))
        silent = before.join(seen, F.col("host").eqNullSafe(F.col("_host")), "left_anti")
        after.select(*silent.columns).unionByName(silent).write.mode("overwrite").parquet(f"{base}/state/batch={batch_id}")

    return (events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{base}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def drain_rows(spark: SparkSession, name: str) -> DataFrame:
    """What a T8 stream has given so far: host, ts, count, drain, batch."""
    schema = "host string, ts timestamp, count long, drain boolean, batch long"
    spark.createDataFrame([], schema).drop("batch").write.mode("overwrite").parquet(f"{stream_base(spark, name)}/out/batch=-1")
    return spark.read.schema(schema).parquet(f"{stream_base(spark, name)}/out")


# ---------------------------------------------------------------- T9 -----


def log_chunks(lines: DataFrame, interval: str = "1 second", id_col: str = "id", stream: str = "type",
               order: str = "seq", chunk: str = "chunk", watermark: str | None = None) -> DataFrame:
    """Output of each job and stream concatenated per send interval
    (epoch-aligned tumbling windows), in line order.  Works on batch and
    streaming input (give ``watermark`` for append mode)."""
    if watermark:
        lines = lines.withWatermark("ts", watermark)
    g = lines.groupBy(id_col, stream, F.window("ts", interval).alias("w")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(chunk).alias("c")))).alias("_parts"))
    return g.select(id_col, stream, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    F.array_join(F.transform("_parts", lambda x: x["c"]), "").alias("chunk"),
                    F.size("_parts").alias("n_lines"))
