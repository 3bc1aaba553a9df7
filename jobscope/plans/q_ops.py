"""Registered queries: operations (queues, scaling, I/O, cleanup, alerts,
purge, failed partition, eviction)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.functions.columns import daily_partition
from jobscope.operators import ops as O
from jobscope.operators import state
from jobscope.plans.oracle import ORD_AS_OF, with_adapters
from jobscope.plans.registry import register
from jobscope.sources import adapters as A


@register(
    "a5_queue_depth",
    with_adapters("""
SELECT job_queue, count(*) FILTER (WHERE status = 'job-queued') AS waiting,
       count(*) FILTER (WHERE status IN ('job-queued', 'job-started')) AS total
FROM jobs GROUP BY job_queue"""),
)
def a5_queue_depth(spark, sf):
    """A5: waiting and total jobs per queue."""
    return O.queue_depth(A.jobs(spark, sf).select("job_queue", "status"))


@register(
    "a6_jobs_per_instance",
    with_adapters("""
WITH q AS (SELECT c.c_nationkey AS "group", count(*) AS jobs FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
           WHERE o.o_orderstatus = 'P' GROUP BY c.c_nationkey),
g AS (SELECT s_nationkey AS "group", count(*) AS desired, 10 AS max_size FROM supplier GROUP BY s_nationkey),
e AS (SELECT q."group", q.jobs,
             CASE WHEN coalesce(CAST(g.desired AS DOUBLE), 0) = 0
                  THEN CASE WHEN q.jobs > 0 THEN least(CAST(q.jobs AS DOUBLE), CAST(g.max_size AS DOUBLE)) ELSE 1.0 END
                  ELSE CAST(g.desired AS DOUBLE) END AS desired_capacity
      FROM q LEFT JOIN g USING ("group"))
SELECT "group", jobs, desired_capacity, jobs / desired_capacity AS metric FROM e"""),
)
def a6_jobs_per_instance(spark, sf):
    """Waiting jobs per nation queue over its instance group's capacity."""
    o = A.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    c = A.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    queues = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("group")).agg(
        F.count(F.lit(1)).alias("jobs"))
    groups = A.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("group")).agg(
        F.count(F.lit(1)).alias("desired"), F.lit(10).alias("max_size"))
    return O.jobs_per_instance(queues, groups)


@register(
    "a7_job_io",
    with_adapters("""
SELECT job_id, count(*) AS n_items, sum(bytes) AS total_bytes, sum(seconds) AS total_seconds,
       sum(bytes) / nullif(sum(seconds), 0.0) AS rate
FROM products GROUP BY job_id"""),
    bench=True,
)
def a7_job_io(spark, sf):
    """Per job, staged product count, bytes, seconds and rate."""
    return O.job_io(A.products(spark, sf).select("job_id", "bytes", "seconds"))


@register("a7_step_metrics", with_adapters("""
SELECT job_id, count(*) FILTER (WHERE flag = 'R' OR flag = 'A' AND n % 2 = 1) AS n_inputs, count(*) FILTER (WHERE flag = 'N' OR flag = 'A' AND n % 2 = 0) AS n_products,
       CAST(coalesce(sum(partkey) FILTER (WHERE flag = 'R' OR flag = 'A' AND n % 2 = 1), 0) AS BIGINT) AS input_keys
FROM products GROUP BY job_id HAVING count(*) FILTER (WHERE flag <> 'A') > 0"""))
def a7_step_metrics(spark, sf):
    """jobs' transfers with those their steps report (returned products of
    the adapted data are inputs, accepted ones what the steps moved)."""
    p = A.products(spark, sf)
    one = F.struct("url", "partkey")
    jobs = p.where("flag <> 'A'").groupBy("job_id").agg(F.collect_list(F.when(F.col("flag") == "R", one)).alias("inputs_localized"), F.collect_list(F.when(F.col("flag") == "N", one)).alias("products_staged"))
    metrics = p.where("flag = 'A'").select("job_id", F.array_compact(F.array(F.when(F.col("n") % 2 == 1, one))).alias("download"), F.array_compact(F.array(F.when(F.col("n") % 2 == 0, one))).alias("upload"))
    out = O.append_step_metrics(jobs, metrics)
    return out.select("job_id", F.size("inputs_localized").cast("long").alias("n_inputs"), F.size("products_staged").cast("long").alias("n_products"),
                      F.aggregate("inputs_localized", F.lit(0).cast("long"), lambda a, x: a + x["partkey"]).alias("input_keys"))


@register(
    "a8_orphan_object_counts",
    with_adapters("SELECT bucket, count(*) AS n_objects FROM paths GROUP BY bucket"),
)
def a8_orphan_object_counts(spark, sf):
    """Objects per bucket."""
    return O.orphan_object_counts(A.paths(spark, sf).select("bucket"))


@register(
    "a9_delete_batches",
    with_adapters("""
WITH k AS (SELECT 'products' AS bucket, url AS key FROM products),
n AS (SELECT bucket, key, floor((row_number() OVER (PARTITION BY bucket ORDER BY key) - 1) / 1000) AS batch FROM k)
SELECT bucket, CAST(batch AS BIGINT) AS batch, count(*) AS n_keys, CAST(to_json(list_sort(list(key))) AS VARCHAR) AS keys
FROM n GROUP BY bucket, batch"""),
)
def a9_delete_batches(spark, sf):
    """The one bucket's staged objects cut into delete requests of 1000 keys."""
    objs = A.products(spark, sf).select(F.lit("products").alias("bucket"), F.col("url").alias("key"))
    return O.delete_batches(objs).withColumn("batch", F.col("batch").cast("bigint"))


@register(
    "a10_count_matching",
    with_adapters("SELECT count(*) FILTER (WHERE n_chars > 1000 AND system_version = 'en') AS count FROM catalog_docs"),
)
def a10_count_matching(spark, sf):
    """A10: number of catalog documents matching a condition."""
    d = A.catalog_docs(spark, sf)
    return O.count_matching(d, (F.col("n_chars") > 1000) & (F.col("system_version") == "en"))


@register("a11_usage_rollup", with_adapters("""
SELECT job_id, CAST(to_json(list(struct_pack(n := n, partkey := partkey) ORDER BY n, partkey)) AS VARCHAR) AS usage_stats, count(*) AS n_samples,
       CAST(sum(partkey) AS BIGINT) AS sum_partkey, max(partkey) AS max_partkey FROM products GROUP BY job_id"""))
def a11_usage_rollup(spark, sf):
    """Each job's samples with sums and maxima."""
    return O.usage_rollup(A.products(spark, sf).select("job_id", "n", "partkey"), numeric=["partkey"])


@register(
    "a13_dir_usage",
    with_adapters("""
WITH f AS (SELECT '/' || bucket || regexp_extract(path, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1) AS p, length(html) AS len FROM paths),
parts AS (SELECT len, string_split(p, '/') AS s FROM f),
anc AS (SELECT len, array_to_string(s[1:i], '/') AS root FROM parts, range(1, len(s)) AS t(i)),
roots AS (SELECT DISTINCT '/' || bucket AS root FROM paths),
a2 AS (SELECT CASE WHEN root = '' THEN '/' ELSE root END AS root, len FROM anc)
SELECT r.root, CAST(coalesce(sum(a2.len), 0) AS BIGINT) AS bytes FROM roots r LEFT JOIN a2 USING (root) GROUP BY r.root"""),
)
def a13_dir_usage(spark, sf):
    """Bytes of page bodies below each host directory."""
    p = A.paths(spark, sf)
    files = p.select(
        F.concat(F.lit("/"), F.col("bucket"), F.regexp_extract("path", r"^[a-z]+://[^/?#]+(/[^?#]*)?", 1)).alias("path"),
        F.length("html").cast("bigint").alias("length"),
    )
    roots = p.select(F.concat(F.lit("/"), F.col("bucket")).alias("root")).distinct()
    return O.dir_usage(files, roots)


@register(
    "r1_overdue_job_types",
    with_adapters(f"""
WITH j AS (SELECT * REPLACE (CASE WHEN status = 'job-completed' AND (custkey % 7 = 0 OR job_type = '2-HIGH') THEN 'job-failed' ELSE status END AS status) FROM jobs),
d AS (SELECT job_type, payload_id, time_end, time_limit,
                  row_number() OVER (PARTITION BY job_type ORDER BY time_end DESC, payload_id DESC) AS rn
           FROM j WHERE status = 'job-completed'),
f AS (SELECT job_type, payload_id, time_end, row_number() OVER (PARTITION BY job_type ORDER BY time_end DESC, payload_id DESC) AS rn
      FROM j WHERE status = 'job-failed'),
t AS (SELECT DISTINCT job_type FROM jobs),
x AS (SELECT t.job_type, d.payload_id AS last_success_id, d.time_end AS last_success_end,
             (epoch_us({ORD_AS_OF}) - epoch_us(d.time_end)) / 1e6 AS age_secs,
             f.payload_id AS last_failed_id, f.time_end AS last_failed_end,
             CASE WHEN d.payload_id IS NULL THEN 'no_success'
                  WHEN (epoch_us({ORD_AS_OF}) - epoch_us(d.time_end)) / 1e6 > coalesce(CAST(d.time_limit AS DOUBLE), 0.0) THEN 'overdue' END AS reason
      FROM t LEFT JOIN (SELECT * FROM d WHERE rn = 1) d USING (job_type) LEFT JOIN (SELECT * FROM f WHERE rn = 1) f USING (job_type))
SELECT * FROM x WHERE reason IS NOT NULL"""),
)
def r1_overdue_job_types(spark, sf):
    """Job types with no recent enough success; some finished jobs of the
    adapted data count as failed, and all of one type."""
    failed = (F.col("status") == "job-completed") & ((F.col("custkey") % 7 == 0) | (F.col("job_type") == "2-HIGH"))
    j = A.jobs(spark, sf).withColumn("status", F.when(failed, "job-failed").otherwise(F.col("status")))
    j = j.select("job_type", "payload_id", "status", "time_end", "time_limit")
    return O.overdue_job_types(j, A.ORDERS_AS_OF, periodicity=0.0)


@register(
    "r2_stuck_queues",
    with_adapters(f"""
WITH qs AS (SELECT job_queue AS queue, count(*) FILTER (WHERE status IN ('job-queued', 'job-started')) AS messages,
                   count(*) FILTER (WHERE status = 'job-queued') AS messages_ready,
                   count(*) FILTER (WHERE status = 'job-started' AND celery_hostname = 'w7') AS messages_unacknowledged
            FROM jobs GROUP BY job_queue),
q AS (SELECT * FROM qs WHERE NOT starts_with(queue, 'celery') AND queue <> 'Recommended Queues' AND messages_ready > 0),
n AS (SELECT job_queue AS queue, payload_id, time_start, time_limit,
             row_number() OVER (PARTITION BY job_queue ORDER BY time_start DESC, payload_id DESC) AS rn
      FROM jobs WHERE time_start IS NOT NULL),
x AS (SELECT q.*, n.payload_id AS last_job_id, (epoch_us({ORD_AS_OF}) - epoch_us(n.time_start)) / 1e6 AS age_secs,
             CASE WHEN q.messages_ready > 0 AND q.messages_unacknowledged = 0 THEN 'no_job_running'
                  WHEN n.payload_id IS NULL THEN 'no_job_found'
                  WHEN (epoch_us({ORD_AS_OF}) - epoch_us(n.time_start)) / 1e6 > coalesce(CAST(n.time_limit AS DOUBLE), 0.0) THEN 'job_hanging' END AS reason
      FROM q LEFT JOIN (SELECT * FROM n WHERE rn = 1) n USING (queue))
SELECT queue, messages, messages_ready, messages_unacknowledged, last_job_id, age_secs, reason FROM x WHERE reason IS NOT NULL"""),
)
def r2_stuck_queues(spark, sf):
    """R2: stuck queues from queue statistics and the newest job per queue."""
    j = A.jobs(spark, sf)
    st = F.col("status")
    stats = j.groupBy(F.col("job_queue").alias("queue")).agg(
        F.count_if(st.isin("job-queued", "job-started")).alias("messages"),
        F.count_if(st == "job-queued").alias("messages_ready"),
        F.count_if((st == "job-started") & (F.col("celery_hostname") == "w7")).alias("messages_unacknowledged"),
    )
    return O.stuck_queues(stats, j.select("job_queue", "payload_id", "time_start", "time_limit"), A.ORDERS_AS_OF)


@register(
    "r4_purge",
    with_adapters("""
SELECT payload_id, status, time_start, coalesce(status = 'job-started' AND time_start < TIMESTAMP '1998-01-01 00:00:00', false) AS removed
FROM jobs"""),
)
def r4_purge(spark, sf):
    """Started jobs older than a cut-off are removed, all others kept."""
    j = A.jobs(spark, sf).select("payload_id", "status", "time_start")
    kept, removed = O.purge(j, ["job-started"], "1998-01-01 00:00:00", ts="time_start")
    return kept.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True)))


@register(
    "r5_move_failed",
    with_adapters("""
WITH first AS (SELECT payload_id, 'job_status-' || strftime(min(ts), '%Y.%m.%d') AS stored FROM job_events GROUP BY payload_id),
live_row AS (
  SELECT * FROM (SELECT payload_id, status, row_number() OVER (PARTITION BY payload_id ORDER BY
      (status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked')) DESC,
      (status IN ('job-completed','job-failed','job-deduped','job-offline','job-revoked') AND NOT supervisory) DESC,
      ts DESC, seq DESC) AS rn FROM job_events) WHERE rn = 1)
SELECT payload_id, status, if(status = 'job-failed', 'job_failed', stored) AS "index",
       if(status = 'job-failed', stored, NULL) AS orig_index, if(status = 'job-failed', stored, NULL) AS delete_from
FROM live_row JOIN first USING (payload_id)"""),
)
def r5_move_failed(spark, sf):
    """Current job documents, stored in the daily index of their first
    write; failed ones move to the failed partition."""
    ev = A.job_events(spark, sf).select("payload_id", "status", "ts", "seq", "supervisory")
    current = state.timeline_and_state(ev, "payload_id")
    first = ev.groupBy("payload_id").agg(F.min("ts").alias("first"))
    docs = current.join(first, "payload_id").select("payload_id", F.col("current_status").alias("status"), daily_partition("job_status", "first").alias("index"))
    return O.move_failed(docs)


@register(
    "w7_eviction_plan",
    with_adapters("""
WITH i AS (SELECT 'w' || CAST(suppkey % 20 AS VARCHAR) AS host, url AS path, bytes, time_end AS ts,
                  CASE WHEN flag = 'R' THEN 'task' WHEN flag = 'A' THEN 'job_ok'
                       WHEN line_status = 'O' THEN 'job_other' ELSE 'cache' END AS class
           FROM products),
r AS (SELECT *, CASE class WHEN 'task' THEN 1 WHEN 'job_ok' THEN 2 WHEN 'job_other' THEN 3 ELSE 4 END AS rk,
             CASE WHEN class = 'cache' THEN -epoch_us(ts) END AS ck FROM i)
SELECT host, path, class, bytes,
       coalesce(sum(bytes) OVER (PARTITION BY host ORDER BY rk, ck NULLS FIRST, path, bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS freed_before,
       coalesce(sum(bytes) OVER (PARTITION BY host ORDER BY rk, ck NULLS FIRST, path, bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) < 5000000.0 AS "delete"
FROM r"""),
)
def w7_eviction_plan(spark, sf):
    """Per host, the finished items to delete to free 5 MB."""
    p = A.products(spark, sf)
    cls = (F.when(F.col("flag") == "R", "task").when(F.col("flag") == "A", "job_ok")
           .when(F.col("line_status") == "O", "job_other").otherwise("cache"))
    items = p.select(F.concat(F.lit("w"), (F.col("suppkey") % 20).cast("string")).alias("host"), F.col("url").alias("path"),
                     "bytes", F.col("time_end").alias("ts"), cls.alias("class"))
    return O.eviction_plan(items, 5_000_000, order=["path", "bytes"]).select("host", "path", "class", "bytes", "freed_before", "delete")


# ------------------------------------------------------ orchestration ----

from jobscope.operators import orchestrate as ORC  # noqa: E402

# Orchestrator configuration used by the registered fan-out: two types are
# configured (one with two creators), the others fall to the catch-all.
ORCH_CONFIG = [
    ("job:1-URGENT", "urgent_a", "creators.urgent_a", ["q-urgent", "q-fast"]),
    ("job:1-URGENT", "urgent_b", "creators.urgent_b", []),
    ("job:2-HIGH", "high", "creators.high", ["q-high"]),
]


def _specs(spark, sf):
    o = A.table(spark, sf, "orders")
    jt = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("job:"), F.col("o_orderpriority")))
    payload = F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).otherwise(F.col("o_custkey").cast("string"))
    return o.select(F.col("o_orderkey").cast("string").alias("spec_id"), jt.alias("job_type"),
                    F.when(F.col("o_totalprice") > 300000, F.lit("q-big")).alias("job_queue"), payload.alias("payload"))


@register(
    "j16_fan_out_jobs",
    with_adapters("""
WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS spec_id,
                  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE 'job:' || o_orderpriority END AS job_type,
                  CASE WHEN o_totalprice > 300000 THEN 'q-big' END AS job_queue,
                  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS payload FROM orders),
cfg AS (SELECT * FROM (VALUES ('job:1-URGENT', 'urgent_a', 'creators.urgent_a', 'q-urgent'),
                              ('job:1-URGENT', 'urgent_a', 'creators.urgent_a', 'q-fast'),
                              ('job:1-URGENT', 'urgent_b', 'creators.urgent_b', NULL),
                              ('job:2-HIGH', 'high', 'creators.high', 'q-high')) t(job_type, job_name, function, q)),
ok AS (SELECT * FROM s WHERE job_type IS NOT NULL AND payload IS NOT NULL)
SELECT ok.spec_id, ok.job_type, cfg.job_name, cfg.function, coalesce(cfg.q, ok.job_queue, 'default') AS job_queue,
       'job-queued' AS status, CAST(NULL AS VARCHAR) AS error
FROM ok JOIN cfg USING (job_type)
UNION ALL
SELECT spec_id, job_type, regexp_extract(job_type, '^\\w+?:(.*)$', 1), 'catch_all', coalesce(job_queue, 'default'), 'job-queued', NULL
FROM ok WHERE job_type NOT IN (SELECT job_type FROM cfg)
UNION ALL
SELECT spec_id, job_type, NULL, NULL, NULL, 'job-failed',
       'Error queueing job from orchestrator: Invalid job spec. No ''' || CASE WHEN job_type IS NULL THEN 'job_type' ELSE 'payload' END || ''' specified.'
FROM s WHERE job_type IS NULL OR payload IS NULL"""),
)
def j16_fan_out_jobs(spark, sf):
    """Job specs fanned out by the orchestrator configuration."""
    cfg = spark.createDataFrame(ORCH_CONFIG, "job_type string, job_name string, function string, job_queues array<string>")
    return ORC.fan_out_jobs(_specs(spark, sf), cfg)


@register(
    "j17_worker_config_for",
    with_adapters("""
SELECT payload_id, job_type AS type, CASE WHEN job_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'cfg-' || job_type END AS work_dir,
       CASE WHEN job_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN NULL ELSE 'job-failed' END AS status,
       CASE WHEN job_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN NULL ELSE 'No work configuration for type ''' || job_type || '''.' END AS error
FROM jobs"""),
)
def j17_worker_config_for(spark, sf):
    """Every job's work configuration; unknown types fail."""
    cfg = spark.createDataFrame([(t, f"cfg-{t}") for t in ("1-URGENT", "2-HIGH", "3-MEDIUM")], "type string, work_dir string")
    j = A.jobs(spark, sf).select("payload_id", F.col("job_type").alias("type"))
    return ORC.worker_config_for(j, cfg).select("payload_id", "type", "work_dir", "status", "error")


@register(
    "j21_lookup_status",
    with_adapters("""
SELECT CAST(l.l_orderkey AS VARCHAR) AS payload_id, l.l_linenumber, j.status, j.status IS NOT NULL AS found
FROM lineitem l LEFT JOIN jobs j ON j.payload_id = CAST(l.l_orderkey AS VARCHAR)"""),
)
def j21_lookup_status(spark, sf):
    """Stored status of the job behind every line item id."""
    ids = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("payload_id"), "l_linenumber")
    return ORC.lookup_status(ids, A.jobs(spark, sf).select("payload_id", "status"))
