"""Registered queries: scalar column functions (P*) and filters (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.functions import columns as C
from jobscope.functions import predicates as P
from jobscope.operators import state
from jobscope.plans.oracle import EV_AS_OF, with_adapters
from jobscope.plans.q_supervise import job_events_flat, jobs_current
from jobscope.plans.registry import register
from jobscope.sources import adapters as A

SHORT_ERR_SQL = "CASE WHEN length({c}) > 35 THEN left({c}, 20) || '.....' || right({c}, 10) ELSE {c} END"


def short_sql(c: str) -> str:
    return SHORT_ERR_SQL.format(c=c)


@register(
    "p1_normalize_job_event",
    with_adapters("""
SELECT payload_id, seq, 'job' AS resource, coalesce(type, 'unknown') AS type,
       CAST(to_json(CASE WHEN value > 300 THEN ['timedout', 'q-' || job_queue] ELSE ['q-' || job_queue] END) AS VARCHAR) AS tags
FROM job_events"""),
)
def p1_normalize_job_event(spark, sf):
    """Index-ready job documents (resource, type, job tag appended)."""
    ev = A.job_events(spark, sf)
    # give every job its queue as job tag, then normalise
    ev = ev.withColumn("job", F.col("job").withField("tag", F.concat(F.lit("q-"), F.col("job.job_info.job_queue"))))
    ev = ev.withColumn("context", F.lit("ctx"))
    return C.normalize_job_event(ev).select("payload_id", "seq", "resource", "type", "tags")


@register(
    "p2_document_id",
    with_adapters("""
SELECT 'task' AS resource, seq, uuid AS doc_id FROM task_events
UNION ALL SELECT 'worker', seq, celery_hostname FROM worker_events"""),
)
def p2_document_id(spark, sf):
    """Stored-document key of task and worker events."""
    t = A.task_events(spark, sf).select(F.lit("task").alias("resource"), "seq", "uuid", "celery_hostname")
    w = A.worker_events(spark, sf).select(F.lit("worker").alias("resource"), "seq", F.lit(None).cast("string").alias("uuid"), "celery_hostname")
    u = t.unionByName(w)
    return u.select("resource", "seq", C.document_id().alias("doc_id"))


@register(
    "p3_p5_epoch_iso",
    with_adapters("""
SELECT event_id,
       split_part(printf('%.6f', epoch_us(ts) / 1e6), '.', 1) AS epoch_s,
       CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS iso,
       ts AS parsed
FROM events"""),
)
def p3_p5_epoch_iso(spark, sf):
    """Epoch text truncation, ISO formatting and strict ISO parsing
    (format then parse round-trips every event time)."""
    ev = A.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    iso = C.format_iso(F.col("ts"))
    epoch_text = F.format_string("%.6f", F.unix_micros("ts") / F.lit(1e6))
    return ev.select("event_id", C.truncate_epoch(epoch_text).alias("epoch_s"), iso.alias("iso"),
                     C.parse_iso_utc(iso).alias("parsed"))


@register(
    "p6_daily_partition",
    with_adapters("""
SELECT event_id, 'job_status-' || strftime(ts, '%Y.%m.%d') AS index_name, strftime(ts, '%Y/%m/%d/%H/%M') AS work_path
FROM events"""),
)
def p6_daily_partition(spark, sf):
    """Daily index name and minute work path of every event."""
    ev = A.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return ev.select("event_id", C.daily_partition("job_status", "ts").alias("index_name"), C.minute_path("ts").alias("work_path"))


@register(
    "p7_short_error",
    with_adapters(f"SELECT id, {short_sql('text')} AS short_error FROM catalog_docs"),
)
def p7_short_error(spark, sf):
    """Short error of every whole document text."""
    return A.catalog_docs(spark, sf).select("id", C.short_error("text").alias("short_error"))


@register(
    "p8_payload_hash",
    with_adapters("""
SELECT event_id, md5('{"k":"' || json_extract_string(props, '$.k') || '","user":"' || CAST(user_id AS VARCHAR) || '"}') AS payload_hash
FROM events"""),
)
def p8_payload_hash(spark, sf):
    """P8 (native form): hash of each event's payload map without volatile keys."""
    ev = A.table(spark, sf, "events")
    payload = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("_disk_usage"), F.lit("10GB")),
    )
    return ev.select("event_id", C.payload_hash(payload).alias("payload_hash"))


@register(
    "p9_job_and_data_type",
    with_adapters("""
WITH r AS (SELECT payload_id, CASE WHEN CAST(payload_id AS BIGINT) % 3 = 0
                                   THEN 'dataset:cat::data/' || job_type ELSE 'job:' || job_type END AS raw FROM jobs)
SELECT payload_id, raw,
       CASE WHEN regexp_matches(raw, '^\\w+?:(.*)$') THEN regexp_extract(raw, '^\\w+?:(.*)$', 1) ELSE raw END AS job_type,
       CASE WHEN regexp_matches(raw, '^dataset:\\w+?::data/(.*)$') THEN regexp_extract(raw, '^dataset:\\w+?::data/(.*)$', 1) END AS data_type
FROM r"""),
)
def p9_job_and_data_type(spark, sf):
    """Job type without its prefix, and the data type of dataset jobs."""
    j = A.jobs(spark, sf).select("payload_id", "job_type")
    raw = F.when(F.col("payload_id").cast("bigint") % 3 == 0, F.concat(F.lit("dataset:cat::data/"), F.col("job_type"))).otherwise(
        F.concat(F.lit("job:"), F.col("job_type"))
    )
    j = j.select("payload_id", raw.alias("raw"))
    return j.select("payload_id", "raw", C.job_type_of("raw").alias("job_type"), C.data_type_of("raw").alias("data_type"))


@register(
    "p10_worker_type",
    with_adapters("""
SELECT seq, coalesce(nullif(regexp_extract(celery_hostname, '^celery@(.+?)\\..+$', 1), ''), 'unknown') AS worker_type
FROM task_events"""),
)
def p10_worker_type(spark, sf):
    """P10: job type of every task event from its worker host name."""
    return A.task_events(spark, sf).select("seq", C.worker_type("celery_hostname", "event.args").alias("worker_type"))


@register(
    "p12_extract_path",
    with_adapters("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
)
def p12_extract_path(spark, sf):
    """Value at a dotted path of every event payload."""
    return A.table(spark, sf, "events").select("event_id", C.extract_path("props", "k").alias("k"))


@register(
    "p13_clamp_counters",
    with_adapters("""
SELECT job_id, n, CASE WHEN CAST(round(bytes * 100) AS HUGEINT) * 1000000000000 > 9223372036854775807 THEN -1
                       ELSE CAST(CAST(round(bytes * 100) AS HUGEINT) * 1000000000000 AS BIGINT) END AS usage
FROM products"""),
)
def p13_clamp_counters(spark, sf):
    """Unsigned usage counters over the signed range become -1."""
    # counters as an unsigned 64-bit reader delivers them: DECIMAL(20,0)
    counter = (F.round(F.col("bytes") * 100).cast("bigint").cast("decimal(20,0)") * F.lit(10**12).cast("decimal(20,0)")).cast("decimal(20,0)")
    p = A.products(spark, sf).select("job_id", "n", F.struct(counter.alias("usage")).alias("cgroups"))
    return C.clamp_counters(p, "cgroups").select("job_id", "n", F.col("cgroups.usage").alias("usage"))


@register("p13_clamp_usage", with_adapters("""
SELECT job_id, n, flag, CASE WHEN flag = 'N' OR CAST(round(bytes * 100) AS HUGEINT) * 1000000000000 <= 9223372036854775807
  THEN CAST(CAST(round(bytes * 100) AS HUGEINT) * 1000000000000 AS VARCHAR) ELSE '-1' END AS limit_bytes,
  CAST(n AS BIGINT) AS plain FROM products"""))
def p13_clamp_usage(spark, sf):
    """P13 on the nested usage samples of job documents; other documents keep theirs."""
    counter = (F.round(F.col("bytes") * 100).cast("bigint").cast("decimal(20,0)") * F.lit(10**12).cast("decimal(20,0)")).cast("decimal(20,0)")
    sample = F.struct(F.struct(F.struct(counter.alias("limit")).alias("memory")).alias("cgroups"), F.col("n").cast("bigint").alias("plain"))
    job = F.struct(F.struct(F.struct(F.array(sample).alias("usage_stats")).alias("metrics")).alias("job_info"))
    docs = A.products(spark, sf).select("job_id", "n", "flag", F.when(F.col("flag") == "N", "task").otherwise("job").alias("resource"), job.alias("job"))
    # both kinds of document in one column: a clamped one has 64 bits, the other the type that was read
    clamped = C.clamp_usage(docs.where("resource = 'job'"))
    same = docs.where("resource <> 'job'")
    out = None
    for part in (clamped, same):
        one = F.col("job.job_info.metrics.usage_stats")[0]
        part = part.select("job_id", "n", "flag", one["cgroups"]["memory"]["limit"].cast("string").alias("limit_bytes"), one["plain"].alias("plain"))
        out = part if out is None else out.unionByName(part)
    return out


@register("p20_nodes_and_addresses", with_adapters("""
SELECT payload_id, CASE WHEN custkey % 4 = 0 THEN 'pub' || custkey WHEN custkey % 4 = 1 THEN '3.4.5.' || (custkey % 250) ELSE celery_hostname || '.local' END AS node,
  CASE WHEN custkey % 4 = 1 THEN '3.4.5.' || (custkey % 250) ELSE '100.' || (custkey % 200) || '.1.2' END AS address,
  NOT (custkey % 4 <> 1 AND custkey % 200 BETWEEN 64 AND 127) AS lookup FROM jobs"""))
def p20_nodes_and_addresses(spark, sf):
    """P20: each job's node and address, and whether the address has to be looked up."""
    c = F.col("custkey")
    ip = F.concat(F.lit("100."), (c % 200).cast("string"), F.lit(".1.2"))
    facts = F.map_filter(F.create_map(
        F.lit("ec2_public_hostname"), F.when(c % 4 == 0, F.concat(F.lit("pub"), c.cast("string"))),
        F.lit("ec2_public_ipv4"), F.when(c % 4 == 1, F.concat(F.lit("3.4.5."), (c % 250).cast("string"))),
        F.lit("fqdn"), F.concat("celery_hostname", F.lit(".local")), F.lit("ipaddress"), ip), lambda k, v: v.isNotNull())
    j = A.jobs(spark, sf).select("payload_id", facts.alias("facts"))
    return j.select("payload_id", C.execute_node().alias("node"), C.public_address().alias("a")).select("payload_id", "node", "a.*")


@register("p23_browse_images", with_adapters("""
SELECT page_id, CASE page_id % 3
  WHEN 0 THEN '[{"img":"b.y.browse.png","tooltip":"y"},{"img":"a.x.browse.png","small_img":"a.x.browse_small.png","tooltip":"x"},{"img":"c.z.browse.png","tooltip":"z"}]'
  WHEN 1 THEN '[{"img":"d.y.browse.png","tooltip":"y"},{"img":"p' || page_id || '.q.browse.png","tooltip":"q"}]'
  ELSE '[]' END AS images FROM pages"""))
def p23_browse_images(spark, sf):
    """Ordered image records; of two images on one pattern the later counts."""
    i = F.col("page_id") % 3
    names = F.when(i == 0, F.array(*map(F.lit, ("c.z.browse.png", "a.x.browse.png", "a.x.browse_small.png", "b.y.browse.png", "notes.txt")))).when(
        i == 1, F.array(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".q.browse.png")), F.lit("b.y.browse.png"), F.lit("d.y.browse.png"))).otherwise(F.array(F.lit("x.png")))
    return A.table(spark, sf, "pages").select("page_id", C.browse_images(names, [r"\.y\.", r"\.x\."]).alias("images"))


@register("f7_publishable_datasets", with_adapters("""
SELECT p.job_id, p.url AS dir FROM products p JOIN jobs j ON j.payload_id = p.job_id WHERE j.status = 'job-completed' AND p.n % 3 <> 0"""))
def f7_publishable_datasets(spark, sf):
    """products of jobs that exited 0, without those marked as localized inputs."""
    p = A.products(spark, sf)
    j = A.jobs(spark, sf).select(F.col("payload_id").alias("job_id"), F.when(F.col("status") == "job-completed", 0).otherwise(1).alias("exit_status"), F.lit(7).alias("pid"))
    return P.publishable_datasets(p.select("job_id", F.col("url").alias("dir")), j, p.where("n % 3 = 0").select(F.col("url").alias("dir")))


@register("f9_triage_files", with_adapters("""
WITH f AS (SELECT payload_id, '/jobs/' || payload_id AS job_dir, unnest(['_context.json', 'run.log', 'out.dat', 'sub/deep.log', 'sub/_x', 'core.7', 'core.77']) AS name FROM jobs)
SELECT payload_id, job_dir || '/' || name AS path FROM f WHERE name IN ('_context.json', 'run.log', 'core.7')"""))
def f9_triage_files(spark, sf):
    """the files at the top of each job's directory that triage keeps."""
    files = A.jobs(spark, sf).select("payload_id", F.concat(F.lit("/jobs/"), "payload_id").alias("job_dir"),
                                     F.explode(F.array(*map(F.lit, ("_context.json", "run.log", "out.dat", "sub/deep.log", "sub/_x", "core.7", "core.77")))).alias("name"))
    files = files.select("payload_id", "job_dir", F.concat("job_dir", F.lit("/"), "name").alias("path"))
    return P.triage_files(files, extra_globs=["core.?"]).select("payload_id", "path")


@register(
    "p14_p15_limits",
    with_adapters("""
SELECT payload_id, seq,
       CASE WHEN lim IS NOT NULL AND (lim * 2 IS NULL OR lim * 2 <= lim + 60) THEN lim + 60 ELSE lim * 2 END AS hard_limit,
       CASE WHEN lim IS NULL THEN 86400 ELSE greatest(86400, CAST(trunc(lim) AS BIGINT) + 120) END AS status_ttl
FROM (SELECT payload_id, seq, CASE WHEN regexp_full_match(trim(time_limit), '-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][-+]?[0-9]+)?')
                                   THEN CAST(trim(time_limit) AS DOUBLE) END AS lim FROM job_events)"""),
)
def p14_p15_limits(spark, sf):
    """Hard limit (soft + gap at least) and status-key lifetime."""
    ev = job_events_flat(spark, sf).select("payload_id", "seq", "time_limit")
    lim = C.numeric_limit("time_limit")
    return ev.select("payload_id", "seq", C.hard_limit(lim, lim * 2, 60).alias("hard_limit"),
                     C.status_ttl("time_limit", 86400, 60).cast("bigint").alias("status_ttl"))


@register(
    "p16_bytes_from_size",
    with_adapters("""
WITH s AS (SELECT job_id, n, CAST(CAST(seconds AS BIGINT) AS VARCHAR) || CASE n % 3 WHEN 0 THEN 'KB' WHEN 1 THEN 'MB' ELSE 'GB' END AS size FROM products)
SELECT job_id, n, size,
       CAST(regexp_extract(size, '^(-?\\d+)(GB|MB|KB)$', 1) AS BIGINT) *
         CASE regexp_extract(size, '^(-?\\d+)(GB|MB|KB)$', 2) WHEN 'GB' THEN 1073741824 WHEN 'MB' THEN 1048576 ELSE 1024 END AS bytes,
       CAST(ceil(100.0 / 1099511627776.0 * CAST(regexp_extract(size, '^(-?\\d+)(GB|MB|KB)$', 1) AS BIGINT) *
         CASE regexp_extract(size, '^(-?\\d+)(GB|MB|KB)$', 2) WHEN 'GB' THEN 1073741824 WHEN 'MB' THEN 1048576 ELSE 1024 END) AS BIGINT) AS need_pct
FROM s"""),
)
def p16_bytes_from_size(spark, sf):
    """Size text to bytes and the need as a percent of a 1 TiB disk."""
    p = A.products(spark, sf).select("job_id", "n", "seconds")
    unit = F.when(F.col("n") % 3 == 0, "KB").when(F.col("n") % 3 == 1, "MB").otherwise("GB")
    p = p.select("job_id", "n", F.concat(F.col("seconds").cast("bigint").cast("string"), unit).alias("size"))
    b = C.bytes_from_size("size")
    return p.select("job_id", "n", "size", b.alias("bytes"), C.required_free_pct(F.lit(1024**4), b).alias("need_pct"))


@register(
    "p17_job_durations",
    with_adapters("""
SELECT payload_id, (epoch_us(time_end) - epoch_us(time_start)) / 1e6 AS duration,
       (epoch_us(time_start) - epoch_us(time_queued)) / 1e6 AS wait
FROM jobs"""),
)
def p17_job_durations(spark, sf):
    """Run duration and queue wait of every job."""
    j = A.jobs(spark, sf).select("payload_id", "time_queued", "time_start", "time_end")
    return C.job_durations(j).select("payload_id", "duration", "wait")


@register(
    "p18_transfer_rate",
    with_adapters("SELECT job_id, n, bytes / nullif(seconds, 0.0) AS rate FROM products"),
)
def p18_transfer_rate(spark, sf):
    """Transfer rate of every staged product."""
    return A.products(spark, sf).select("job_id", "n", C.transfer_rate("bytes", "seconds").alias("rate"))


@register(
    "p19_product_latency",
    with_adapters("""
WITH t AS (SELECT job_id, n, time_end AS availability_time, time_end - to_hours(CAST(seconds AS BIGINT)) AS time_start,
                  CASE WHEN discount > 0.05 THEN time_end - to_days(10) END AS acq,
                  CASE WHEN discount > 0.05 THEN time_end - to_days(5) END AS src
           FROM products)
SELECT job_id, n,
       (epoch_us(availability_time) - epoch_us(time_start)) / 1e6 / 60.0 AS processing_latency,
       CASE WHEN acq IS NOT NULL AND src IS NOT NULL THEN (epoch_us(src) - epoch_us(acq)) / 1e6 / 60.0 END AS ground_system_latency,
       CASE WHEN acq IS NOT NULL AND src IS NOT NULL THEN (epoch_us(availability_time) - epoch_us(src)) / 1e6 / 60.0 END AS access_latency,
       (epoch_us(availability_time) - epoch_us(time_start)) / 1e6 / 60.0
         + coalesce(CASE WHEN acq IS NOT NULL AND src IS NOT NULL THEN (epoch_us(src) - epoch_us(acq)) / 1e6 / 60.0 END, 0)
         + coalesce(CASE WHEN acq IS NOT NULL AND src IS NOT NULL THEN (epoch_us(availability_time) - epoch_us(src)) / 1e6 / 60.0 END, 0) AS total_latency
FROM t"""),
)
def p19_product_latency(spark, sf):
    """Processing, ground-system, access and total latency per product."""
    p = A.products(spark, sf).select("job_id", "n", "seconds", "discount", F.col("time_end").alias("availability_time"))
    p = p.withColumns({
        "time_start": F.timestamp_add("HOUR", -F.col("seconds").cast("bigint"), F.col("availability_time")),
        "acq": F.when(F.col("discount") > 0.05, F.timestamp_add("DAY", F.lit(-10), F.col("availability_time"))),
        "src": F.when(F.col("discount") > 0.05, F.timestamp_add("DAY", F.lit(-5), F.col("availability_time"))),
    })
    out = C.product_latency(p, "time_start", "availability_time", "acq", "src")
    return out.select("job_id", "n", "processing_latency", "ground_system_latency", "access_latency", "total_latency")


@register(
    "p22_valid_partition_pattern",
    with_adapters("""
WITH p AS (SELECT id, CASE system_version WHEN 'en' THEN '*' WHEN 'fr' THEN dataset || ',' WHEN 'de' THEN ',' || dataset
                         ELSE dataset || '*' END AS pattern FROM catalog_docs)
SELECT id, pattern, NOT (starts_with(trim(pattern), ',') OR ends_with(trim(pattern), ','))
                    AND NOT regexp_full_match(trim(pattern), '\\*+') AS valid FROM p"""),
)
def p22_valid_partition_pattern(spark, sf):
    """Validity of per-dataset index patterns."""
    d = A.catalog_docs(spark, sf)
    pat = (
        F.when(F.col("system_version") == "en", F.lit("*"))
        .when(F.col("system_version") == "fr", F.concat("dataset", F.lit(",")))
        .when(F.col("system_version") == "de", F.concat(F.lit(","), "dataset"))
        .otherwise(F.concat("dataset", F.lit("*")))
    )
    d = d.select("id", pat.alias("pattern"))
    return d.select("id", "pattern", C.valid_partition_pattern("pattern").alias("valid"))


@register(
    "p24_error_target",
    with_adapters("""
WITH e AS (SELECT page_id, CASE WHEN page_id % 2 = 0
    THEN 'Destination, s3://s3-us-west-2.amazonaws.com:80/' || bucket || '/products/v1/ds-' || CAST(page_id AS VARCHAR) || '/ds-' || CAST(page_id AS VARCHAR) || '.h5, already exists and no-clobber is set'
    ELSE 'Cooperation not possible for s3://s3-us-west-2.amazonaws.com:80/' || bucket || '/products/v1/ds-' || CAST(page_id AS VARCHAR) || '/x.h5' END AS error
  FROM paths)
SELECT page_id, 's3' AS store,
       CASE WHEN page_id % 2 = 0 THEN regexp_extract(error, 'Destination,\\s+s3://.+?/(.+?)/(.+/(.+))/.+?, already exists and no-clobber is set', 1)
            ELSE regexp_extract(error, 'Cooperation not possible for\\s+s3://.+?/(.+?)/(.+/(.+))/.+?', 1) END AS bucket,
       CASE WHEN page_id % 2 = 0 THEN regexp_extract(error, 'Destination,\\s+s3://.+?/(.+?)/(.+/(.+))/.+?, already exists and no-clobber is set', 2)
            ELSE regexp_extract(error, 'Cooperation not possible for\\s+s3://.+?/(.+?)/(.+/(.+))/.+?', 2) END AS prefix,
       CASE WHEN page_id % 2 = 0 THEN regexp_extract(error, 'Destination,\\s+s3://.+?/(.+?)/(.+/(.+))/.+?, already exists and no-clobber is set', 3)
            ELSE regexp_extract(error, 'Cooperation not possible for\\s+s3://.+?/(.+?)/(.+/(.+))/.+?', 3) END AS dataset_id
FROM e"""),
)
def p24_error_target(spark, sf):
    """Store, bucket, prefix and dataset id of failed-publish errors."""
    p = A.paths(spark, sf).select("page_id", "bucket")
    pid = F.col("page_id").cast("string")
    err = F.when(
        F.col("page_id") % 2 == 0,
        F.concat(F.lit("Destination, s3://s3-us-west-2.amazonaws.com:80/"), F.col("bucket"), F.lit("/products/v1/ds-"), pid,
                 F.lit("/ds-"), pid, F.lit(".h5, already exists and no-clobber is set")),
    ).otherwise(
        F.concat(F.lit("Cooperation not possible for s3://s3-us-west-2.amazonaws.com:80/"), F.col("bucket"),
                 F.lit("/products/v1/ds-"), pid, F.lit("/x.h5"))
    )
    return C.error_target(p.select("page_id", err.alias("error"))).select("page_id", "store", "bucket", "prefix", "dataset_id")


@register(
    "p26_merge_metadata",
    with_adapters("""
SELECT id, 'seed-' || dataset AS source, system_version AS lang, id AS doc FROM catalog_docs"""),
)
def p26_merge_metadata(spark, sf):
    """Extractor output, overridden by the seed, overridden by dataset fields."""
    d = A.catalog_docs(spark, sf)
    extracted = F.create_map(F.lit("source"), F.col("dataset"), F.lit("lang"), F.col("system_version"), F.lit("doc"), F.lit("x"))
    seed = F.create_map(F.lit("source"), F.concat(F.lit("seed-"), F.col("dataset")))
    fields = F.create_map(F.lit("doc"), F.col("id"))
    m = C.merge_metadata(extracted, seed, fields)
    return d.select("id", F.element_at(m, "source").alias("source"), F.element_at(m, "lang").alias("lang"),
                    F.element_at(m, "doc").alias("doc"))


@register(
    "p27_metric_number",
    with_adapters("""
WITH m AS (SELECT event_id, CASE event_type WHEN 'click' THEN lpad(json_extract_string(props, '$.k'), 3, '0')
                                            WHEN 'view' THEN CAST(value AS VARCHAR)
                                            WHEN 'error' THEN json_extract_string(props, '$.k') || '.50'
                                            WHEN 'signup' THEN '+' || json_extract_string(props, '$.k')
                                            ELSE json_extract_string(props, '$.k') END AS txt FROM events)
SELECT event_id, txt,
       CASE WHEN regexp_full_match(txt, '(0|-?[1-9][0-9]*)')
              OR (regexp_full_match(txt, '-?(0|[1-9][0-9]*)\\.(0|[0-9]*[1-9])')
                  AND abs(CAST(txt AS DOUBLE)) < 1e16 AND (abs(CAST(txt AS DOUBLE)) >= 1e-4 OR CAST(txt AS DOUBLE) = 0))
            THEN CAST(txt AS DOUBLE) END AS metric_value_float
FROM m"""),
)
def p27_metric_number(spark, sf):
    """Metric text is a number only when it is the canonical print."""
    ev = A.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    txt = (
        F.when(F.col("event_type") == "click", F.lpad(k, 3, "0"))
        .when(F.col("event_type") == "view", F.col("value").cast("string"))
        .when(F.col("event_type") == "error", F.concat(k, F.lit(".50")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("+"), k))
        .otherwise(k)
    )
    ev = ev.select("event_id", txt.alias("txt"))
    return ev.select("event_id", "txt", C.metric_number("txt").alias("metric_value_float"))


@register(
    "p28_triage_id",
    with_adapters("""
WITH j AS (SELECT payload_id, uuid, CASE job_type WHEN '1-URGENT' THEN 'triage-{job_id}-{job[task_id]}'
                                                  WHEN '2-HIGH' THEN 'bad-{nope}' END AS fmt,
                  CASE WHEN job_type = '3-MEDIUM' THEN 'triaged_job-' || payload_id || '_task-x' ELSE payload_id END AS job_id
           FROM jobs)
SELECT payload_id,
  CASE WHEN fmt IS NULL OR fmt = 'bad-{nope}'
       THEN 'triaged_job-' || CASE WHEN regexp_matches(job_id, 'triaged_job-(.+)_task-([-\\w])') THEN regexp_extract(job_id, 'triaged_job-(.+)_task-([-\\w])', 1) ELSE job_id END || '_task-' || uuid
       ELSE 'triage-' || CASE WHEN regexp_matches(job_id, 'triaged_job-(.+)_task-([-\\w])') THEN regexp_extract(job_id, 'triaged_job-(.+)_task-([-\\w])', 1) ELSE job_id END || '-' || uuid END AS triage_id
FROM j"""),
)
def p28_triage_id(spark, sf):
    """Triage dataset ids with per-job formats and fallback."""
    j = A.jobs(spark, sf)
    fmt = F.when(F.col("job_type") == "1-URGENT", F.lit("triage-{job_id}-{job[task_id]}")).when(
        F.col("job_type") == "2-HIGH", F.lit("bad-{nope}"))
    jid = F.when(F.col("job_type") == "3-MEDIUM", F.concat(F.lit("triaged_job-"), F.col("payload_id"), F.lit("_task-x"))).otherwise(F.col("payload_id"))
    j = j.select("payload_id", "uuid", fmt.alias("fmt"), jid.alias("job_id"))
    return j.select("payload_id", C.triage_id("job_id", "uuid", F.col("fmt")).alias("triage_id"))


@register(
    "p29_local_path",
    with_adapters("""
WITH p AS (SELECT job_id, n, url, '/data/work/' || job_id AS job_dir,
                  CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN 'inputs/' WHEN 2 THEN '/abs/in/' ELSE 'x/file.bin' END AS lp
           FROM products),
b AS (SELECT *, CASE WHEN lp IS NULL THEN job_dir || '/' WHEN starts_with(lp, '/') THEN lp ELSE job_dir || '/' || lp END AS base FROM p)
SELECT job_id, n, CASE WHEN ends_with(base, '/') THEN base || split_part(url, '/', -1) ELSE base END AS local_path FROM b"""),
)
def p29_local_path(spark, sf):
    """Where every input of a job lands."""
    p = A.products(spark, sf).select("job_id", "n", "url")
    lp = (F.when(F.col("n") % 4 == 0, F.lit(None).cast("string")).when(F.col("n") % 4 == 1, F.lit("inputs/"))
          .when(F.col("n") % 4 == 2, F.lit("/abs/in/")).otherwise(F.lit("x/file.bin")))
    p = p.select("job_id", "n", "url", F.concat(F.lit("/data/work/"), F.col("job_id")).alias("job_dir"), lp.alias("lp"))
    return p.select("job_id", "n", C.local_path("url", "lp", "job_dir").alias("local_path"))


# ------------------------------------------------------------ filters ----


@register(
    "f2_condition_builders",
    with_adapters("""
SELECT payload_id, status, job_type, time_limit FROM jobs
WHERE status IN ('job-queued', 'job-started') AND time_limit >= 100000 AND time_limit < 300000
  AND (job_type = '1-URGENT' OR job_type = '2-HIGH') AND NOT (celery_hostname = 'w0' OR celery_hostname = 'w1')"""),
)
def f2_condition_builders(spark, sf):
    """term / terms / range / any_of / none_of conditions, pushed to the scan."""
    j = A.jobs(spark, sf)
    cond = P.all_of(
        P.terms("status", ["job-queued", "job-started"]),
        P.range_("time_limit", gte=100000, lt=300000),
        P.any_of(P.term("job_type", "1-URGENT"), P.term("job_type", "2-HIGH")),
        P.none_of(P.term("celery_hostname", "w0"), P.term("celery_hostname", "w1")),
    )
    return j.filter(cond).select("payload_id", "status", "job_type", "time_limit")


@register(
    "f3_phrase",
    with_adapters(f"""
SELECT id, {short_sql('text')} AS short_error FROM catalog_docs
WHERE contains(text, 'license') AND {short_sql('text')} LIKE '%e%'"""),
)
def f3_phrase(spark, sf):
    """documents whose whole text contains a phrase (with a short-error test)."""
    d = A.catalog_docs(spark, sf).select("id", "text", C.short_error("text").alias("short_error"))
    return d.filter(P.phrase("text", "license") & F.col("short_error").contains("e")).select("id", "short_error")


@register(
    "f4_stale",
    with_adapters(f"""
SELECT payload_id, status, ts FROM jobs_current
WHERE status IN ('job-queued', 'job-started') AND ts < {EV_AS_OF} - INTERVAL 172800 SECOND"""),
)
def f4_stale(spark, sf):
    """queued/started jobs not updated for two days."""
    j = jobs_current(spark, sf).select("payload_id", "status", "ts")
    return P.stale(j, ["job-queued", "job-started"], 172800, A.EVENTS_AS_OF)


@register(
    "f5_exclude_orchestrator",
    with_adapters("""
WITH t AS (SELECT seq, status,
                  CASE WHEN celery_hostname LIKE 'celery@w0.%' THEN 'celery@orchestrator-0.node' ELSE celery_hostname END AS host,
                  CASE WHEN celery_hostname LIKE 'celery@w1.%' THEN 'app.orchestrator.submit_job' ELSE 'jobs.run_job' END AS name
           FROM task_events)
SELECT seq, status, host FROM t
WHERE status = 'task-failed' OR NOT (regexp_matches(host, '^celery@orchestrator')
      OR (status = 'task-sent' AND regexp_matches(name, '^[a-z_]+\\.orchestrator\\.submit_job')))"""),
)
def f5_exclude_orchestrator(spark, sf):
    """task events without the orchestrator's own traffic."""
    t = A.task_events(spark, sf)
    host = F.when(F.col("celery_hostname").like("celery@w0.%"), F.lit("celery@orchestrator-0.node")).otherwise(F.col("celery_hostname"))
    name = F.when(F.col("celery_hostname").like("celery@w1.%"), F.lit("app.orchestrator.submit_job")).otherwise(F.lit("jobs.run_job"))
    t = t.select("seq", "status", host.alias("host"), name.alias("name"))
    return P.exclude_orchestrator(t, hostname="host", name="name").select("seq", "status", "host")


@register(
    "f7_f9_publish_triage",
    with_adapters("""
SELECT payload_id, CASE WHEN status = 'job-completed' THEN 0 ELSE 1 END AS exit_status,
       CASE WHEN status = 'job-queued' THEN 0 ELSE 1000 + CAST(payload_id AS BIGINT) END AS pid,
       CASE WHEN status = 'job-completed' AND status <> 'job-queued' THEN 'publish'
            WHEN status <> 'job-completed' AND NOT (job_type = '5-LOW') THEN 'triage' ELSE 'none' END AS route
FROM jobs"""),
)
def f7_f9_publish_triage(spark, sf):
    """which finished jobs publish their products and which get triaged."""
    j = A.jobs(spark, sf)
    j = j.select(
        "payload_id",
        F.when(F.col("status") == "job-completed", 0).otherwise(1).alias("exit_status"),
        F.when(F.col("status") == "job-queued", F.lit(0).cast("bigint")).otherwise(1000 + F.col("payload_id").cast("bigint")).alias("pid"),
        (F.col("job_type") == "5-LOW").alias("triage_disabled"),
    )
    pub = P.publishable(j).select("payload_id", F.lit("publish").alias("route"))
    tri = P.triage_candidates(j).select("payload_id", F.lit("triage").alias("route"))
    routes = pub.unionByName(tri)
    return j.join(routes, "payload_id", "left").select(
        "payload_id", "exit_status", "pid", F.coalesce("route", F.lit("none")).alias("route")
    )


@register(
    "f8_verify_datasets",
    with_adapters("""
SELECT id, CASE WHEN n_chars > 200 THEN system_version END IS NOT NULL AS valid,
       CAST(to_json(list_filter([CASE WHEN n_chars % 2 = 0 THEN NULL ELSE 'label' END, 'location', 'starttime', 'endtime'], lambda x: x IS NOT NULL)) AS VARCHAR) AS missing_optional
FROM catalog_docs"""),
)
def f8_verify_datasets(spark, sf):
    """F8: split datasets on the required version, listing absent optional fields."""
    d = A.catalog_docs(spark, sf).select(
        "id", F.when(F.col("n_chars") > 200, F.col("system_version")).alias("version"),
        F.when(F.col("n_chars") % 2 == 0, F.col("dataset")).alias("label"),
        F.lit(None).cast("string").alias("location"),
    )
    ok, bad = P.verify_datasets(d)
    return ok.select("id", F.lit(True).alias("valid"), "missing_optional").unionByName(
        bad.select("id", F.lit(False).alias("valid"), "missing_optional"))


@register(
    "f10_source_columns",
    with_adapters("""
SELECT payload_id, seq, time_limit AS job_job_info_time_limit, job_queue AS job_job_info_job_queue FROM job_events"""),
)
def f10_source_columns(spark, sf):
    """only the requested nested fields (nested-schema pruning)."""
    ev = A.job_events(spark, sf)
    return P.source_columns(ev, ["payload_id", "seq", "job.job_info.time_limit", "job.job_info.job_queue"])


@register(
    "w1_latest_job_per_type",
    with_adapters("""
SELECT job_type, payload_id, status, time_queued FROM (
  SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY time_queued DESC, payload_id DESC) AS rn FROM jobs
  WHERE status = 'job-completed') WHERE rn = 1"""),
)
def w1_latest_job_per_type(spark, sf):
    """Latest successful job per job type (periodicity checks)."""
    j = A.jobs(spark, sf).filter(F.col("status") == "job-completed").select("job_type", "payload_id", "status", "time_queued")
    return state.latest_per(j, "job_type", ["time_queued", "payload_id"])
