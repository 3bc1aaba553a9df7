"""Registered queries: catalog, recognition, publish decisions, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.operators import catalog as K
from jobscope.plans.oracle import with_adapters
from jobscope.plans.registry import register
from jobscope.sources import adapters as A


@register(
    "j8_exists_in_catalog",
    with_adapters("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)"),
)
def j8_exists_in_catalog(spark, sf):
    """Labelled document ids that exist in the catalog (semi join)."""
    ids = A.table(spark, sf, "labels").select("doc_id", "quality")
    return K.exists_in_catalog(ids, A.catalog_docs(spark, sf).select("doc_id"), key="doc_id")


ERR_SQL = """'Destination, s3://s3-us-west-2.amazonaws.com:80/' || bucket || '/products/v1/' || CAST(page_id AS VARCHAR)
             || '/' || CAST(page_id * 7 AS VARCHAR) || '/x.h5, already exists and no-clobber is set'"""


@register(
    "j9_orphaned_datasets",
    with_adapters(f"""
SELECT page_id, CAST(page_id * 7 AS VARCHAR) AS dataset_id FROM paths
WHERE CAST(page_id * 7 AS VARCHAR) NOT IN (SELECT id FROM catalog_docs)"""),
)
def j9_orphaned_datasets(spark, sf):
    """Failed-publish targets (from error texts) not in the catalog."""
    p = A.paths(spark, sf)
    err = F.concat(F.lit("Destination, s3://s3-us-west-2.amazonaws.com:80/"), F.col("bucket"), F.lit("/products/v1/"),
                   F.col("page_id").cast("string"), F.lit("/"), (F.col("page_id") * 7).cast("string"),
                   F.lit("/x.h5, already exists and no-clobber is set"))
    errors = p.select("page_id", err.alias("error"))
    return K.orphaned_datasets(errors, A.catalog_docs(spark, sf), key="id").select("page_id", "dataset_id")


@register(
    "j14_objects_under",
    with_adapters("""
WITH o AS (SELECT job_id, n, flag AS bucket, url AS key FROM products),
pre AS (SELECT DISTINCT if(CAST(payload_id AS BIGINT) % 3 = 0, 'N', 'R') AS bucket, 's3://bucket/' || payload_id || '/' AS prefix FROM jobs WHERE status = 'job-queued')
SELECT o.job_id, o.n, o.bucket, o.key, pre.prefix FROM o JOIN pre ON o.bucket = pre.bucket AND starts_with(o.key, pre.prefix)"""),
    bench=True,
)
def j14_objects_under(spark, sf):
    """Staged objects under the prefixes of jobs that never ran, bucket by bucket."""
    objs = A.products(spark, sf).select("job_id", "n", F.col("flag").alias("bucket"), F.col("url").alias("key"))
    prefixes = A.jobs(spark, sf).filter(F.col("status") == "job-queued").select(
        F.when(F.col("payload_id").cast("bigint") % 3 == 0, "N").otherwise("R").alias("bucket"),
        F.concat(F.lit("s3://bucket/"), F.col("payload_id"), F.lit("/")).alias("prefix"))
    return K.objects_under(objs, prefixes, bucket="bucket")


# Dataset configuration for page urls.  Two groups over two path levels;
# an alternative pattern on the second entry.
PAGE_CONFIG = [
    dict(position=0, match_pattern=r"/(?P<lang>fr|de)/(?P<num>\d+)", alt_match_pattern=None, ipath="web/eu",
         version="v1", level="l1", type="page-eu"),
    dict(position=1, match_pattern=r"/(?P<lang>en)/(?P<num>\d+)", alt_match_pattern=r"\?(?P<query>[a-z_]+)=",
         ipath="web/en-query", version="v1", level="l2", type="page-query"),
    dict(position=2, match_pattern=r"/(?P<lang>[a-z]{2})/(?P<num>\d+)", alt_match_pattern=None, ipath="web/other",
         version="v2", level="l1", type="page"),
]


@register(
    "j15_recognize",
    with_adapters("""
WITH r AS (SELECT page_id, path,
  CASE WHEN regexp_matches(path, '/(fr|de)/(\\d+)') THEN 0
       WHEN regexp_matches(path, '/(en)/(\\d+)') AND regexp_matches(path, '\\?([a-z_]+)=') THEN 1
       WHEN regexp_matches(path, '/([a-z]{2})/(\\d+)') THEN 2 END AS position FROM paths)
SELECT page_id, path, position,
  CASE position WHEN 0 THEN regexp_extract(path, '/(fr|de)/(\\d+)', 1) WHEN 1 THEN regexp_extract(path, '/(en)/(\\d+)', 1)
                WHEN 2 THEN regexp_extract(path, '/([a-z]{2})/(\\d+)', 1) END AS lang,
  CASE position WHEN 0 THEN regexp_extract(path, '/(fr|de)/(\\d+)', 2) WHEN 1 THEN regexp_extract(path, '/(en)/(\\d+)', 2)
                WHEN 2 THEN regexp_extract(path, '/([a-z]{2})/(\\d+)', 2) END AS num,
  CASE position WHEN 1 THEN regexp_extract(path, '\\?([a-z_]+)=', 1) END AS query,
  CASE position WHEN 0 THEN 'v1' WHEN 1 THEN 'v1' WHEN 2 THEN 'v2' END AS version,
  CASE position WHEN 0 THEN 'l1' WHEN 1 THEN 'l2' WHEN 2 THEN 'l1' END AS level,
  CASE position WHEN 0 THEN 'page-eu' WHEN 1 THEN 'page-query' WHEN 2 THEN 'page' END AS type,
  CASE position WHEN 0 THEN 'web/eu' WHEN 1 THEN 'web/en-query' WHEN 2 THEN 'web/other' END AS ipath
FROM r""").replace("FROM r\"\"\")", "FROM r"),
)
def j15_recognize(spark, sf):
    """First matching dataset configuration for every page url, with
    its named groups and defaults."""
    p = A.paths(spark, sf).select("page_id", "path")
    return K.recognize(p, PAGE_CONFIG).select("page_id", "path", "position", "lang", "num", "query", "version", "level",
                                              "type", "ipath")


@register(
    "p21_expand_template",
    with_adapters("""
WITH r AS (SELECT page_id, CASE WHEN regexp_matches(path, '/(fr|de)/(\\d+)') THEN 0
       WHEN regexp_matches(path, '/(en)/(\\d+)') AND regexp_matches(path, '\\?([a-z_]+)=') THEN 1
       WHEN regexp_matches(path, '/([a-z]{2})/(\\d+)') THEN 2 END AS position, path FROM paths),
g AS (SELECT page_id, position,
  CASE position WHEN 0 THEN regexp_extract(path, '/(fr|de)/(\\d+)', 1) WHEN 1 THEN regexp_extract(path, '/(en)/(\\d+)', 1)
                WHEN 2 THEN regexp_extract(path, '/([a-z]{2})/(\\d+)', 1) END AS lang,
  CASE position WHEN 0 THEN regexp_extract(path, '/(fr|de)/(\\d+)', 2) WHEN 1 THEN regexp_extract(path, '/(en)/(\\d+)', 2)
                WHEN 2 THEN regexp_extract(path, '/([a-z]{2})/(\\d+)', 2) END AS num,
  CASE position WHEN 0 THEN 'page-eu' WHEN 1 THEN 'page-query' WHEN 2 THEN 'page' END AS type,
  CASE position WHEN 0 THEN 'v1' WHEN 1 THEN 'v1' WHEN 2 THEN 'v2' END AS version FROM r)
SELECT page_id, CASE WHEN position IS NOT NULL THEN type || '-' || lang || '-' || num || '-' || version END AS dataset_id,
       CASE WHEN position IS NOT NULL THEN 's3://bucket/' || type || '/' || version || '/' || lang || '/' || num END AS publish_url
FROM g"""),
)
def p21_expand_template(spark, sf):
    """Dataset ids and publish urls expanded from recognised groups."""
    from jobscope.functions.columns import expand_template

    r = K.recognize(A.paths(spark, sf).select("page_id", "path"), PAGE_CONFIG)
    r = K.template_ids(r, "{type}-{lang}-{num}-{version}")
    return r.select("page_id", "dataset_id", F.when(F.col("position").isNotNull(),
                    expand_template("s3://bucket/{type}/{version}/{lang}/{num}")).alias("publish_url"))


@register(
    "c2_staged_products",
    with_adapters("""
SELECT job_id || '-' || CAST(n AS VARCHAR) AS id, job_id, bytes AS disk_usage, seconds AS duration,
       bytes / nullif(seconds, 0.0) AS transfer_rate, url, 'cat_v1_' || flag AS "index"
FROM products"""),
)
def c2_staged_products(spark, sf):
    """Per-product staging records with usage, duration and rate."""
    p = A.products(spark, sf).select(
        F.concat("job_id", F.lit("-"), F.col("n").cast("string")).alias("id"), "job_id",
        F.col("bytes").alias("disk_usage"), F.col("seconds").alias("duration"), "url",
        F.concat(F.lit("cat_v1_"), F.col("flag")).alias("index"))
    return K.staged_products(p).select("id", "job_id", "disk_usage", "duration", "transfer_rate", "url", "index")


@register(
    "c3_lineage_edges",
    with_adapters("""
WITH j AS (SELECT payload_id AS job_id, 'task-' || payload_id AS task_id, celery_hostname AS agent FROM jobs)
SELECT 'product:' || p.url AS subject, 'wasGeneratedBy' AS relation, 'task_id:' || j.task_id AS object
FROM products p JOIN j USING (job_id) WHERE p.flag = 'N'
UNION ALL
SELECT 'task_id:' || j.task_id, 'used', 'url:' || p.url FROM products p JOIN j USING (job_id) WHERE p.flag <> 'N'
UNION ALL
SELECT 'task_id:' || task_id, 'wasAssociatedWith', 'agent:' || agent FROM j"""),
    bench=True,
)
def c3_lineage_edges(spark, sf):
    """Provenance edges between products, tasks, inputs and agents."""
    return K.lineage_edges(*_lineage(spark, sf))


def _lineage(spark, sf):
    p = A.products(spark, sf)
    products = p.filter(F.col("flag") == "N").select("job_id", F.col("url").alias("product_id"))
    inputs = p.filter(F.col("flag") != "N").select("job_id", "url")
    jobs = A.jobs(spark, sf).select(F.col("payload_id").alias("job_id"),
                                    F.concat(F.lit("task-"), F.col("payload_id")).alias("task_id"),
                                    F.col("celery_hostname").alias("agent"))
    return products, inputs, jobs


@register("c3_derived_from", with_adapters("""
SELECT 'product:' || p.url AS subject, 'wasDerivedFrom' AS relation, 'url:' || i.url AS object
FROM products p JOIN products i USING (job_id) JOIN jobs j ON j.payload_id = p.job_id
WHERE p.flag = 'N' AND i.flag <> 'N' AND p.n = 1"""))
def c3_derived_from(spark, sf):
    """What each job's first product was derived from, out of the edges of its task."""
    first = A.products(spark, sf).where("flag = 'N' and n = 1").select(F.col("url").alias("product_id"))
    return K.derived_from(K.lineage_edges(*_lineage(spark, sf)), first)


@register("c3_publish_edges", with_adapters("""
WITH p AS (
  SELECT 'publish_dataset-' || 'p' || n AS step, 'file://' || 'w' || (suppkey % 20) || '/work/' || job_id || '/p' || n AS local, url,
         'publish_dataset/w' || (suppkey % 20) || '/' || partkey || '/' || strftime(time_end, '%Y-%m-%dT%H:%M:%S') AS who
  FROM products WHERE flag = 'N')
SELECT step AS subject, 'used' AS relation, local AS object FROM p
UNION ALL SELECT url, 'wasGeneratedBy', step FROM p UNION ALL SELECT step, 'wasAssociatedWith', who FROM p"""))
def c3_publish_edges(spark, sf):
    """The publish step of each new product."""
    p = A.products(spark, sf).where("flag = 'N'")
    return K.publish_edges(p.select(
        F.concat(F.lit("/work/"), "job_id", F.lit("/p"), F.col("n").cast("string")).alias("path"), "url",
        F.concat(F.lit("w"), (F.col("suppkey") % 20).cast("string")).alias("node"), F.col("partkey").alias("pid"), F.col("time_end").alias("time_start")))


@register("c1_build_catalog", with_adapters("""
SELECT id, 'cat/' || dataset AS ipath, system_version AS version, 'l' || (doc_id % 3) AS level, 'text' AS type, id AS objectid,
       if(doc_id % 5 = 0, 'own-' || dataset, dataset) AS dataset, system_version, 'l' || (doc_id % 3) AS dataset_level, 'text' AS dataset_type,
       '[]' AS urls, '[]' AS browse_urls, if(doc_id % 2 = 0, 'label ' || id, NULL) AS label,
       CASE WHEN doc_id % 4 = 0 THEN '{}' WHEN doc_id % 4 = 1 THEN CAST(json_object('chars', 'seed', 'who', 'x') AS VARCHAR)
            ELSE CAST(json_object('chars', CAST(n_chars AS VARCHAR)) AS VARCHAR) END AS metadata,
       'cat_all' AS "index", CAST(json_object('index', 'cat_all') AS VARCHAR) AS grq_index_result
FROM catalog_docs"""))
def c1_build_catalog(spark, sf):
    """documents' records from recognition, extracted and seed metadata,
    and the dataset file's own fields, some of which override."""
    d = A.catalog_docs(spark, sf)
    rest = F.col("doc_id") % 4
    own = F.struct(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("own-"), "dataset")).alias("dataset"),
                   F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("label "), "id")).alias("label"))
    recognised = d.select("id", F.concat(F.lit("cat/"), "dataset").alias("ipath"), F.col("system_version").alias("version"),
                          F.concat(F.lit("l"), (F.col("doc_id") % 3).cast("string")).alias("level"), F.lit("text").alias("type"))
    metadata = d.where(rest != 0).select("id", F.create_map(F.lit("chars"), F.col("n_chars").cast("string")).alias("extracted"),
                                         F.when(rest == 1, F.create_map(F.lit("chars"), F.lit("seed"), F.lit("who"), F.lit("x"))).alias("seed"))
    return K.build_catalog(d.select("id", own.alias("own")), "cat_all", recognised, metadata, "own")


@register(
    "c4_merge_activity",
    with_adapters("""
WITH a AS (SELECT job_id AS doc_id, url AS activity_id, time_end AS "end", CASE WHEN n % 2 = 0 THEN 'own' END AS prov_type
           FROM products WHERE flag = 'N'),
n AS (SELECT doc_id, count(*) AS n, min(activity_id) AS only_id, min(prov_type) AS only_type FROM a GROUP BY doc_id),
s AS (SELECT payload_id AS doc_id, 'step-' || payload_id AS activity_id, time_start AS start, time_end AS "end", uuid AS job_id, job_type FROM jobs)
SELECT a.doc_id, a.activity_id, CAST(NULL AS TIMESTAMP) AS start, a."end", CAST(NULL AS VARCHAR) AS job_id, CAST(NULL AS VARCHAR) AS job_type,
       a.prov_type, CAST(NULL AS VARCHAR) AS replaces, 'agent-' || a.activity_id AS agent
FROM a JOIN n USING (doc_id) WHERE n > 1 OR doc_id NOT IN (SELECT doc_id FROM s)
UNION ALL
SELECT s.doc_id, if(n = 1, only_id, s.activity_id), s.start, s."end", s.job_id, s.job_type,
       if(n = 1, coalesce(only_type, 'publish'), 'publish'), if(n = 1, s.activity_id, NULL), 'agent-' || if(n = 1, only_id, s.activity_id)
FROM s LEFT JOIN n USING (doc_id)"""),
)
def c4_merge_activity(spark, sf):
    """C4: the publish step merged into each job's provenance document."""
    none = F.lit(None)
    acts = A.products(spark, sf).where("flag = 'N'").select(
        F.col("job_id").alias("doc_id"), F.col("url").alias("activity_id"), none.cast("timestamp").alias("start"), F.col("time_end").alias("end"),
        none.cast("string").alias("job_id"), none.cast("string").alias("job_type"), F.when(F.col("n") % 2 == 0, "own").alias("prov_type"))
    steps = A.jobs(spark, sf).select(
        F.col("payload_id").alias("doc_id"), F.concat(F.lit("step-"), "payload_id").alias("activity_id"), F.col("time_start").alias("start"),
        F.col("time_end").alias("end"), F.col("uuid").alias("job_id"), "job_type", F.lit("publish").alias("prov_type"))
    merged = K.merge_activity(acts, steps)
    return merged.withColumn("agent", F.concat(F.lit("agent-"), "activity_id"))


@register(
    "c5_triage_records",
    with_adapters("""
SELECT payload_id AS job_id, 'triaged_job-' || payload_id || '_task-' || uuid AS id, 'v1' AS version,
       'triage for job ' || payload_id AS label, time_start AS starttime, time_end AS endtime
FROM jobs WHERE status <> 'job-completed' AND job_type <> '5-LOW'"""),
)
def c5_triage_records(spark, sf):
    """Triage catalog rows for every failed job that did not opt out."""
    j = A.jobs(spark, sf).select(
        F.col("payload_id").alias("job_id"), F.col("uuid").alias("task_id"),
        F.when(F.col("status") == "job-completed", 0).otherwise(1).alias("exit_status"),
        (F.col("job_type") == "5-LOW").alias("triage_disabled"),
        F.col("time_start").alias("cmd_start"), F.col("time_end").alias("cmd_end"))
    return K.triage_records(j)


J20_SQL = """
WITH c AS (SELECT id, 's3://bucket/' || dataset || '/' || id AS url, 'p' || CAST(doc_id % 50 AS VARCHAR) AS payload_id,
                  't' || CAST(doc_id % 70 AS VARCHAR) AS task_id, n_chars % 5 = 0 AS objects_present FROM catalog_docs),
x AS (SELECT 's3://bucket/' || dataset || '/' || id AS url,
             CASE n_chars % 3 WHEN 0 THEN NULL WHEN 1 THEN 'p' || CAST(doc_id % 50 AS VARCHAR)
                  ELSE 'p' || CAST(doc_id % 40 AS VARCHAR) END AS ctx_payload_id,
             't' || CAST(doc_id % 60 AS VARCHAR) AS ctx_task_id FROM catalog_docs WHERE system_version = 'fr'),
jb AS (SELECT 'p' || payload_id AS ctx_payload_id, status AS ctx_job_status FROM jobs),
tk AS (SELECT 't' || payload_id AS ctx_task_id, status = 'job-completed' AS other_done FROM jobs),
cat AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels),
d AS (SELECT c.*, x.url IS NOT NULL AS has_ctx, x.ctx_payload_id, x.ctx_task_id, jb.ctx_job_status,
             cat.id IS NOT NULL AS in_cat, coalesce(tk.other_done, false) AS other_done
      FROM c LEFT JOIN x USING (url) LEFT JOIN jb USING (ctx_payload_id) LEFT JOIN tk USING (ctx_task_id)
      LEFT JOIN cat USING (id)),
e AS (SELECT *, payload_id IS NOT NULL AND ctx_payload_id = payload_id AS same,
             task_id IS NOT NULL AND ctx_task_id IS NOT NULL AND task_id <> ctx_task_id AS differ FROM d)
SELECT id, url, payload_id, task_id, objects_present,
  CASE WHEN NOT has_ctx AND NOT objects_present THEN 'publish'
       WHEN has_ctx AND ctx_payload_id IS NULL THEN 'reject'
       WHEN has_ctx AND coalesce(same, false) AND differ AND NOT other_done THEN 'reject'
       WHEN has_ctx AND coalesce(same, false) AND in_cat THEN 'reject'
       WHEN has_ctx AND coalesce(same, false) THEN 'force'
       WHEN has_ctx AND ctx_job_status = 'job-failed' THEN 'force'
       WHEN has_ctx AND ctx_job_status = 'job-started' THEN 'reject'
       WHEN has_ctx AND in_cat THEN 'reject'
       WHEN has_ctx THEN 'force'
       WHEN in_cat THEN 'reject' ELSE 'force' END AS decision,
  CASE WHEN NOT has_ctx AND NOT objects_present THEN NULL
       WHEN has_ctx AND ctx_payload_id IS NULL THEN 'context_without_payload'
       WHEN has_ctx AND coalesce(same, false) AND differ AND NOT other_done THEN 'other_task_unfinished'
       WHEN has_ctx AND coalesce(same, false) AND in_cat THEN 'in_catalog'
       WHEN has_ctx AND coalesce(same, false) AND differ THEN 'waited_for_other_task_to_finish'
       WHEN has_ctx AND coalesce(same, false) THEN 'retry_previous_failed'
       WHEN has_ctx AND ctx_job_status = 'job-failed' THEN 'job_failed'
       WHEN has_ctx AND ctx_job_status = 'job-started' THEN 'other_job_running'
       WHEN in_cat THEN 'in_catalog' ELSE 'no_es_doc' END AS reason
FROM e"""


@register("j20_publish_decision", with_adapters(J20_SQL))
def j20_publish_decision(spark, sf):
    """Publish / force / reject for every candidate dataset."""
    d = A.catalog_docs(spark, sf)
    url = F.concat(F.lit("s3://bucket/"), F.col("dataset"), F.lit("/"), F.col("id"))
    cands = d.select("id", url.alias("url"), F.concat(F.lit("p"), (F.col("doc_id") % 50).cast("string")).alias("payload_id"),
                     F.concat(F.lit("t"), (F.col("doc_id") % 70).cast("string")).alias("task_id"),
                     (F.col("n_chars") % 5 == 0).alias("objects_present"))
    ctx_pid = (F.when(F.col("n_chars") % 3 == 0, F.lit(None).cast("string"))
               .when(F.col("n_chars") % 3 == 1, F.concat(F.lit("p"), (F.col("doc_id") % 50).cast("string")))
               .otherwise(F.concat(F.lit("p"), (F.col("doc_id") % 40).cast("string"))))
    ctxs = d.filter(F.col("system_version") == "fr").select(
        url.alias("url"), ctx_pid.alias("ctx_payload_id"),
        F.concat(F.lit("t"), (F.col("doc_id") % 60).cast("string")).alias("ctx_task_id"), F.lit(True).alias("_ctx"))
    j = A.jobs(spark, sf)
    jobs = j.select(F.concat(F.lit("p"), F.col("payload_id")).alias("payload_id"), "status")
    tasks = j.select(F.concat(F.lit("t"), F.col("payload_id")).alias("task_id"),
                     (F.col("status") == "job-completed").alias("finished"))
    catalog = A.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id")).distinct()
    return K.publish_decision(cands, ctxs, jobs, catalog, tasks)
