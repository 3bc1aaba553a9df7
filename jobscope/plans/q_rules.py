"""Registered queries: rule matching (J1, J2, A4, F1) and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.operators import dedup, rules as R
from jobscope.operators.triggers import triggers
from jobscope.plans.oracle import with_adapters
from jobscope.plans.registry import register
from jobscope.sources import adapters as A

# Standing dataset rules used by the registered queries.  Two are broken on
# purpose (a parse error and an unknown column) and one is disabled.
DATASET_RULES = [
    dict(rule_name="en_long", query_string="system_version = 'en' AND n_chars > 5000", enabled=True,
         job_type="io-reprocess", priority=3, query_all=False),
    dict(rule_name="src_pick", query_string="dataset IN ('src1', 'src7') AND text LIKE '%the%'", enabled=True,
         job_type="io-index", priority=1, query_all=False),
    dict(rule_name="license", query_string="lower(text) LIKE '%license%'", enabled=True,
         job_type="io-audit", priority=5, query_all=False),
    dict(rule_name="bad_parse", query_string="n_chars >", enabled=True, job_type="io-x", priority=0, query_all=False),
    dict(rule_name="bad_column", query_string="no_such_field = 1", enabled=True, job_type="io-x", priority=0,
         query_all=False),
    dict(rule_name="disabled", query_string="n_chars > 0", enabled=False, job_type="io-x", priority=0,
         query_all=False),
    dict(rule_name="huge_any", query_string="n_chars > 15000", enabled=True, job_type="io-alert", priority=9,
         query_all=True),
    dict(rule_name="in_index", query_string="n_chars < 400", enabled=True, job_type="io-index", priority=2,
         query_all=False, index_pattern="cat_src1*, cat_src3"),
    dict(rule_name="bad_index", query_string="n_chars < 60", enabled=True, job_type="io-index", priority=2,
         query_all=False, index_pattern="cat_src1,"),
]
PREFIX = "io-"


def _dataset_matches(spark, sf):
    docs = A.catalog_docs(spark, sf).select("id", "system_version", "dataset", "text", "n_chars", F.concat(F.lit("cat_"), "dataset").alias("index"))
    compiled = R.compile_rules(docs, R.rules_frame(spark, DATASET_RULES))
    return docs, compiled, R.match_dataset_rules(docs, None, name_prefix=PREFIX, compiled=compiled)


J1_SQL = """
SELECT id, system_version, 'en_long' AS rule_name, 'io-reprocess' AS job_type, 3 AS priority,
       'reprocess-' || id AS job_name, id AS hit_id
FROM catalog_docs WHERE system_version = 'en' AND n_chars > 5000
UNION ALL
SELECT id, system_version, 'src_pick', 'io-index', 1, 'index-' || id, id
FROM catalog_docs WHERE dataset IN ('src1', 'src7') AND text LIKE '%the%'
UNION ALL
SELECT id, system_version, 'license', 'io-audit', 5, 'audit-' || id, id
FROM catalog_docs WHERE lower(text) LIKE '%license%'
UNION ALL
SELECT id, system_version, 'in_index', 'io-index', 2, 'index-' || id, id
FROM catalog_docs WHERE n_chars < 400 AND (dataset LIKE 'src1%' OR dataset = 'src3')
UNION ALL
SELECT id, system_version, 'bad_index', 'io-index', 2, 'index-' || id, id FROM catalog_docs WHERE n_chars < 60
UNION ALL
SELECT d.id, d.system_version, 'huge_any', 'io-alert', 9, 'alert-' || d.id, h.hit_id
FROM catalog_docs d JOIN (SELECT system_version, min(id) AS hit_id FROM catalog_docs
                          WHERE n_chars > 15000 GROUP BY system_version) h USING (system_version)"""


@register("j1_match_dataset_rules", with_adapters(J1_SQL), bench=True)
def j1_match_dataset_rules(spark, sf):
    """Every enabled rule against every dataset in one scan."""
    return _dataset_matches(spark, sf)[2]


@register("j1_filed_rules", with_adapters("""
WITH r AS (SELECT s, n, 'src' || s AS dataset, 40 * n AS least, 'r_' || s || '_' || n AS rule_name FROM range(0, 20) a(s), range(0, 50) b(n))
SELECT d.id, d.system_version, r.rule_name, 'io-index' AS job_type, CAST(n % 7 AS INTEGER) AS priority, 'index-' || d.id AS job_name, d.id AS hit_id
FROM catalog_docs d JOIN r ON d.dataset = r.dataset AND d.n_chars > r.least AND d.system_version = 'en'"""))
def j1_filed_rules(spark, sf):
    """J1 with a thousand rules, filed by the data set that each demands."""
    rules = [dict(rule_name=f"r_{s}_{n}", query_string=f"dataset = 'src{s}' AND n_chars > {40 * n} AND system_version = 'en'", enabled=True, job_type="io-index", priority=n % 7, query_all=False)
             for s in range(20) for n in range(50)]
    docs = A.catalog_docs(spark, sf).select("id", "system_version", "dataset", "n_chars")
    return R.match_dataset_rules(docs, rules, name_prefix=PREFIX)


@register(
    "a4_rule_summary",
    with_adapters(f"""
WITH m AS ({J1_SQL})
SELECT d.id, CAST(8 AS BIGINT) AS candidates,
       CAST(to_json(coalesce(list_sort(list(m.rule_name) FILTER (WHERE m.rule_name IS NOT NULL)), CAST([] AS VARCHAR[]))) AS VARCHAR) AS matched,
       '["bad_column","bad_parse"]' AS errored
FROM catalog_docs d LEFT JOIN m ON m.id = d.id GROUP BY d.id"""),
)
def a4_rule_summary(spark, sf):
    """A4: per dataset, rules evaluated, matched and errored."""
    docs, compiled, matches = _dataset_matches(spark, sf)
    return R.rule_summary(docs, matches, compiled, "id")


JOB_RULES = [
    dict(rule_name="urgent_done", query_string="status = 'job-completed' AND job_type = '1-URGENT'", enabled=True,
         job_type="io-notify", priority=2, query_all=False, job_name_path="_source.job_queue"),
    dict(rule_name="big_limit", query_string="time_limit > 450000", enabled=True, job_type="io-audit", priority=1,
         query_all=False, job_name_path=None),
    dict(rule_name="any_low", query_string="job_type = '5-LOW' AND time_limit > 300000", enabled=True,
         job_type="retry", priority=0, query_all=True, job_name_path="_source.celery_hostname"),
    dict(rule_name="broken", query_string="status = = 'x'", enabled=True, job_type="io-x", priority=0,
         query_all=False, job_name_path=None),
]


@register(
    "j2_match_job_rules",
    with_adapters("""
SELECT payload_id, 'urgent_done' AS rule_name, 'io-notify' AS job_type, 2 AS priority,
       'notify-' || CASE WHEN coalesce(job_queue, '') <> '' THEN job_queue ELSE payload_id END AS job_name,
       payload_id AS hit_id
FROM jobs WHERE status = 'job-completed' AND job_type = '1-URGENT'
UNION ALL
SELECT payload_id, 'big_limit', 'io-audit', 1, 'audit-' || payload_id, payload_id
FROM jobs WHERE time_limit > 450000
UNION ALL
SELECT j.payload_id, 'any_low', 'retry', 0,
       'retry-' || CASE WHEN coalesce(h.celery_hostname, '') <> '' THEN h.celery_hostname ELSE j.payload_id END,
       h.payload_id
FROM jobs j, (SELECT * FROM jobs WHERE payload_id = (
      SELECT min(payload_id) FROM jobs WHERE job_type = '5-LOW' AND time_limit > 300000)) h"""),
)
def j2_match_job_rules(spark, sf):
    """Rules against finished jobs; trigger names from the hit's path."""
    jobs = A.jobs(spark, sf).select("payload_id", "status", "job_type", "job_queue", "celery_hostname", "time_limit")
    return R.match_job_rules(jobs, R.rules_frame(spark, JOB_RULES), name_prefix=PREFIX)


@register(
    "j7_find_duplicates",
    with_adapters("""
WITH r AS (
  SELECT payload_hash, payload_id, status,
         row_number() OVER (PARTITION BY payload_hash ORDER BY time_queued, payload_id) AS rk
  FROM jobs WHERE status IN ('job-queued', 'job-started', 'job-completed')),
h AS (
  SELECT payload_hash,
         max(CASE WHEN rk = 1 THEN payload_id END) AS id1, max(CASE WHEN rk = 1 THEN status END) AS st1,
         max(CASE WHEN rk = 2 THEN payload_id END) AS id2, max(CASE WHEN rk = 2 THEN status END) AS st2
  FROM r WHERE rk <= 2 GROUP BY payload_hash)
SELECT j.payload_id, j.payload_hash, j.status, j.time_queued,
       CASE WHEN h.id1 = j.payload_id THEN h.id2 ELSE h.id1 END AS dedup_job,
       CASE WHEN h.id1 = j.payload_id THEN h.st2 ELSE h.st1 END AS dedup_status
FROM jobs j LEFT JOIN h USING (payload_hash)"""),
    bench=True,
)
def j7_find_duplicates(spark, sf):
    """Earliest other job with the same payload hash, for every job."""
    jobs = A.jobs(spark, sf).select("payload_id", "payload_hash", "status", "time_queued")
    return dedup.find_duplicates(jobs)


@register(
    "j7_mark_deduped",
    with_adapters("""
WITH r AS (
  SELECT payload_hash, payload_id, status, time_queued,
         row_number() OVER (PARTITION BY payload_hash ORDER BY time_queued, payload_id) AS rk
  FROM jobs WHERE status IN ('job-queued', 'job-started', 'job-completed'))
SELECT j.payload_id, j.payload_hash, 'job-deduped' AS status, j.time_queued, r.payload_id AS dedup_job, r.status AS dedup_status
FROM jobs j JOIN r ON r.payload_hash = j.payload_hash AND r.rk = 1
WHERE r.time_queued < j.time_queued OR r.time_queued = j.time_queued AND r.payload_id < j.payload_id"""),
)
def j7_mark_deduped(spark, sf):
    """J7 (submission form): jobs that repeat an earlier one."""
    jobs = A.jobs(spark, sf).select("payload_id", "payload_hash", "status", "time_queued")
    return dedup.mark_deduped(jobs)


KWARGS = '{"email_addresses":"a@b.c","hash_tags":"#x","ftp_url":"ftp://h/d","sftp_url":"sftp://h/d","rsync_url":"file://h/d","query":"own"}'
DATASET_ACTIONS = ("passthrough", "ingest_dataset", "notify_by_email", "notify_by_tweet", "ftp_push", "sftp_push", "rsync_push",
                   "purge_dataset", "purge_datasets", "custom_script", "import_prov_es")
JOB_ACTIONS = ("notify_job_by_email", "notify_job_by_tweet", "retry_job")


def _by_action(bodies: dict[str, tuple[str, str, str, str, str, str]], key: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS action, {key}, rule, {t} AS type, {n} AS name, {tag} AS tag, {u} AS username, CAST({p} AS VARCHAR) AS params, {loc} AS localize_urls FROM h"
        for a, (t, n, tag, u, p, loc) in bodies.items())


def _plain(action: str, id_col: str | None, params: str) -> tuple:
    name = f"'action-{action}'" + (f" || '-' || {id_col}" if id_col else "")
    return f"'{action}'", name, "rule", "'ops'", params, "'[]'"


_URL = "CASE WHEN n > 0 THEN 'http://h/' || objectid END"
_STORE = "CASE WHEN n = 2 THEN 's3://b/' || objectid WHEN n = 1 THEN 'http://h/' || objectid END"
_ID = "'id', objectid, 'rule_name', rule, 'username', 'ops'"


@register("p25_dataset_triggers", with_adapters(f"""
WITH m AS ({J1_SQL}),
h AS (SELECT m.id AS objectid, m.rule_name AS rule, 'cat_' || d.dataset AS idx, d.doc_id % 3 AS n, m.job_type
      FROM m JOIN catalog_docs d ON d.id = m.id)
""" + _by_action({
    "passthrough": ("job_type", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "json_object('id', objectid, 'localize_urls', json_array('http://h/' || objectid))", "CAST(json_array('http://h/' || objectid) AS VARCHAR)"),
    "ingest_dataset": ("'ingest_dataset'", "'ingest_dataset-' || objectid", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "json_object('dataset', objectid)", "CASE n WHEN 0 THEN '[]' WHEN 1 THEN CAST(json_array('http://h/' || objectid) AS VARCHAR) ELSE CAST(json_array('http://h/' || objectid, 's3://b/' || objectid) AS VARCHAR) END"),
    "notify_by_email": _plain("notify_by_email", "objectid", f"json_object({_ID}, 'emails', 'a@b.c', 'url', {_URL})"),
    "notify_by_tweet": _plain("notify_by_tweet", "objectid", f"json_object({_ID}, 'hash_tags', '#x', 'url', {_URL})"),
    "ftp_push": _plain("ftp_push", "objectid", f"json_object({_ID}, 'ftp_url', 'ftp://h/d', 'emails', 'a@b.c', 'url', {_URL})"),
    "sftp_push": _plain("sftp_push", "objectid", f"json_object({_ID}, 'sftp_url', 'sftp://h/d', 'emails', 'a@b.c', 'url', {_URL})"),
    "rsync_push": _plain("rsync_push", "objectid", f"json_object({_ID}, 'rsync_url', 'file://h/d', 'emails', 'a@b.c', 'url', {_URL})"),
    "purge_dataset": _plain("purge_dataset", "objectid", f"json_object('index', idx, 'doctype', '_doc', 'id', objectid, 'url', {_URL}, 'rule_name', rule, 'username', 'ops')"),
    "purge_datasets": _plain("purge_datasets", None, "json_object('index', idx, 'query', 'all', 'rule_name', rule, 'username', 'ops')"),
    "custom_script": _plain("custom_script", None, "json_object('index', idx, 'query', 'own', 'rule_name', rule, 'username', 'ops', 'email_addresses', 'a@b.c', 'hash_tags', '#x', 'ftp_url', 'ftp://h/d', 'sftp_url', 'sftp://h/d', 'rsync_url', 'file://h/d')"),
    "import_prov_es": _plain("import_prov_es", None, f"json_object('index', idx, 'doctype', '_doc', 'id', objectid, 'prod_url', {_STORE}, 'rule_name', rule, 'username', 'ops')"),
}, "objectid")))
def p25_dataset_triggers(spark, sf):
    """P25: the jobs of every dataset rule hit, for each dataset action."""
    docs = A.catalog_docs(spark, sf).select("id", "dataset", "doc_id")
    matches = _dataset_matches(spark, sf)[2].select("id", "rule_name", "job_type")
    web, store = F.concat(F.lit("http://h/"), "id"), F.concat(F.lit("s3://b/"), "id")
    urls = F.slice(F.array(web, store), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    hits = matches.join(docs, "id").select(
        F.col("id").alias("objectid"), F.col("rule_name").alias("rule"), "rule_name", "job_type", F.lit("ops").alias("username"), F.lit(KWARGS).alias("kwargs"),
        urls.alias("urls"), F.concat(F.lit("cat_"), "dataset").alias("index"), F.lit("_doc").alias("doctype"), F.lit("all").alias("query"),
        F.col("id").alias("dataset"), F.to_json(urls).alias("dataset_urls"),
        F.to_json(F.struct("id", F.array(web).alias("localize_urls"))).alias("info"))
    return triggers(hits, DATASET_ACTIONS, "objectid", "rule")


@register("p25_job_triggers", with_adapters("""
WITH h AS (SELECT payload_id AS job_id, 'urgent_done' AS rule, 'http://j/' || payload_id AS url,
             CASE WHEN CAST(payload_id AS BIGINT) % 4 = 0 THEN 'action-retry_job-' || payload_id ELSE payload_id END AS old
      FROM jobs WHERE status = 'job-completed' AND job_type = '1-URGENT')
""" + _by_action({
    "notify_job_by_email": _plain("notify_job_by_email", "job_id", "json_object('id', job_id, 'rule_name', rule, 'username', 'ops', 'emails', 'a@b.c', 'url', url)"),
    "notify_job_by_tweet": _plain("notify_job_by_tweet", "job_id", "json_object('id', job_id, 'rule_name', rule, 'username', 'ops', 'hash_tags', '#x', 'url', url)"),
    "retry_job": ("'retry_job'", "CASE WHEN old LIKE 'action-retry_job%' THEN old ELSE 'action-retry_job-' || old END", "rule", "'ops'", "json_object('id', job_id, 'rule_name', rule, 'username', 'ops', 'job', json_object('job_id', old))", "'[]'"),
}, "job_id")))
def p25_job_triggers(spark, sf):
    """P25: the jobs of every hit of a job rule, for each job action."""
    jobs = A.jobs(spark, sf).select("payload_id", "status", "job_type", "job_queue", "celery_hostname", "time_limit")
    rules = R.rules_frame(spark, [r for r in JOB_RULES if r["rule_name"] == "urgent_done"])
    hits = R.match_job_rules(jobs, rules, name_prefix=PREFIX)
    old = F.when(F.col("payload_id").cast("long") % 4 == 0, F.concat(F.lit("action-retry_job-"), "payload_id")).otherwise(F.col("payload_id"))
    hits = hits.select(
        F.col("payload_id").alias("job_id"), F.col("payload_id").alias("objectid"), F.col("rule_name").alias("rule"), "rule_name", F.lit("ops").alias("username"), F.lit(KWARGS).alias("kwargs"),
        F.concat(F.lit("http://j/"), "payload_id").alias("job_url"), F.to_json(F.struct(old.alias("job_id"))).alias("job"))
    return triggers(hits, JOB_ACTIONS, "job_id", "rule")
