"""The adapters of ``jobscope.sources.adapters`` restated in DuckDB SQL.

These are written independently of the Spark code and are composed into the
oracle statements as CTEs (``with_adapters``).  Only the tables a statement
mentions are defined, so DuckDB does not scan the others.
"""

from __future__ import annotations

import re

from jobscope.sources.adapters import (
    EXC_OTHER,
    EXC_SOFT_LIMIT,
    EXC_TIME_LIMIT,
    EXC_WORKER_LOST,
    EVENTS_AS_OF,
    LOG_EPOCH,
    ORDERS_AS_OF,
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EXC_SQL = f"""CASE WHEN value > 200 THEN {q(EXC_WORKER_LOST)}
                  WHEN value > 100 THEN {q(EXC_TIME_LIMIT)}
                  WHEN value > 50 THEN {q(EXC_SOFT_LIMIT)}
                  ELSE {q(EXC_OTHER)} END"""

PID_SQL = "CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')"
K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

ADAPTERS = {
    "job_events": f"""
SELECT {PID_SQL} AS payload_id,
       {PID_SQL} AS uuid,
       md5(CAST(user_id AS VARCHAR) || '|' || CAST({K_SQL} % 10 AS VARCHAR)) AS payload_hash,
       CASE event_type WHEN 'signup' THEN 'job-queued' WHEN 'view' THEN 'job-started'
            WHEN 'purchase' THEN 'job-completed' WHEN 'error' THEN 'job-failed'
            WHEN 'click' THEN 'job-revoked' END AS status,
       CASE WHEN value > 300 THEN ['timedout'] ELSE CAST([] AS VARCHAR[]) END AS tags,
       CASE WHEN event_type = 'error' THEN {EXC_SQL} END AS error,
       'w' || CAST(user_id % 10 AS VARCHAR) AS celery_hostname,
       'job-t' || CAST(user_id % 4 AS VARCHAR) AS type,
       ts, event_id AS seq, event_type = 'click' AND user_id % 5 = 0 AS supervisory,
       'queue-' || CAST(user_id % 3 AS VARCHAR) AS job_queue,
       CASE WHEN event_type = 'signup' THEN ts END AS time_queued,
       CASE WHEN event_type = 'view' THEN ts END AS time_start,
       CASE WHEN event_type IN ('purchase', 'error', 'click') THEN ts END AS time_end,
       CASE WHEN {K_SQL} % 23 <> 0 THEN CAST({K_SQL} * 60 AS VARCHAR) END AS time_limit,
       props AS params, value, user_id
FROM events""",
    "task_events": f"""
SELECT {PID_SQL} AS uuid,
       CASE event_type WHEN 'view' THEN 'task-started' WHEN 'purchase' THEN 'task-succeeded'
            WHEN 'error' THEN 'task-failed' ELSE 'task-sent' END AS status,
       'celery@w' || CAST(user_id % 10 AS VARCHAR) || '.node' AS celery_hostname,
       'job-t' || CAST(user_id % 4 AS VARCHAR) AS type,
       ts, event_id AS seq,
       CASE WHEN event_type = 'error' THEN {EXC_SQL} END AS exception,
       CASE WHEN event_type = 'error' THEN 'Traceback: ' || {EXC_SQL} END AS traceback
FROM events""",
    "worker_events": """
SELECT 'w' || CAST(user_id % 10 AS VARCHAR) AS celery_hostname,
       CASE event_type WHEN 'signup' THEN 'worker-online' WHEN 'error' THEN 'worker-offline'
            ELSE 'worker-heartbeat' END AS status,
       ts, event_id AS seq
FROM events""",
    "jobs": """
SELECT CAST(o_orderkey AS VARCHAR) AS payload_id,
       CAST(o_orderkey AS VARCHAR) AS uuid,
       'w' || CAST(o_custkey % 50 AS VARCHAR) AS celery_hostname,
       o_orderpriority AS job_type, o_orderpriority AS job_queue,
       CASE o_orderstatus WHEN 'F' THEN 'job-completed' WHEN 'O' THEN 'job-started' ELSE 'job-queued' END AS status,
       o_orderdate AS time_queued,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate + to_seconds(o_orderkey % 3600) END AS time_start,
       CASE WHEN o_orderstatus = 'F'
            THEN o_orderdate + to_seconds(o_orderkey % 3600) + to_seconds(CAST(floor(o_totalprice) AS BIGINT) % 7200) END AS time_end,
       md5(CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority) AS payload_hash,
       CAST(floor(o_totalprice) AS BIGINT) AS time_limit,
       o_custkey AS custkey, o_totalprice AS totalprice
FROM orders""",
    "products": """
SELECT CAST(l_orderkey AS VARCHAR) AS job_id, l_linenumber AS n,
       's3://bucket/' || CAST(l_orderkey AS VARCHAR) || '/p' || CAST(l_linenumber AS VARCHAR) AS url,
       l_extendedprice AS bytes, l_quantity AS seconds, l_shipdate AS time_end,
       l_returnflag AS flag, l_linestatus AS line_status, l_partkey AS partkey,
       l_suppkey AS suppkey, l_discount AS discount
FROM lineitem""",
    "catalog_docs": """
SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source AS dataset, lang AS system_version,
       text, n_chars
FROM documents""",
    "paths": """
SELECT page_id, url AS path, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS bucket, html
FROM pages""",
    "log_lines": f"""
SELECT CAST(conv_id AS VARCHAR) AS id, role AS type, turn AS seq,
       TIMESTAMP {q(LOG_EPOCH)} + to_milliseconds(turn * 400) AS ts, text AS chunk
FROM conversations""",
}

# jobs_current in SQL: the last write per job (A1), used by several oracles.
ADAPTERS["jobs_current"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY ts DESC, seq DESC) AS rn
  FROM job_events) WHERE rn = 1"""

TERMINAL_SQL = "('job-completed','job-failed','job-deduped','job-offline','job-revoked')"

# live status: the guarded current state (A2) per job
ADAPTERS["live"] = f"""
SELECT uuid, status AS live_status FROM (
  SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY
      (status IN {TERMINAL_SQL}) DESC, (status IN {TERMINAL_SQL} AND NOT supervisory) DESC,
      ts DESC, seq DESC) AS rn FROM job_events) WHERE rn = 1"""
ADAPTERS["task_latest"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ts DESC, seq DESC) AS rn FROM task_events) WHERE rn = 1"""
ADAPTERS["worker_latest"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY celery_hostname ORDER BY ts DESC, seq DESC) AS rn FROM worker_events) WHERE rn = 1"""

DEPENDS = {"jobs_current": ["job_events"], "live": ["job_events"], "task_latest": ["task_events"],
           "worker_latest": ["worker_events"]}

EV_AS_OF = f"TIMESTAMP {q(EVENTS_AS_OF)}"
ORD_AS_OF = f"TIMESTAMP {q(ORDERS_AS_OF)}"


def with_adapters(body: str) -> str:
    """Prefix ``body`` with the adapter CTEs it mentions (in dependency order)."""
    wanted: list[str] = []

    def need(name):
        for d in DEPENDS.get(name, []):
            need(d)
        if name not in wanted:
            wanted.append(name)

    for name in ADAPTERS:
        if re.search(rf"\b{name}\b", body):
            need(name)
    if not wanted:
        return body
    ctes = ",\n".join(f"{n} AS ({ADAPTERS[n]})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
