"""Trigger parameters of rule hits (P25): one projection for an action, or for several.

A hit is a row of J1 or J2 with the rule's ``rule_name``, ``username`` and
``kwargs`` (JSON text) and the columns of the document that the action reads.
The result has a job's type, name, tag, user, parameters (JSON text) and
localize urls (JSON text).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.session import ensure_utc

# Sources of a parameter: a column, ``kwargs:<key>``, the first url, or the
# first url that starts with s3 (else the first).
FIRST, STORE = "first url", "store url"


@dataclass(frozen=True)
class Action:
    """``name``: column behind ``action-<type>-`` (None: no suffix)."""

    params: tuple[tuple[str, str], ...]
    name: str | None = None


_RULE = (("rule_name", "rule_name"), ("username", "username"))


def _notice(id_col: str, url: str, *kwargs: tuple[str, str]) -> Action:
    return Action((("id", id_col), *_RULE, *((p, f"kwargs:{k}") for p, k in kwargs), ("url", url)), id_col)


# Parameter and action names.
ACTIONS = {
    "notify_by_email": _notice("objectid", FIRST, ("emails", "email_addresses")),
    "notify_by_tweet": _notice("objectid", FIRST, ("hash_tags", "hash_tags")),
    "ftp_push": _notice("objectid", FIRST, ("ftp_url", "ftp_url"), ("emails", "email_addresses")),
    "sftp_push": _notice("objectid", FIRST, ("sftp_url", "sftp_url"), ("emails", "email_addresses")),
    "rsync_push": _notice("objectid", FIRST, ("rsync_url", "rsync_url"), ("emails", "email_addresses")),
    "purge_dataset": Action((("index", "index"), ("doctype", "doctype"), ("id", "objectid"), ("url", FIRST), *_RULE), "objectid"),
    "purge_datasets": Action((("index", "index"), ("query", "query"), *_RULE)),
    "custom_script": Action((("index", "index"), ("query", "query"), *_RULE)),
    "import_prov_es": Action((("index", "index"), ("doctype", "doctype"), ("id", "objectid"), ("prod_url", STORE), *_RULE)),
    "notify_job_by_email": _notice("job_id", "job_url", ("emails", "email_addresses")),
    "notify_job_by_tweet": _notice("objectid", "job_url", ("hash_tags", "hash_tags")),
    "retry_job": Action((("id", "job_id"), *_RULE, ("job", "job"))),
}
PASS_THROUGH, INGEST = "passthrough", "ingest_dataset"
RETRY = "action-retry_job"


def _source(spec: str) -> Column:
    if spec.startswith("kwargs:"):
        return F.try_variant_get(F.try_parse_json("kwargs"), "$." + spec.removeprefix("kwargs:"), "variant")
    first = F.get("urls", 0)
    if spec == FIRST:
        return first
    if spec == STORE:
        return F.coalesce(F.get(F.filter("urls", lambda u: u.startswith("s3")), 0), first)
    return F.try_parse_json(spec) if spec == "job" else F.col(spec)


def _json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


NAMES = ("type", "name", "tag", "username", "params", "localize_urls")


def _job(action: str) -> list[Column]:
    """What an action makes of a hit, in the order of NAMES."""
    none, empty = F.lit(None).cast("string"), F.lit("[]")
    if action == PASS_THROUGH:
        localize = F.to_json(F.try_variant_get(F.try_parse_json("info"), "$.localize_urls", "variant"))
        job = (F.col("job_type"), none, none, none, F.col("info"), F.coalesce(localize, empty))
    elif action == INGEST:
        job = (F.lit(INGEST), F.concat(F.lit("ingest_dataset-"), "dataset"), none, none, _json(F.col("dataset").alias("dataset")), F.coalesce("dataset_urls", empty))
    elif action in ACTIONS:
        spec = ACTIONS[action]
        params = _json(*(_source(src).alias(p) for p, src in spec.params))
        if action == "custom_script":
            own = F.create_map(*(x for p, src in spec.params for x in (F.lit(p), _source(src).cast("variant"))))
            params = F.to_json(F.map_concat(own, F.coalesce(F.from_json("kwargs", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), {"ignoreNullFields": "false"})
        name = F.lit(f"action-{action}")
        if spec.name:
            name = F.concat(name, F.lit("-"), F.col(spec.name).cast("string"))
        if action == "retry_job":
            old = F.try_variant_get(F.try_parse_json("job"), "$.job_id", "string")
            name = F.when(old.startswith(RETRY), old).otherwise(F.concat(F.lit(RETRY + "-"), F.coalesce(old, F.lit("None"))))
        job = (F.lit(action), name, F.col("rule_name"), F.col("username"), params, empty)
    else:
        raise ValueError(f"no action {action}")
    return [c.cast("string").alias(n) for n, c in zip(NAMES, job, strict=True)]


def trigger_params(hits: DataFrame, action: str) -> DataFrame:
    """P25: the job of each hit for one of 14 actions.

    Adds type, name, tag, username, params, localize_urls to ``hits``.  An
    empty url list gives a null url; ``custom_script`` merges the rule's
    kwargs over its parameters; a retry of a retry keeps its name.
    ``passthrough`` reads ``info`` (JSON text) and ``job_type``;
    ``ingest_dataset`` reads ``dataset`` and ``dataset_urls`` (JSON text).
    """
    ensure_utc(hits.sparkSession)
    return hits.select(*[c for c in hits.columns if c not in NAMES], *_job(action))


def triggers(hits: DataFrame, actions: Sequence[str], *keep: str) -> DataFrame:
    """The jobs of each hit for several actions: action, ``keep`` (columns of
    the hit) and what ``trigger_params`` adds.  The hits are computed once and
    each becomes a row for every action, so a task holds one plan of them, not
    one for each action."""
    ensure_utc(hits.sparkSession)
    jobs = F.array(*(F.struct(F.lit(a).alias("action"), *_job(a)) for a in actions))
    return hits.select(*keep, F.explode(jobs).alias("_j")).select("_j.action", *keep, *(F.col(f"_j.{n}") for n in NAMES))
