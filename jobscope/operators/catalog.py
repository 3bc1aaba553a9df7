"""Datasets, catalog and lineage: recognition, catalog records, existence,
orphans, checksums, publish decisions, staging records, provenance edges,
triage records (J8, J9, J13-J15, J20, C1-C5).

Path and prefix matching is done with equi-joins on derived keys (a file's
ancestor directories, a checksum file's partner path), never with theta
joins.  Dataset-recognition patterns are configuration: they are compiled
on the driver into one projection that finds each path's first matching
configuration in a single pass.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.columns import error_target, expand_template, transfer_rate, triage_id
from jobscope.functions.predicates import triage_candidates
from jobscope.sources.listing import digests, read_texts


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------ J8, J9 -----


def exists_in_catalog(ids: DataFrame, catalog: DataFrame, key: str = "id") -> DataFrame:
    """The ids present in the catalog (semi join)."""
    return ids.join(catalog.select(key), key, "left_semi")


def orphaned_datasets(errors: DataFrame, catalog: DataFrame, error: str = "error", key: str = "id") -> DataFrame:
    """Failed-publish targets whose dataset never reached the catalog."""
    t = error_target(errors, error).filter(F.col("dataset_id").isNotNull() & (F.col("dataset_id") != ""))
    return t.join(catalog.select(F.col(key).alias("dataset_id")), "dataset_id", "left_anti")


# ------------------------------------------------------------ J13 --------

# Checksum algorithms that Spark has functions for, and the others.  Fixed values.
NATIVE_DIGESTS = {"md5": lambda c: F.md5(c), "sha1": lambda c: F.sha1(c), "sha224": lambda c: F.sha2(c, 224),
                  "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384),
                  "sha512": lambda c: F.sha2(c, 512)}
OTHER_DIGESTS = ("sha3_224", "sha3_256", "sha3_384", "sha3_512", "blake2b", "blake2s", "shake_128", "shake_256")


def verify_checksums(files: DataFrame, path: str = "path",
                     algorithms: Sequence[str] = tuple(NATIVE_DIGESTS) + OTHER_DIGESTS) -> DataFrame:
    """Pair every ``f.<algo>`` file with ``f``, compare the digest
    case-insensitively.  Checksum files without a partner are skipped.
    Returns one row per pair with ``expected``, ``actual`` and ``ok`` (false
    where either can't be read).

    ``files`` is a listing (``list_tree``), and only paths are joined.  A
    pair's two files are then read where its row is, the partner in chunks, so
    no content crosses a shuffle and a file's size does not matter; pairs are
    dealt out evenly first.
    """
    listing = files.select(F.col(path).alias("_path"))
    ext = F.regexp_extract("_path", r"\.([A-Za-z0-9_]+)$", 1)
    sums = listing.filter(ext.isin(list(algorithms))).select(
        F.regexp_replace("_path", r"\.[A-Za-z0-9_]+$", "").alias("_target"), ext.alias("algo"), F.col("_path").alias("_sum"))
    pairs = sums.join(listing.select(F.col("_path").alias("_target")).distinct(), "_target")
    pairs = pairs.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism))
    read = digests(read_texts(pairs, "_sum", "_text"), "_target", "algo", "actual")
    expected = F.lower(F.split(F.trim("_text"), r"\s+").getItem(0))
    return read.select(F.col("_target").alias(path), "algo", expected.alias("expected"), "actual").withColumn(
        "ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


# ------------------------------------------------------------ J14 --------


def ancestors(col, sep: str = "/") -> Column:
    """Every proper ancestor prefix of a path, each ending with the separator."""
    parts = F.split(_c(col), re.escape(sep))
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                       lambda i: F.concat(F.array_join(F.slice(parts, 1, i), sep), F.lit(sep)))


def objects_under(objects: DataFrame, prefixes: DataFrame, key: str = "key", prefix: str = "prefix",
                  bucket: str | None = None) -> DataFrame:
    """Objects whose key lies under one of the prefixes (directory
    prefixes; a missing trailing ``/`` is added) of the same ``bucket``, if
    that column is named; both sides have it.

    Prefixes have few distinct depths (number of ``/``).  Those are a scalar
    subquery, and every key emits only its ancestor at each such depth.  The
    candidates are equi-joined with the prefixes: no theta join, nothing runs
    while the plan is made.
    """
    on = [bucket, prefix] if bucket else [prefix]
    p = prefixes.select(*on[:-1], F.when(F.col(prefix).endswith("/"), F.col(prefix)).otherwise(
        F.concat(F.col(prefix), F.lit("/"))).alias(prefix)).distinct()
    nslash = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    depths = p.agg(F.sort_array(F.collect_set(nslash(F.col(prefix))))).scalar()
    cols = list(objects.columns)
    k = F.col(key)
    at = objects.withColumn("_at", F.explode(depths)).filter(nslash(k) >= F.col("_at"))
    exploded = at.withColumn(prefix, F.concat(F.call_function("substring_index", k, F.lit("/"), F.col("_at")), F.lit("/")))
    # a key equal to the directory itself (no character after the last '/') is not under it
    exploded = exploded.filter(F.length(k) > F.length(F.col(prefix)))
    return exploded.join(p, on).select(*cols, prefix)


# ------------------------------------------------------------ J15 --------

_PY_NAMED = re.compile(r"\(\?P<([A-Za-z_][A-Za-z0-9_]*)>")


def java_pattern(p: str) -> str:
    """Python named groups ``(?P<n>`` -> Java ``(?<n>``."""
    return _PY_NAMED.sub(r"(?<\1>", p)


def recognize(paths: DataFrame, config: Sequence[dict], path: str = "path", children: str | None = None,
              version: str | None = None) -> DataFrame:
    """First configuration (by position) whose pattern matches the path
    and whose alternative pattern, if any, matches the path or one of its
    listed children.  Emits the named groups (alternative groups override),
    with ``version``/``level``/``type`` defaulted from the configuration.
    Unmatched paths have a null ``position``.

    ``config`` rows: position, match_pattern, alt_match_pattern, ipath,
    version, level, type (missing ``match_pattern`` is an error).
    """
    cfg = sorted(config, key=lambda d: d["position"])
    for d in cfg:
        if not d.get("match_pattern"):
            raise ValueError(f"no match_pattern in dataset config {d}")
    p = F.col(path)
    kids = F.col(children) if children else None

    def alt_hit(alt):
        jp = java_pattern(alt)
        hit = p.rlike(jp)
        if kids is not None:
            hit = hit | F.exists(F.coalesce(kids, F.array().cast("array<string>")),
                                 lambda k: F.concat(p, F.lit("/"), k).rlike(jp))
        return hit

    conds = []
    for d in cfg:
        c = p.rlike(java_pattern(d["match_pattern"]))
        if d.get("alt_match_pattern"):
            c = c & alt_hit(d["alt_match_pattern"])
        conds.append(c)
    pos = None
    for d, c in zip(cfg, conds):
        pos = F.when(c, F.lit(d["position"])) if pos is None else pos.when(c, F.lit(d["position"]))
    df = paths.withColumn("position", pos.cast("int") if pos is not None else F.lit(None).cast("int"))

    names = []
    for d in cfg:
        for pat in (d["match_pattern"], d.get("alt_match_pattern")):
            if pat:
                names += [n for n in re.compile(pat).groupindex if n not in names]

    def alt_value(alt, idx):
        jp = java_pattern(alt)
        own = F.when(p.rlike(jp), F.regexp_extract(p, jp, idx))
        if kids is None:
            return own
        child = F.filter(F.coalesce(kids, F.array().cast("array<string>")),
                         lambda k: F.concat(p, F.lit("/"), k).rlike(jp))
        first_child = F.concat(p, F.lit("/"), F.get(child, 0))
        return F.coalesce(own, F.regexp_extract(first_child, jp, idx))

    outs = {}
    for name in names + ["version", "level", "type"]:
        e = None
        for d in cfg:
            v = None
            m = re.compile(d["match_pattern"]).groupindex
            if name in m:
                v = F.regexp_extract(p, java_pattern(d["match_pattern"]), m[name])
            if d.get("alt_match_pattern"):
                a = re.compile(d["alt_match_pattern"]).groupindex
                if name in a:
                    av = alt_value(d["alt_match_pattern"], a[name])
                    v = F.coalesce(av, v) if v is not None else av
            if v is None and name in ("version", "level", "type"):
                default = version if (name == "version" and version is not None) else d.get(name)
                v = F.lit(default).cast("string")
            if v is None:
                continue
            e = F.when(F.col("position") == d["position"], v) if e is None else e.when(F.col("position") == d["position"], v)
        outs[name] = e if e is not None else F.lit(None).cast("string")
    ipath = None
    for d in cfg:
        ipath = (F.when(F.col("position") == d["position"], F.lit(d.get("ipath"))) if ipath is None
                 else ipath.when(F.col("position") == d["position"], F.lit(d.get("ipath"))))
    outs["ipath"] = ipath if ipath is not None else F.lit(None).cast("string")
    return df.withColumns(outs)


# ------------------------------------------------------------ J20 --------


def publish_decision(candidates: DataFrame, contexts: DataFrame, jobs: DataFrame, catalog: DataFrame,
                     tasks: DataFrame | None = None) -> DataFrame:
    """Publish / force / reject for each candidate dataset.

    candidates: id, url, payload_id, task_id, objects_present (bool).
    contexts (publish contexts at the target url): url, ctx_payload_id, ctx_task_id.
    jobs: payload_id, status (the context's job).  catalog: id.
    tasks (optional): task_id, finished (bool) for the other task.
    """
    df = candidates.join(contexts, "url", "left")
    df = df.join(jobs.select(F.col("payload_id").alias("ctx_payload_id"), F.col("status").alias("ctx_job_status")),
                 "ctx_payload_id", "left")
    df = df.join(catalog.select("id").withColumn("_in_catalog", F.lit(True)), "id", "left")
    if tasks is not None:
        df = df.join(tasks.select(F.col("task_id").alias("ctx_task_id"), F.col("finished").alias("_other_done")),
                     "ctx_task_id", "left")
    else:
        df = df.withColumn("_other_done", F.lit(None).cast("boolean"))
    in_cat = F.coalesce(F.col("_in_catalog"), F.lit(False))
    has_ctx = F.col("url").isNotNull() & F.col("_ctx").isNotNull() if "_ctx" in contexts.columns else F.col("ctx_payload_id").isNotNull() | F.col("ctx_task_id").isNotNull()
    same = F.col("payload_id").isNotNull() & (F.col("ctx_payload_id") == F.col("payload_id"))
    tasks_differ = F.col("task_id").isNotNull() & F.col("ctx_task_id").isNotNull() & (F.col("task_id") != F.col("ctx_task_id"))
    other_unfinished = ~F.coalesce(F.col("_other_done"), F.lit(False))
    objs = F.coalesce(F.col("objects_present"), F.lit(False))
    decision = (
        F.when(~has_ctx & ~objs, "publish")
        .when(has_ctx & F.col("ctx_payload_id").isNull(), "reject")
        .when(has_ctx & same & tasks_differ & other_unfinished, "reject")
        .when(has_ctx & same & in_cat, "reject")
        .when(has_ctx & same, "force")
        .when(has_ctx & (F.col("ctx_job_status") == "job-failed"), "force")
        .when(has_ctx & (F.col("ctx_job_status") == "job-started"), "reject")
        .when(has_ctx & in_cat, "reject")
        .when(has_ctx, "force")
        .when(in_cat, "reject")
        .otherwise("force")
    )
    reason = (
        F.when(~has_ctx & ~objs, F.lit(None))
        .when(has_ctx & F.col("ctx_payload_id").isNull(), "context_without_payload")
        .when(has_ctx & same & tasks_differ & other_unfinished, "other_task_unfinished")
        .when(has_ctx & same & in_cat, "in_catalog")
        .when(has_ctx & same & tasks_differ, "waited_for_other_task_to_finish")
        .when(has_ctx & same, "retry_previous_failed")
        .when(has_ctx & (F.col("ctx_job_status") == "job-failed"), "job_failed")
        .when(has_ctx & (F.col("ctx_job_status") == "job-started"), "other_job_running")
        .when(in_cat, "in_catalog")
        .otherwise("no_es_doc")
    )
    return df.select(*candidates.columns, decision.alias("decision"), reason.alias("reason"))


# ------------------------------------------------------------ C1 - C5 ----


def build_catalog(datasets: DataFrame, index: str | None = None, recognised: DataFrame | None = None,
                  metadata: DataFrame | None = None, fields: str | None = None, key: str = "id") -> DataFrame:
    """Full catalog record from recognised datasets.

    ``datasets`` carries id and, unless ``recognised`` (key, ipath, version,
    level, type) is joined, those; ``dataset`` is the ipath part after the
    slash.  ``metadata`` (key, extracted, seed: maps) is joined: the
    extractor's entries, over which the seed's count.  ``fields`` names a
    struct with the dataset file's own fields: each that is there overrides the
    record, and what the record lacks is added.  The index result comes last.
    """
    rec = datasets
    if recognised is not None:
        rec = rec.join(recognised.select(key, "ipath", "version", "level", "type"), key, "left")
    if metadata is not None:
        empty = F.create_map().cast("map<string,string>")
        both = F.map_concat(F.coalesce("extracted", empty), F.coalesce("seed", empty))
        rec = rec.join(metadata.select(key, both.alias("metadata")), key, "left").withColumn("metadata", F.coalesce("metadata", empty))
    base = {
        "objectid": F.col(key),
        "dataset": F.split(F.col("ipath"), "/").getItem(1),
        "system_version": F.col("version"),
        "dataset_level": F.col("level"),
        "dataset_type": F.col("type"),
    }
    for c in ("urls", "browse_urls"):
        if c not in rec.columns:
            base[c] = F.array().cast("array<string>")
    rec = rec.withColumns(base)
    if fields:
        own = {n: F.col(fields)[n] for n in rec.schema[fields].dataType.fieldNames()}
        rec = rec.withColumns({n: F.coalesce(c, F.col(n)) if n in rec.columns and n != fields else c for n, c in own.items()}).drop(fields)
    return rec.withColumns({
        "index": F.lit(index).cast("string"),
        "grq_index_result": F.struct(F.lit(index).cast("string").alias("index")),
    })


def staged_products(published: DataFrame, nbytes: str = "disk_usage", secs: str = "duration") -> DataFrame:
    """Per-product staging record: usage, duration, rate and the
    product's ids, urls and index."""
    return published.withColumn("transfer_rate", transfer_rate(nbytes, secs))


def lineage_edges(products: DataFrame, inputs: DataFrame, jobs: DataFrame, product: str = "product_id",
                  job: str = "job_id", task: str = "task_id", url: str = "url", agent: str = "agent") -> DataFrame:
    """Provenance edges (subject, relation, object).

    product wasGeneratedBy task; task used input url; task wasAssociatedWith
    agent (worker host and pid).  Every product of a task wasDerivedFrom every
    input of it; the task is the class of both, so these pairs are kept as
    their two factors, one row per product and per input, and ``derived_from``
    expands them on demand.  Products and inputs meet the jobs in one join.
    """
    items = products.select(job, F.lit(True).alias("_made"), F.concat(F.lit("product:"), F.col(product)).alias("_item")).unionByName(
        inputs.select(job, F.lit(False).alias("_made"), F.concat(F.lit("url:"), F.col(url)).alias("_item")))
    t = F.concat(F.lit("task_id:"), F.col(task))
    edges = items.join(jobs.select(job, t.alias("_task")), job).select(
        F.when(F.col("_made"), F.col("_item")).otherwise(F.col("_task")).alias("subject"),
        F.when(F.col("_made"), F.lit("wasGeneratedBy")).otherwise(F.lit("used")).alias("relation"),
        F.when(F.col("_made"), F.col("_task")).otherwise(F.col("_item")).alias("object"))
    return edges.unionByName(jobs.select(t.alias("subject"), F.lit("wasAssociatedWith").alias("relation"), F.concat(F.lit("agent:"), F.col(agent)).alias("object")))


def derived_from(edges: DataFrame, products: DataFrame | None = None, product: str = "product_id") -> DataFrame:
    """The pairs (product, wasDerivedFrom, url) of ``products``, or of all."""
    member = edges.where(F.col("relation") == "wasGeneratedBy").select(F.col("subject").alias("_product"), F.col("object").alias("_task"))
    if products is not None:
        wanted = products.select(F.concat(F.lit("product:"), F.col(product).cast("string")).alias("_product")).distinct()
        member = member.join(wanted, "_product", "left_semi")
    source = edges.where(F.col("relation") == "used").select(F.col("subject").alias("_task"), "object")
    return member.join(source, "_task").select(F.col("_product").alias("subject"), F.lit("wasDerivedFrom").alias("relation"), "object")


def _edge(subject: Column, relation: str, obj: Column) -> Column:
    return F.struct(subject.alias("subject"), F.lit(relation).alias("relation"), obj.alias("object"))


def publish_edges(published: DataFrame, path: str = "path", url: str = "url", node: str = "node", pid: str = "pid",
                  started: str = "time_start") -> DataFrame:
    """The publish step of each product: it used the local copy, made the
    published url, and an agent (host, process, start) stands behind it."""
    step = F.concat(F.lit("publish_dataset-"), F.regexp_extract(F.col(path), "([^/]*)/*$", 1))
    local = F.concat(F.lit("file://"), F.col(node), F.col(path))
    who = F.concat_ws("/", F.lit("publish_dataset"), F.col(node), F.col(pid).cast("string"), F.date_format(F.col(started), "yyyy-MM-dd'T'HH:mm:ss"))
    edges = F.array(_edge(step, "used", local), _edge(F.col(url), "wasGeneratedBy", step), _edge(step, "wasAssociatedWith", who))
    return published.select(F.explode(edges).alias("_e")).select("_e.*")


STEP_COLS = ("start", "end", "job_id", "job_type")


def merge_activity(activities: DataFrame, steps: DataFrame, doc: str = "doc_id", activity: str = "activity_id") -> DataFrame:
    """C4: the publish step merged into provenance documents.

    ``activities`` (doc, activity, start, end, job_id, job_type, prov_type) are
    those that the documents have, ``steps`` the same columns with one row per
    document.  A document with a single activity keeps its id (and its
    ``prov_type``, if it has one) and takes the step's times, job id and job
    type; with several, or none, the step's activity stands beside them.
    ``replaces`` is the step's own activity id where it became the existing one.
    """
    only = activities.groupBy(doc).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col(activity).alias("id"), "prov_type")).alias("_only"))
    merges = F.col("_n") == 1
    step = steps.join(only, doc, "left").select(
        doc, F.when(merges, F.col("_only.id")).otherwise(F.col(activity)).alias(activity), *STEP_COLS,
        F.when(merges, F.coalesce("_only.prov_type", "prov_type")).otherwise(F.col("prov_type")).alias("prov_type"),
        F.when(merges, F.col(activity)).alias("replaces"))
    gone = step.filter(F.col("replaces").isNotNull()).select(doc, activity)
    own = activities.join(gone, [doc, activity], "left_anti").withColumn("replaces", F.lit(None).cast("string"))
    return own.select(*step.columns).unionByName(step)


def merge_associations(associations: DataFrame, merged: DataFrame, doc: str = "doc_id", activity: str = "activity_id") -> DataFrame:
    """C4: associations (doc, activity, agent) follow a step's activity to the
    one it was merged into (``merged``: the rows of ``merge_activity``)."""
    to = merged.filter(F.col("replaces").isNotNull()).select(doc, F.col("replaces").alias(activity), F.col(activity).alias("_to"))
    return associations.join(to, [doc, activity], "left").withColumn(activity, F.coalesce("_to", activity)).select(*associations.columns)


def triage_records(jobs: DataFrame, version: str = "v1", partition_format: str | None = None,
                   as_of=None) -> DataFrame:
    """Catalog rows for failed jobs: id, label, start/end, and an index
    suffix when a time partition format is configured."""
    cand = triage_candidates(jobs)
    tid = triage_id("job_id", "task_id", F.col("triage_id_format") if "triage_id_format" in jobs.columns else None)
    parsed = F.when(F.col("job_id").rlike(r"triaged_job-(.+)_task-([-\w])"),
                    F.regexp_extract("job_id", r"triaged_job-(.+)_task-([-\w])", 1)).otherwise(F.col("job_id"))
    out = cand.select(
        "job_id", tid.alias("id"), F.lit(version).alias("version"),
        F.concat(F.lit("triage for job "), parsed).alias("label"),
        F.col("cmd_start").alias("starttime") if "cmd_start" in jobs.columns else F.lit(None).cast("timestamp").alias("starttime"),
        F.col("cmd_end").alias("endtime") if "cmd_end" in jobs.columns else F.lit(None).cast("timestamp").alias("endtime"),
    )
    if partition_format and as_of is not None:
        out = out.withColumn("index_suffix", F.concat(F.lit(version + "_"), F.date_format(F.lit(as_of).cast("timestamp"), partition_format), F.lit("_triaged_job")))
    return out


def template_ids(df: DataFrame, template: str, name: str = "dataset_id") -> DataFrame:
    """P21 applied: a ``{group}`` template expanded from recognised groups."""
    return df.withColumn(name, F.when(F.col("position").isNotNull(), expand_template(template)))
