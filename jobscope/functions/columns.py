"""Scalar column functions.

Each function builds a JVM-side ``Column`` expression: no Python runs per
row, so everything stays inside whole-stage codegen.  Where a parameter is a
template, pattern or path it is compiled on the driver into an expression
once per query, never per row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- P1, P2 --


def tags_as_array(col) -> Column:
    """A tags value that may be a scalar string, a JSON list text or an array."""
    c = _c(col)
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(
        F.when(
            F.trim(c).startswith("["),
            F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")),
        ).otherwise(F.array(c))
    )


def normalize_job_event(df: DataFrame) -> DataFrame:
    """Prepare a job status document for indexing.

    Drops the duplicated top-level ``context``; sets ``resource='job'`` and
    ``type`` to the job's type (``unknown`` when absent); turns a scalar tag
    value into a list and appends the job's own tag.
    """
    if "context" in df.columns:
        df = df.drop("context")
    jtype = F.col("job.type") if _has_field(df, "job.type") else F.lit(None).cast("string")
    tags = F.col("tags")
    if isinstance(df.schema["tags"].dataType, T.StringType):
        tags = tags_as_array(tags)
    else:
        tags = F.coalesce(tags, F.array().cast("array<string>"))
    if _has_field(df, "job.tag"):
        tags = F.when(F.col("job.tag").isNotNull(), F.array_append(tags, F.col("job.tag"))).otherwise(tags)
    return df.withColumns(
        {
            "resource": F.lit("job"),
            "type": F.coalesce(jtype, F.lit("unknown")),
            "tags": tags,
        }
    )


def _has_field(df: DataFrame, path: str) -> bool:
    dt = df.schema
    for part in path.split("."):
        if not isinstance(dt, T.StructType) or part not in dt.fieldNames():
            return False
        dt = dt[part].dataType
    return True


def document_id(resource="resource", uuid="uuid", hostname="celery_hostname") -> Column:
    """Key of the stored document: host name for workers, uuid otherwise."""
    r = _c(resource)
    return F.when(r == "worker", _c(hostname)).when(r.isin("job", "task", "event"), _c(uuid))


# ------------------------------------------------------------ P3 - P6 --


def truncate_epoch(col) -> Column:
    """Epoch-seconds text cut at the decimal point."""
    return F.substring_index(_c(col).cast("string"), ".", 1)


ISO_FRACTION = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parse_iso_utc(col) -> Column:
    """The two accepted ISO layouts (with or without fraction), UTC.

    Any other text is invalid and yields null (the caller decides whether a
    null is a skip or an error).  Requires the session zone UTC.
    """
    c = _c(col)
    valid = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$")
    return F.when(valid, F.coalesce(F.try_to_timestamp(c, F.lit(ISO_FRACTION)), F.try_to_timestamp(c, F.lit(ISO_SECONDS))))


def format_iso(col) -> Column:
    """P5: ISO text with ``Z``; the fraction only when it is not zero."""
    c = _c(col)
    whole = (F.unix_micros(c) % 1_000_000) == 0
    return F.when(whole, F.date_format(c, ISO_SECONDS)).otherwise(F.date_format(c, ISO_FRACTION))


def daily_partition(prefix, ts) -> Column:
    """``prefix-yyyy.MM.dd`` daily partition name."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(p, F.lit("-"), F.date_format(_c(ts), "yyyy.MM.dd"))


def minute_path(ts) -> Column:
    """``yyyy/MM/dd/HH/mm`` work-directory path part."""
    return F.date_format(_c(ts), "yyyy/MM/dd/HH/mm")


# ------------------------------------------------------------ P7, P8 --


def short_error(col) -> Column:
    """Errors over 35 chars become first 20 + ``.....`` + last 10."""
    c = _c(col)
    return F.when(
        F.length(c) > 35,
        F.concat(F.substring(c, 1, 20), F.lit("....."), F.substring(c, -10, 10)),
    ).otherwise(c)


# Payload keys that do not take part in the hash.  Fixed values.
VOLATILE_PAYLOAD_KEYS = ("_disk_usage", "_sciflo_job_num", "_sciflo_wuid")


def payload_hash(payload_map) -> Column:
    """P8, native form: MD5 of the payload map without the volatile keys,
    keys sorted.  Canonical form is Spark's ``to_json`` of the sorted map,
    so it is stable across runs but not byte-equal to the reference's
    ``json.dumps`` text; use ``payload_hash_compatible`` for that."""
    m = F.map_filter(_c(payload_map), lambda k, v: ~k.isin(*VOLATILE_PAYLOAD_KEYS))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(m)))
    return F.md5(F.to_json(ordered))


def payload_hash_compatible(payload_json) -> Column:
    """P8, byte-compatible form over JSON text (nested payloads): Arrow-batched
    ``pandas_udf`` applying the same canonical dump as the reference."""
    from jobscope.functions.udf import payload_hash_udf

    return payload_hash_udf(_c(payload_json))


# ------------------------------------------------------------ P9 - P12 --

JOB_TYPE_PATTERN = r"^\w+?:(.*)$"
DATA_TYPE_PATTERN = r"^dataset:\w+?::data/(.*)$"


def job_type_of(col) -> Column:
    """Strip a leading ``word:`` prefix (first colon only)."""
    c = _c(col)
    return F.when(c.rlike(JOB_TYPE_PATTERN), F.regexp_extract(c, JOB_TYPE_PATTERN, 1)).otherwise(c)


def data_type_of(col) -> Column:
    """The data type of a ``dataset:<word>::data/<type>`` job type, else null."""
    c = _c(col)
    return F.when(c.rlike(DATA_TYPE_PATTERN), F.regexp_extract(c, DATA_TYPE_PATTERN, 1))


WORKER_HOST_PATTERN = r"^celery@(.+?)\..+$"
ARGS_TYPE_PATTERN = r"'type': '(.+?)',"


def worker_type(hostname="celery_hostname", args=None) -> Column:
    """P10: job type from ``celery@<type>.<host>``, else from the task args
    text, else ``unknown``."""
    h = F.nullif(F.regexp_extract(F.coalesce(_c(hostname), F.lit("")), WORKER_HOST_PATTERN, 1), F.lit(""))
    a = (
        F.nullif(F.regexp_extract(F.coalesce(_c(args), F.lit("")), ARGS_TYPE_PATTERN, 1), F.lit(""))
        if args is not None
        else F.lit(None).cast("string")
    )
    return F.coalesce(h, a, F.lit("unknown"))


# Supervisory failure classes: the worker had no chance to report.  A soft
# time limit is not one (the lookbehind rejects SoftTimeLimitExceeded).
FAILURE_CLASS_PATTERN = r"(?<![A-Za-z])(WorkerLostError|TimeLimitExceeded|ConnectionError)"


def failure_class(col) -> Column:
    """The supervisory failure class named in an exception text, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(_c(col), F.lit("")), FAILURE_CLASS_PATTERN, 1), F.lit(""))


def json_path(path: str) -> str:
    """Dotted path with integer list steps -> JSONPath (``a.0.b`` -> ``$.a[0].b``)."""
    out = "$"
    for step in path.split("."):
        if step == "":
            continue
        out += f"[{step}]" if step.isdigit() else f".{step}"
    return out


def extract_path(doc_json, path: str) -> Column:
    """Value at a dotted path in a JSON document, null when absent."""
    return F.get_json_object(_c(doc_json), json_path(path))


# ------------------------------------------------------------ P13 - P16 --

INT64_MAX = 9223372036854775807


def clamp_counter(col) -> Column:
    """A DECIMAL(20,0) counter over the signed 64-bit range becomes -1."""
    c = _c(col)
    return F.when(c > F.lit(INT64_MAX).cast("decimal(20,0)"), F.lit(-1)).otherwise(c).cast("bigint")


def _clamp_expr(col: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.DecimalType) and dt.scale == 0:
        return clamp_counter(col)
    if isinstance(dt, T.StructType):
        return F.struct(*[_clamp_expr(col.getField(f.name), f.dataType).alias(f.name) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return F.transform(col, lambda x: _clamp_expr(x, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.transform_values(col, lambda k, v: _clamp_expr(v, dt.valueType))
    return col


def clamp_counters(df: DataFrame, part: str = "cgroups") -> DataFrame:
    """Recursively, in the ``part`` column only, counters over 2^63-1 -> -1.

    Read counters as DECIMAL(20,0) so the unsigned values survive the read;
    the expression tree is built on the driver from the schema.
    """
    if part not in df.columns:
        return df
    return df.withColumn(part, _clamp_expr(F.col(part), df.schema[part].dataType))


def hard_limit(soft, limit, gap: int = 60) -> Column:
    """The hard time limit is at least the soft limit plus the gap."""
    s, h = _c(soft), _c(limit)
    return F.when(s.isNotNull() & (h.isNull() | (h <= s + gap)), s + gap).otherwise(h)


NUMBER_TOKEN = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"


def numeric_limit(col) -> Column:
    """A time limit as a number, or null when the stored JSON token is not a
    number (text, boolean, null, absent).  Quoted numbers are text."""
    c = F.trim(_c(col).cast("string"))
    return F.when(c.rlike(NUMBER_TOKEN), c.cast("double"))


def status_ttl(limit, default: int = 86400, gap: int = 60) -> Column:
    """Status key lifetime: max(default, int(limit) + 2*gap) for numeric
    limits, else the default."""
    n = numeric_limit(limit)
    return F.when(n.isNull(), F.lit(default)).otherwise(
        F.greatest(F.lit(default).cast("bigint"), n.cast("bigint") + 2 * gap)
    )


# Size units in bytes (base 1024).  Fixed values.
SIZE_UNITS = {"GB": 1024**3, "MB": 1024**2, "KB": 1024}


def bytes_from_size(col, strict: bool = True) -> Column:
    """``"10GB"`` -> bytes.  An unknown unit is an error (strict) or null."""
    c = F.trim(_c(col))
    num = F.regexp_extract(c, r"^(-?\d+)(GB|MB|KB)$", 1)
    unit = F.regexp_extract(c, r"^(-?\d+)(GB|MB|KB)$", 2)
    mult = F.when(unit == "GB", F.lit(SIZE_UNITS["GB"])).when(unit == "MB", F.lit(SIZE_UNITS["MB"])).when(
        unit == "KB", F.lit(SIZE_UNITS["KB"])
    )
    val = num.cast("bigint") * mult
    if strict:
        return F.when(c.isNull(), F.lit(None).cast("bigint")).when(
            unit == "", F.raise_error(F.concat(F.lit("cannot determine disk usage from: "), c)).cast("bigint")
        ).otherwise(val)
    return F.when(unit != "", val)


def required_free_pct(capacity, need_bytes) -> Column:
    """The need as a percentage of capacity, rounded up."""
    return F.ceil(F.lit(100.0) / _c(capacity).cast("double") * _c(need_bytes)).cast("bigint")


# ------------------------------------------------------------ P17 - P20 --


def seconds_between(later, earlier) -> Column:
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / F.lit(1e6)


def job_durations(df: DataFrame, prefix: str = "") -> DataFrame:
    """Run duration, command duration and queue wait in seconds."""
    g = (lambda n: F.col(prefix + n)) if prefix else F.col
    cols = {
        "duration": seconds_between(g("time_end"), g("time_start")),
        "wait": seconds_between(g("time_start"), g("time_queued")),
    }
    names = set(df.columns) if not prefix else None
    if names is None or ("cmd_start" in names and "cmd_end" in names):
        cols["cmd_duration"] = seconds_between(g("cmd_end"), g("cmd_start"))
    return df.withColumns(cols)


def transfer_rate(bytes_col, seconds_col) -> Column:
    """Bytes per second; null for a zero or missing duration."""
    return F.try_divide(_c(bytes_col).cast("double"), F.nullif(_c(seconds_col).cast("double"), F.lit(0.0)))


def product_latency(df: DataFrame, start="time_start", available="availability_time",
                    acquisition="acquisition_start_time", source_production="source_production_time") -> DataFrame:
    """Latencies in minutes.  Ground-system and access latency exist only
    when both source times exist; total latency accumulates them."""
    proc = seconds_between(available, start) / 60.0
    both = _c(acquisition).isNotNull() & _c(source_production).isNotNull()
    ground = F.when(both, seconds_between(source_production, acquisition) / 60.0)
    access = F.when(both, seconds_between(available, source_production) / 60.0)
    total = proc + F.coalesce(ground, F.lit(0.0)) + F.coalesce(access, F.lit(0.0))
    return df.withColumns(
        {
            "processing_latency": proc,
            "ground_system_latency": ground,
            "access_latency": access,
            "total_latency": total,
        }
    )


def _at(col: Column, dt: T.DataType, steps: list[str], part: str) -> Column:
    """``col`` with the counters of ``part`` clamped at the end of ``steps``."""
    if isinstance(dt, T.ArrayType):
        return F.transform(col, lambda x: _at(x, dt.elementType, steps, part))
    if not isinstance(dt, T.StructType) or (steps[0] if steps else part) not in dt.fieldNames():
        return col
    name = steps[0] if steps else part
    inner = _at(col[name], dt[name].dataType, steps[1:], part) if steps else _clamp_expr(col[name], dt[name].dataType)
    return col.withField(name, inner)


def clamp_usage(df: DataFrame, path: str = "job.job_info.metrics.usage_stats", part: str = "cgroups",
                resource: str = "resource") -> DataFrame:
    """P13 on stored documents: the counters in ``part`` of every usage sample
    at the nested ``path`` of job documents; other documents, and a path that
    the schema lacks, stay as they are."""
    first, *steps = path.split(".")
    if first not in df.columns:
        return df
    new = _at(F.col(first), df.schema[first].dataType, steps, part)
    if resource in df.columns:
        new = F.when(F.col(resource) == "job", new).otherwise(F.col(first))
    return df.withColumn(first, new)


# Fact names in order of preference.  Fixed values.
EXECUTE_NODE_FACTS = ("ec2_public_hostname", "ec2_public_ipv4", "fqdn")
PUBLIC_IP_FACTS = ("ec2_public_ipv4", "ipaddress_eth0", "ipaddress")
# Address ranges of carrier-grade NAT and of private networks.  Fixed values.
CGNAT_PATTERN = r"^100\.(6[4-9]|[7-9][0-9]|1[0-1][0-9]|12[0-7])\..*"
PRIVATE_PATTERN = r"^(?:10|127|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\..*"


def execute_node(facts="facts") -> Column:
    """P20: first present of the ranked host-name facts (MAP<STRING,STRING>)."""
    f = _c(facts)
    return F.coalesce(*[F.element_at(f, F.lit(k)) for k in EXECUTE_NODE_FACTS])


def public_ip(facts="facts") -> Column:
    """P20: first present ranked address."""
    f = _c(facts)
    return F.coalesce(*[F.element_at(f, F.lit(k)) for k in PUBLIC_IP_FACTS])


def public_address(facts="facts") -> Column:
    """P20: the address and whether it is known to be the public one.

    A carrier-grade-NAT address is taken as public; any other needs a lookup
    outside (``lookup``), for which the address is what stands in.
    """
    ip = public_ip(facts)
    return F.struct(ip.alias("address"), (~F.coalesce(is_cgnat(ip), F.lit(False))).alias("lookup"))


def is_cgnat(ip) -> Column:
    return _c(ip).rlike(CGNAT_PATTERN)


def is_private(ip) -> Column:
    return _c(ip).rlike(PRIVATE_PATTERN)


# ------------------------------------------------------------ P21 - P24 --

_PLACEHOLDER = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def expand_template(template: str, group_cols: dict | None = None) -> Column:
    """A ``{name}`` template compiled once into ``concat(lit, col, ...)``.

    ``group_cols`` maps placeholder names to columns (default: the column of
    the same name).  An unknown placeholder raises on the driver.
    """
    group_cols = group_cols or {}
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos : m.start()]))
        name = m.group(1)
        c = group_cols.get(name, F.col(name))
        parts.append(_c(c).cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    if not parts:
        return F.lit("")
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def expand_templates(templates: Sequence[str], group_cols: dict | None = None) -> Column:
    """P21 for url lists: ``array`` of expanded templates."""
    return F.array(*[expand_template(t, group_cols) for t in templates]) if templates else F.array().cast("array<string>")


def valid_partition_pattern(col) -> Column:
    """No leading or trailing comma, and not made only of ``*``."""
    c = F.trim(_c(col))
    return ~(c.startswith(",") | c.endswith(",")) & ~c.rlike(r"^\*+$")


BROWSE_TOOLTIP_PATTERN = r"^.*?\.(.*?)\.browse\.png$"


def browse_images(images_col, order_patterns: Sequence[str] = ()) -> Column:
    """Image records ``{img, small_img, tooltip}`` for ``*browse.png`` names.

    ``images_col`` is an array of file names in the product directory.  With
    ``order_patterns`` the records are ordered by the first pattern each name
    matches; of two names on one pattern the later one wins (the earlier is
    dropped); unmatched names follow in input order.
    """
    names = _c(images_col)
    pngs = F.filter(names, lambda n: n.endswith("browse.png"))

    def record(n, i):
        small = F.regexp_replace(n, "browse\\.png", "browse_small.png")
        return F.struct(
            n.alias("img"),
            F.when(F.array_contains(names, small), small).alias("small_img"),
            F.regexp_extract(n, BROWSE_TOOLTIP_PATTERN, 1).alias("tooltip"),
            i.alias("pos"),
        )

    recs = F.transform(pngs, record)
    if not order_patterns:
        return F.transform(recs, lambda r: r.dropFields("pos"))
    big = len(order_patterns)

    def key(r):
        e = F.lit(big)
        for i, p in reversed(list(enumerate(order_patterns))):
            e = F.when(r["img"].rlike(p), F.lit(i)).otherwise(e)
        return e
    keyed = F.transform(recs, lambda r: r.withField("k", key(r)))
    # of the records of one pattern a map keeps the last
    matched = F.map_from_entries(F.transform(F.filter(keyed, lambda r: r["k"] < big), lambda r: F.struct(r["k"].alias("key"), r.alias("value"))))
    first = F.transform(F.array_sort(F.transform(F.map_values(matched), lambda r: F.struct(r["k"].alias("k"), r.alias("r")))), lambda x: x["r"])
    ordered = F.concat(first, F.filter(keyed, lambda r: r["k"] == big))
    return F.transform(ordered, lambda r: r.dropFields("pos", "k"))


# Error texts of failed publications.  Fixed values (patterns).
NO_CLOBBER_OBJECT_PATTERN = r"Destination,\s+s3://.+?/(.+?)/(.+/(.+))/.+?, already exists and no-clobber is set"
NO_CLOBBER_DAV_PATTERN = r"Destination,\s+(davs?)://(.+?/.+/(.+))/.+?, already exists and no-clobber is set"
COOPERATION_PATTERN = r"Cooperation not possible for\s+s3://.+?/(.+?)/(.+/(.+))/.+?"


def error_target(df: DataFrame, error: str = "error") -> DataFrame:
    """Store, bucket, prefix and dataset id from a failed-publish error."""
    e = F.coalesce(F.col(error), F.lit(""))
    s3 = e.rlike(NO_CLOBBER_OBJECT_PATTERN)
    dav = e.rlike(NO_CLOBBER_DAV_PATTERN)
    coop = e.rlike(COOPERATION_PATTERN)

    def g(p, i):
        return F.regexp_extract(e, p, i)

    store = F.when(s3, "s3").when(dav, g(NO_CLOBBER_DAV_PATTERN, 1)).when(coop, "s3")
    bucket = F.when(s3, g(NO_CLOBBER_OBJECT_PATTERN, 1)).when(coop, g(COOPERATION_PATTERN, 1))
    prefix = (
        F.when(s3, g(NO_CLOBBER_OBJECT_PATTERN, 2))
        .when(dav, g(NO_CLOBBER_DAV_PATTERN, 2))
        .when(coop, g(COOPERATION_PATTERN, 2))
    )
    ds = (
        F.when(s3, g(NO_CLOBBER_OBJECT_PATTERN, 3))
        .when(dav, g(NO_CLOBBER_DAV_PATTERN, 3))
        .when(coop, g(COOPERATION_PATTERN, 3))
    )
    return df.withColumns({"store": store, "bucket": bucket, "prefix": prefix, "dataset_id": ds})


# ------------------------------------------------------------ P26 - P29 --


def merge_metadata(extracted, seed, dataset_fields=None) -> Column:
    """Extractor output, then seed overrides, then dataset fields.

    Requires ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` (set by ``get_spark``).
    """
    maps = [F.coalesce(_c(extracted), F.create_map().cast("map<string,string>")),
            F.coalesce(_c(seed), F.create_map().cast("map<string,string>"))]
    if dataset_fields is not None:
        maps.append(F.coalesce(_c(dataset_fields), F.create_map().cast("map<string,string>")))
    return F.map_concat(*maps)


INT_TEXT = r"^(0|-?[1-9][0-9]*)$"
FLOAT_TEXT = r"^-?(0|[1-9][0-9]*)\.(0|[0-9]*[1-9])$"


def metric_number(col) -> Column:
    """The metric value as a number only when the text is the canonical
    print of an integer or float (``7``, ``-3``, ``1.0``, ``0.25``; not ``007``,
    ``1.50``, ``1e3``, ``+1`` or empty).  Floats print in plain form only in
    [1e-4, 1e16); outside that band the text is not claimed numeric unless it
    is an integer."""
    c = F.regexp_replace(_c(col), r"(\r\n|\n|\r)$", "")
    is_int = c.rlike(INT_TEXT)
    d = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    is_float = c.rlike(FLOAT_TEXT) & (
        (F.abs(d) < 1e16) & ((F.abs(d) >= 1e-4) | (d == 0))
    )
    return F.when(is_int | is_float, c.try_cast("double"))


DEFAULT_TRIAGE_FORMAT = "triaged_job-{job_id}_task-{job[task_id]}"
TRIAGE_UNWRAP_PATTERN = r"triaged_job-(.+)_task-([-\w])"


def triage_id(job_id="job_id", task_id="task_id", fmt=None, job_info_id=None) -> Column:
    """Triage dataset id.

    A job id that is already a triage id is unwrapped first.  The format is
    per row (the job context may carry one); the known placeholders are
    ``{job_id}``, ``{job[task_id]}`` and ``{job[job_info][id]}``.  A format
    left with any other placeholder falls back to the default format.
    """
    jid = _c(job_id)
    parsed = F.when(jid.rlike(TRIAGE_UNWRAP_PATTERN), F.regexp_extract(jid, TRIAGE_UNWRAP_PATTERN, 1)).otherwise(jid)
    tid = F.coalesce(_c(task_id).cast("string"), F.lit("None"))
    info_id = _c(job_info_id).cast("string") if job_info_id is not None else jid

    def render(f):
        r = F.replace(f, F.lit("{job_id}"), parsed)
        r = F.replace(r, F.lit("{job[task_id]}"), tid)
        r = F.replace(r, F.lit("{job[job_info][id]}"), F.coalesce(info_id, F.lit("None")))
        return r

    default = render(F.lit(DEFAULT_TRIAGE_FORMAT))
    if fmt is None:
        return default
    custom = render(_c(fmt))
    bad = _c(fmt).isNull() | custom.rlike(r"\{[^{}]*\}")
    return F.when(bad, default).otherwise(custom)


def local_path(url="url", path="local_path", job_dir="job_dir") -> Column:
    """Where an input lands: the job dir by default, a relative path
    joined to it, and a trailing slash keeps the url's file name."""
    p, d, u = _c(path), _c(job_dir), _c(url)
    joined = F.when(d.endswith("/"), F.concat(d, p)).otherwise(F.concat(d, F.lit("/"), p))
    base = F.when(p.isNull(), F.concat(d, F.lit("/"))).when(p.startswith("/"), p).otherwise(joined)
    return F.when(base.endswith("/"), F.concat(base, F.substring_index(u, "/", -1))).otherwise(base)
