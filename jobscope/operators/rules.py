"""Standing rules matched against new datasets and finished jobs.

All enabled rules are matched in ONE scan of the documents.  A few rules are
``when(cond_i, rule_i)`` items of one array, which is filtered and exploded.
Where there are many, those that demand ``column = 'text'`` are filed by that
term instead: a row is joined (broadcast, rules are configuration) to the rules
filed under its own values, so it meets its candidates only.  Rules that differ
in their literals only share one compiled condition, which takes the literals
from the rule's row; so thousands of rules make a small plan.  A rule that fails
to parse or analyse is reported and skipped; the others still run.

``query_all`` rules are not restricted to the triggering document: they fire
when any catalog document of the same version matches.  That is one
aggregation over the catalog per version (partial, map-side), joined back on
version, or without versions one row, taken as a scalar subquery.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions.predicates import RuleError, compile_rule

# Rules per array column; more rules just add columns to the same projection
# (keeps each generated method under the JVM's size limits).
RULES_PER_ARRAY = 256


#: With more rules than this that have a term to be filed by, they are.
FILE_FROM = 64


@dataclass
class Filed:
    """Rules of one condition but for its literals, and the column whose value files them."""

    column: str
    condition: Column  # reads the literals from the column _p
    rules: list[tuple[dict, str, list[str]]]  # rule, value, literals


@dataclass
class CompiledRules:
    good: list[tuple[dict, Column]]
    bad: list[tuple[str, str]]
    filed: list[Filed] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.good) + len(self.bad) + sum(len(f.rules) for f in self.filed)

    def names(self) -> list[str]:
        return [r["rule_name"] for r, _ in self.good] + [r["rule_name"] for f in self.filed for r, _, _ in f.rules]

    def errors(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.bad, "rule_name string, error string")


def _rule_dicts(rules) -> list[dict]:
    if isinstance(rules, DataFrame):
        r = rules
        if "enabled" in r.columns:
            r = r.filter(F.coalesce(F.col("enabled"), F.lit(False)))
        return [row.asDict() for row in r.collect()]
    return [dict(x) for x in rules if x.get("enabled", True)]


def valid_index_pattern(pattern: str | None) -> bool:
    """A pattern that restricts: not empty, no comma at either end, not wildcards only."""
    p = (pattern or "").strip()
    return bool(p) and not p.startswith(",") and not p.endswith(",") and set(p) != {"*"}


def in_index(index: Column, pattern: str) -> Column:
    """Whether an index name matches one of the comma-separated patterns with ``*`` wildcards."""
    names = [".*".join(re.escape(part) for part in p.strip().split("*")) for p in pattern.split(",") if p.strip()]
    return F.coalesce(index.rlike("^(?:" + "|".join(names) + ")$"), F.lit(False))


#: Text and number literals of a condition that are taken out of it; others leave it as it is.
LITERAL = re.compile(r"'([^'\\]*)'|(?<![\w.'\"`])(\d+)(?![\w.'\"`])")


def shape_of(rule: dict) -> tuple[str, list[str]] | None:
    """A rule's condition with its literals replaced by ``_p[i]``, and the literals; None if it can't be written so."""
    text = rule.get("query_string")
    if not text or any(mark in text for mark in ("\\", '"', "`", "--", "/*", "''")) or "_p" in text:
        return None
    if re.search(r"(?i)(\b(date|timestamp|interval|x|r|escape)|')\s*'", LITERAL.sub(lambda m: m.group(0) if m.group(1) is None else "'" + "_" * len(m.group(1)) + "'", text)):
        return None
    values: list[str] = []

    def out(m) -> str:
        values.append(m.group(1) if m.group(1) is not None else m.group(2))
        if m.group(1) is not None:
            return f"_p[{len(values) - 1}]"
        return f"cast(_p[{len(values) - 1}] as {'int' if int(m.group(2)) < 1 << 31 else 'bigint'})"

    return LITERAL.sub(out, text), values


def term_of(shape: str, docs: DataFrame) -> tuple[str, int] | None:
    """A text column that every match must have equal to a literal, and the literal's number.

    Only a condition of terms joined by AND, without OR, NOT and brackets, is looked at.
    """
    if re.search(r"(?i)\b(or|not|case|between)\b|\((?!_p\[\d+\] as )(?!\w)", shape):
        return None
    texts = {f.name.lower(): f.name for f in docs.schema.fields if f.dataType.simpleString() == "string"}
    for part in re.split(r"(?i)\band\b", shape):
        m = re.fullmatch(r"\s*(\w+)\s*={1,2}\s*_p\[(\d+)\]\s*", part)
        if m and m.group(1).lower() in texts:
            return texts[m.group(1).lower()], int(m.group(2))
    return None


def compile_rules(docs: DataFrame, rules, index_col: str | None = "index", file_from: int = FILE_FROM) -> CompiledRules:
    """The rules' conditions.  A rule with a valid ``index_pattern`` matches
    only documents whose ``index_col`` it covers; an invalid or empty one
    falls back to all documents.  Of one shape of condition, one rule is
    checked and analysed for all."""
    good, bad = [], []
    rules = sorted(_rule_dicts(rules), key=lambda r: r["rule_name"])
    shapes: dict[tuple, list] = {}
    for rule in rules:
        found = shape_of(rule)
        term = term_of(found[0], docs) if found else None
        if term and not rule.get("query_all") and not valid_index_pattern(rule.get("index_pattern")):
            shapes.setdefault((found[0], term), []).append((rule, found[1]))
    filed, done = [], set()
    if sum(map(len, shapes.values())) > file_from:
        wide = docs.withColumn("_p", F.array().cast("array<string>"))
        for (shape, (column, at)), some in shapes.items():
            try:
                compile_rule(docs, some[0][0]["rule_name"], some[0][0]["query_string"])
                condition = compile_rule(wide, some[0][0]["rule_name"], shape)
            except RuleError:
                continue  # each is tried, and reported, alone
            filed.append(Filed(column, condition, [(rule, values[at], values) for rule, values in some]))
            done |= {rule["rule_name"] for rule, _ in some}
    for rule in rules:
        if rule["rule_name"] in done:
            continue
        try:
            cond = compile_rule(docs, rule["rule_name"], rule.get("query_string"))
            pattern = rule.get("index_pattern")
            if valid_index_pattern(pattern):
                if index_col not in docs.columns:
                    raise RuleError(rule["rule_name"], f"index_pattern {pattern} needs the column {index_col}")
                cond = in_index(F.col(index_col), pattern) & cond
            good.append((rule, cond))
        except RuleError as e:
            bad.append((e.rule_name, e.reason))
    return CompiledRules(good, bad, filed)


def trigger_name(job_type: str | None, prefix: str | None) -> str:
    jt = job_type or ""
    if prefix and jt.startswith(prefix):
        jt = jt[len(prefix):]
    return jt


def _rule_struct(rule: dict, prefix: str | None) -> Column:
    return F.struct(
        F.lit(rule["rule_name"]).alias("rule_name"),
        F.lit(rule.get("job_type")).cast("string").alias("job_type"),
        F.lit(rule.get("priority") if rule.get("priority") is not None else 0).cast("int").alias("priority"),
        F.lit(trigger_name(rule.get("job_type"), prefix)).alias("_name"),
        F.lit(rule.get("job_name_path")).cast("string").alias("job_name_path"),
    )


RULE_FIELDS = "rule_name string, job_type string, priority int, _name string, job_name_path string"


def _array_of(items: list[tuple[dict, Column]], prefix) -> Column:
    """The rules whose condition holds, as an array."""
    if not items:
        return F.lit(None).cast(f"array<struct<{RULE_FIELDS.replace(' ', ':')}>>".replace(",:", ","))
    arrays = []
    for i in range(0, len(items), RULES_PER_ARRAY):
        chunk = items[i : i + RULES_PER_ARRAY]
        arrays.append(F.array(*[F.when(cond, _rule_struct(rule, prefix)) for rule, cond in chunk]))
    return F.filter(F.concat(*arrays) if len(arrays) > 1 else arrays[0], lambda x: x.isNotNull())


def _plain_hits(docs: DataFrame, compiled: CompiledRules, keep: list[str], prefix) -> DataFrame | None:
    """(keep, rule) of all rules that are not query_all, in one scan."""
    items = [(r, c) for r, c in compiled.good if not r.get("query_all")]
    if not items and not compiled.filed:
        return None
    if not compiled.filed:
        return docs.select(*keep, F.explode(_array_of(items, prefix)).alias("_r")).select(*keep, "_r.*")
    rows = []
    for number, f in enumerate(compiled.filed):
        for rule, value, literals in f.rules:
            name = trigger_name(rule.get("job_type"), prefix)
            rows.append((number, f.column, value, literals, rule["rule_name"], rule.get("job_type"), rule.get("priority") or 0, name, rule.get("job_name_path")))
    index = docs.sparkSession.createDataFrame(rows, f"_shape int, _t string, _v string, _p array<string>, {RULE_FIELDS}")
    columns = sorted({f.column for f in compiled.filed})
    # a row by each of its values, and once for the rules that are not filed
    terms = F.array(*[F.struct(F.lit(c).alias("t"), F.col(c).alias("v")) for c in columns], *([F.struct(F.lit("").alias("t"), F.lit("").alias("v"))] if items else []))
    wide = docs.withColumn("_hits", _array_of(items, prefix)).withColumn("_term", F.explode(terms))
    met = wide.join(F.broadcast(index), (F.col("_term.t") == F.col("_t")) & (F.col("_term.v") == F.col("_v")), "left")
    holds = F.lit(False)
    for number, f in enumerate(compiled.filed):
        holds = F.when(F.col("_shape") == number, F.coalesce(f.condition, F.lit(False))).otherwise(holds)
    own = F.struct(*[F.col(x.split()[0]) for x in RULE_FIELDS.split(", ")])
    hits = F.when(F.col("_term.t") == "", F.col("_hits")).when(holds, F.array(own))
    return met.select(*keep, F.explode(hits).alias("_r")).select(*keep, "_r.*")


def _query_all_hits(docs: DataFrame, catalog: DataFrame, items, id_col, version_col, keep, prefix, carry=()) -> DataFrame | None:
    """(keep, rule, hit_id) of the rules that any document of the catalog sets off.

    The hit is the smallest matching id; of ``carry`` (columns of the catalog)
    the hit's values take the place of the document's.
    """
    if not items:
        return None
    place = F.struct(F.col(id_col).cast("string").alias("hit_id"), *[F.col(c) for c in carry])
    aggs = [F.min_by(F.when(cond, place), F.when(cond, F.col(id_col).cast("string"))).alias(f"_qa{i}") for i, (_, cond) in enumerate(items)]

    def pairs(source):
        all_ = F.array(*[F.struct(_rule_struct(rule, prefix).alias("r"), source(i).alias("hit")) for i, (rule, _) in enumerate(items)])
        return F.filter(all_, lambda x: x["hit"].isNotNull())

    rest = [k for k in keep if k not in carry]
    if version_col:
        # one row per (version, firing rule): tiny next to the documents
        found = catalog.groupBy(version_col).agg(*aggs).select(version_col, F.explode(pairs(lambda i: F.col(f"_qa{i}"))).alias("_p"))
        out = docs.select(*rest).join(found, version_col)
    else:
        one = catalog.agg(*aggs).select(pairs(lambda i: F.col(f"_qa{i}")).alias("_ps")).scalar()
        out = docs.select(*rest, F.explode(one).alias("_p"))
    return out.select(*rest, "_p.r.*", "_p.hit.*")


def match_dataset_rules(datasets: DataFrame, rules, catalog: DataFrame | None = None, id_col: str = "id",
                        version_col: str = "system_version", name_prefix: str | None = None,
                        compiled: CompiledRules | None = None) -> DataFrame:
    """One row per (new dataset, matching rule).

    Columns: id, version, rule_name, job_type, priority, job_name, hit_id.  The
    hit of an ordinary rule is the dataset itself; the hit of a
    ``query_all`` rule is the smallest matching catalog id of that version.
    ``catalog`` defaults to ``datasets``.
    """
    compiled = compiled or compile_rules(datasets, rules)
    keep = [id_col] + ([version_col] if version_col else [])
    qa = [(r, c) for r, c in compiled.good if r.get("query_all")]
    parts = []
    p = _plain_hits(datasets, compiled, keep, name_prefix)
    if p is not None:
        parts.append(p.withColumn("hit_id", F.col(id_col)))
    a = _query_all_hits(datasets, catalog if catalog is not None else datasets, qa, id_col, version_col, keep, name_prefix)
    if a is not None:
        parts.append(a)
    if not parts:
        return datasets.sparkSession.createDataFrame(
            [], f"{id_col} string, {version_col} string, rule_name string, job_type string, priority int, job_name string, hit_id string"
        )
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select(
        *keep, "rule_name", "job_type", "priority",
        F.concat(F.col("_name"), F.lit("-"), F.col(id_col).cast("string")).alias("job_name"),
        F.col("hit_id").cast("string").alias("hit_id"),
    )


def resolve_doc_path(df: DataFrame, path: str | None, id_col: str) -> Column | None:
    """A hit path (``_source.a.b``, ``_id``, ``a.0.b``) as a column of ``df``;
    None when the path does not exist in the schema."""
    from pyspark.sql import types as T

    if not path:
        return None
    steps = [s for s in path.replace("xpath.", "").split(".") if s != ""]
    if steps and steps[0] == "_id":
        return F.col(id_col).cast("string")
    if steps and steps[0] == "_source":
        steps = steps[1:]
    if not steps:
        return None
    dt: T.DataType = df.schema
    col = None
    for s in steps:
        if isinstance(dt, T.StructType) and s in dt.fieldNames():
            col = F.col(s) if col is None else col.getField(s)
            dt = dt[s].dataType
        elif isinstance(dt, T.ArrayType) and s.isdigit():
            col = F.get(col, int(s))
            dt = dt.elementType
        elif isinstance(dt, T.MapType):
            col = F.element_at(col, F.lit(s))
            dt = dt.valueType
        else:
            return None
    return col.cast("string")


def match_job_rules(jobs: DataFrame, rules, id_col: str = "payload_id", name_prefix: str | None = None,
                    compiled: CompiledRules | None = None) -> DataFrame:
    """One row per (finished job, matching rule).

    As J1 without the version term; the trigger's job name takes the value at
    the rule's ``job_name_path`` in the hit when there is one, else the job id.
    """
    compiled = compiled or compile_rules(jobs, rules)
    qa = [(r, c) for r, c in compiled.good if r.get("query_all")]
    every = [r for r, _ in compiled.good] + [r for f in compiled.filed for r, _, _ in f.rules]
    paths = sorted({r.get("job_name_path") for r in every if r.get("job_name_path")})
    path_cols = {p: resolve_doc_path(jobs, p, id_col) for p in paths}
    keep = [id_col]
    docs = jobs
    for i, p in enumerate(paths):
        if path_cols[p] is not None:
            docs = docs.withColumn(f"_path{i}", path_cols[p])
            keep.append(f"_path{i}")
    parts = []
    x = _plain_hits(docs, compiled, keep, name_prefix)
    if x is not None:
        parts.append(x.withColumn("hit_id", F.col(id_col).cast("string")))
    # the hit of a query_all rule is the smallest matching job id, and the name path is read from that hit
    hits = _query_all_hits(docs, docs, qa, id_col, None, keep, name_prefix, carry=keep[1:])
    if hits is not None:
        parts.append(hits)
    if not parts:
        return jobs.sparkSession.createDataFrame(
            [], f"{id_col} string, rule_name string, job_type string, priority int, job_name string, hit_id string"
        )
    out = parts[0]
    for y in parts[1:]:
        out = out.unionByName(y)
    name_val = F.lit(None).cast("string")
    for i, p in enumerate(paths):
        if path_cols[p] is not None:
            name_val = F.when(F.col("job_name_path") == p, F.col(f"_path{i}")).otherwise(name_val)
    suffix = F.when(F.coalesce(name_val, F.lit("")) != "", name_val).otherwise(F.col(id_col).cast("string"))
    return out.select(
        F.col(id_col).cast("string").alias(id_col), "rule_name", "job_type", "priority",
        F.concat(F.col("_name"), F.lit("-"), suffix).alias("job_name"),
        F.col("hit_id").cast("string").alias("hit_id"),
    )


def rule_summary(docs: DataFrame, matches: DataFrame, compiled: CompiledRules, id_col: str = "id") -> DataFrame:
    """A4: per document: enabled rules evaluated (errored ones included),
    matched rule names, errored rule names.

    The documents and their matches meet in one aggregation by document;
    ``matched`` is bounded by the number of rules, never by data volume.
    """
    errored = sorted(name for name, _ in compiled.bad)
    err_col = F.array(*[F.lit(n) for n in errored]) if errored else F.array().cast("array<string>")
    rows = docs.select(id_col, F.lit(None).cast("string").alias("rule_name")).unionByName(matches.select(id_col, "rule_name"))
    return rows.groupBy(id_col).agg(F.sort_array(F.collect_list("rule_name")).alias("matched")).select(
        id_col, F.lit(compiled.size).cast("bigint").alias("candidates"), "matched", err_col.alias("errored"),
    )


def rules_frame(spark: SparkSession, rules: Sequence[dict]) -> DataFrame:
    from jobscope.sources.schemas import RULE

    rows = [tuple(r.get(f.name) for f in RULE.fields) for r in rules]
    return spark.createDataFrame(rows, RULE)
