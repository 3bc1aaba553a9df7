"""Filters and predicates.

Predicates are ``Column`` expressions, so Catalyst pushes the simple ones
(``==``, ``isin``, ranges, ``startswith``) into the Parquet scan.  Rule text
is Spark SQL: it is parsed, every node and function of the expression tree is
checked against an allow-list, and it is analysed against the target schema on
the driver before it reaches a plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions.columns import failure_class  # noqa: F401  (re-export)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- F1 ------


class RuleError(ValueError):
    """A rule whose condition cannot be used; carries the rule name."""

    def __init__(self, rule_name: str, reason: str):
        super().__init__(f"{rule_name}: {reason}")
        self.rule_name = rule_name
        self.reason = reason


# Functions a rule condition may call.  Anything else (and any subquery) is
# rejected before the text reaches the analyser.
RULE_FUNCTIONS = frozenset(
    """
    coalesce nvl if lower upper length trim ltrim rtrim substr substring concat contains startswith endswith
    regexp rlike like ilike between cast try_cast instr locate split size array_contains element_at
    get_json_object abs round floor ceil greatest least date timestamp to_date to_timestamp date_format
    year month day hour datediff isnull isnotnull exists filter array map struct named_struct
    and or not in when
    """.split()
)
# Kinds of expression a parsed condition may be made of.
RULE_NODES = frozenset(
    """
    Literal UnresolvedAttribute UnresolvedFunction UnresolvedExtractValue UnresolvedNamedLambdaVariable LambdaFunction
    And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In Between
    IsNull IsNotNull Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny Cast CaseWhen If
    Add Subtract Multiply Divide Remainder UnaryMinus UnaryPositive Concat Coalesce
    """.split()
)


def check_rule_expression(spark: SparkSession, rule_name: str, text: str | None, columns: Iterable[str] | None = None) -> str:
    """Reject empty text, and any parsed node or function outside the allow-lists.

    With ``columns``, a name that begins with none of them is rejected too:
    the analyser would take ``current_timestamp`` or ``current_user`` for a
    call, and a rule must not depend on the clock or the user.
    """
    known = {c.lower() for c in columns} if columns is not None else None
    if text is None or not str(text).strip():
        raise RuleError(rule_name, "empty condition")
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except Exception as e:  # ParseException
        raise RuleError(rule_name, f"{type(e).__name__}: {e}") from None
    nodes = [root]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind not in RULE_NODES:
            raise RuleError(rule_name, f"{kind} is not allowed in a condition")
        if kind == "UnresolvedFunction":
            parts = node.nameParts()
            name = parts.mkString(".")
            if name.lower() not in RULE_FUNCTIONS:
                raise RuleError(rule_name, f"function {name} is not allowed")
        if kind == "UnresolvedAttribute" and known is not None:
            parts = node.nameParts()
            if parts.apply(0).lower() not in known:
                raise RuleError(rule_name, f"{parts.mkString('.')} is no column")
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return text


def compile_rule(df: DataFrame, rule_name: str, text: str) -> Column:
    """Parse and analyse a rule condition against ``df``'s schema.

    Analysis only (``limit(0)``): no data is read.  Parse and analysis errors
    become a ``RuleError`` so one bad rule never stops the others.
    """
    check_rule_expression(df.sparkSession, rule_name, text, df.columns)
    try:
        cond = F.expr(text)
        df.limit(0).filter(cond).schema  # noqa: B018  (forces analysis)
    except Exception as e:  # ParseException / AnalysisException
        raise RuleError(rule_name, f"{type(e).__name__}: {e}") from None
    return cond


def rule_predicate(df: DataFrame, rule: dict, doc_id=None, doc_id_value=None,
                   version_col=None, version_value=None) -> Column:
    """a rule's condition plus the triggering id and version.

    ``query_all`` lifts the id restriction.  Without literal id/version values
    the condition is returned as compiled (the caller pairs rows itself).
    """
    cond = compile_rule(df, rule["rule_name"], rule["query_string"])
    if version_col is not None and version_value is not None:
        cond = cond & (_c(version_col) == F.lit(version_value))
    if doc_id is not None and doc_id_value is not None and not rule.get("query_all"):
        cond = cond & (_c(doc_id) == F.lit(doc_id_value))
    return cond


# ---------------------------------------------------------------- F2 ------


def term(col, value) -> Column:
    return _c(col) == F.lit(value)


def terms(col, values: Iterable) -> Column:
    return _c(col).isin(list(values))


def range_(col, gt=None, gte=None, lt=None, lte=None) -> Column:
    c = _c(col)
    conds = []
    if gt is not None:
        conds.append(c > F.lit(gt))
    if gte is not None:
        conds.append(c >= F.lit(gte))
    if lt is not None:
        conds.append(c < F.lit(lt))
    if lte is not None:
        conds.append(c <= F.lit(lte))
    return all_of(*conds) if conds else F.lit(True)


def all_of(*preds: Column) -> Column:
    out = None
    for p in preds:
        out = p if out is None else (out & p)
    return out if out is not None else F.lit(True)


def any_of(*preds: Column) -> Column:
    out = None
    for p in preds:
        out = p if out is None else (out | p)
    return out if out is not None else F.lit(False)


def none_of(*preds: Column) -> Column:
    return ~any_of(*preds) if preds else F.lit(True)


# ---------------------------------------------------------------- F3-F5 ---


def phrase(col, text: str, short_error_col=None, short_error: str | None = None) -> Column:
    """error text contains a phrase (and, optionally, an exact short error)."""
    p = _c(col).contains(text)
    if short_error_col is not None and short_error is not None:
        p = p & (_c(short_error_col) == F.lit(short_error))
    return p


def older_than(ts, seconds: float, as_of) -> Column:
    """``ts < as_of - seconds`` with an explicit ``as_of`` instant."""
    cutoff = F.timestamp_add("MICROSECOND", F.lit(int(-seconds * 1_000_000)), F.lit(as_of).cast("timestamp"))
    return _c(ts) < cutoff


def stale(df: DataFrame, statuses: Sequence[str], seconds: float, as_of, ts: str = "ts",
          status: str = "status") -> DataFrame:
    """rows in one of ``statuses`` whose last update is older than N s."""
    return df.filter(F.col(status).isin(list(statuses)) & older_than(ts, seconds, as_of))


ORCHESTRATOR_HOST_PATTERN = r"^celery@orchestrator"
ORCHESTRATOR_TASK_PATTERN = r"^[a-z_]+\.orchestrator\.submit_job"


def exclude_orchestrator(df: DataFrame, hostname: str = "celery_hostname", status: str = "status",
                         name: str | None = "event.name") -> DataFrame:
    """drop the orchestrator's own task and worker events.

    Task-sent events are dropped also by task name; task-failed events are
    always kept (a failure is supervised whoever reported it).
    """
    h = F.coalesce(F.col(hostname), F.lit(""))
    orch = h.rlike(ORCHESTRATOR_HOST_PATTERN)
    if name is not None:
        n = F.coalesce(F.col(name), F.lit(""))
        orch = orch | ((F.col(status) == "task-sent") & n.rlike(ORCHESTRATOR_TASK_PATTERN))
    return df.filter((F.col(status) == "task-failed") | ~orch)


# ---------------------------------------------------------------- F6-F10 --


def work_queues(df: DataFrame, internal: Sequence[str] = (), name: str = "queue",
                ready: str = "messages_ready") -> DataFrame:
    """queues that carry user work and have messages ready."""
    n = F.col(name)
    cond = ~n.startswith("celery") & (n != "Recommended Queues") & (F.col(ready) > 0)
    if internal:
        cond = cond & ~n.isin(list(internal))
    return df.filter(cond)


def publishable(jobs: DataFrame, exit_status: str = "exit_status", pid: str = "pid") -> DataFrame:
    """jobs whose command ran (pid != 0) and exited 0."""
    return jobs.filter((F.col(exit_status) == 0) & (F.coalesce(F.col(pid), F.lit(-1)) != 0))


def publishable_datasets(datasets: DataFrame, jobs: DataFrame, inputs: DataFrame, job: str = "job_id", directory: str = "dir",
                         exit_status: str = "exit_status", pid: str = "pid") -> DataFrame:
    """the dataset directories that a job may publish: the job is
    ``publishable``, and the directory is not one of ``inputs`` (directories
    marked as localized)."""
    ok = publishable(jobs, exit_status, pid).select(job)
    return datasets.join(ok, job, "left_semi").join(inputs.select(directory).distinct(), directory, "left_anti").select(*datasets.columns)


# Optional dataset fields reported when absent.  Fixed values.
OPTIONAL_DATASET_FIELDS = ("label", "location", "starttime", "endtime")


def verify_datasets(df: DataFrame, required: str = "version",
                    optional: Sequence[str] = OPTIONAL_DATASET_FIELDS) -> tuple[DataFrame, DataFrame]:
    """F8: (valid, invalid) split on the required ``version``; each row lists
    the optional fields it lacks in ``missing_optional``."""
    present = [o for o in optional if o in df.columns]
    missing = F.filter(
        F.array(*[F.when(F.col(o).isNull(), F.lit(o)) for o in present]) if present else F.array().cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    absent = [o for o in optional if o not in df.columns]
    if absent:
        missing = F.concat(missing, F.array(*[F.lit(o) for o in absent]))
    out = df.withColumn("missing_optional", missing)
    ok = F.col(required).isNotNull() if required in df.columns else F.lit(False)
    return out.filter(ok), out.filter(~ok)


def glob_to_regex(glob: str) -> str:
    """Shell glob over one path segment -> anchored regex (no ``/`` crossing)."""
    out = []
    for ch in glob:
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        else:
            out.append(re.escape(ch))
    return "^" + "".join(out) + "$"


def triage_candidates(jobs: DataFrame, exit_status: str = "exit_status",
                      disabled: str = "triage_disabled") -> DataFrame:
    """failed jobs (non-zero exit) that did not opt out of triage."""
    cond = F.col(exit_status) != 0
    if disabled in jobs.columns:
        cond = cond & ~F.coalesce(F.col(disabled), F.lit(False))
    return jobs.filter(cond)


def triage_files(files: DataFrame, job_dir: str = "job_dir", path: str = "path",
                 extra_globs: Sequence[str] = ()) -> DataFrame:
    """the files of a job directory's top level worth keeping: ``_*``,
    ``*.log`` and any extra globs."""
    rel = F.expr(f"substring({path}, length({job_dir}) + 2)")
    top = F.col(path).startswith(F.concat(F.col(job_dir), F.lit("/"))) & ~rel.contains("/")
    pats = [glob_to_regex("_*"), glob_to_regex("*.log")] + [glob_to_regex(g) for g in extra_globs]
    return files.filter(top & any_of(*[rel.rlike(p) for p in pats]))


def source_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """only the requested (possibly nested) fields; nested-schema pruning
    reads just those leaves from Parquet."""
    return df.select(*[F.col(c).alias(c.replace(".", "_")) if "." in c else F.col(c) for c in cols])
