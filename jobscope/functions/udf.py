"""User-function surface (U1-U3) and the two Arrow-batched helpers.

Python runs only where the semantics need it: a user's own job creator or
metadata extractor, the byte-compatible payload hash (Python's own JSON
dump) and digests Spark lacks.  All of them are vectorised (``pandas_udf``
/ ``mapInPandas``): one Python call per Arrow batch, never per row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.functions.columns import VOLATILE_PAYLOAD_KEYS


@F.pandas_udf(T.StringType())
def payload_hash_udf(payload_json: pd.Series) -> pd.Series:
    """P8 byte-compatible form: drop volatile keys, sorted-key JSON dump with
    ASCII escapes, MD5 hex digest.  Unparseable payloads hash to null."""

    def one(text):
        if text is None:
            return None
        try:
            obj = json.loads(text)
        except (TypeError, ValueError):
            return None
        if isinstance(obj, dict):
            for k in VOLATILE_PAYLOAD_KEYS:
                obj.pop(k, None)
        return hashlib.md5(json.dumps(obj, sort_keys=True, ensure_ascii=True).encode()).hexdigest()

    return payload_json.map(one)


@F.pandas_udf(T.StringType())
def digest_udf(algo: pd.Series, content: pd.Series) -> pd.Series:
    """Hex digest by algorithm name for the algorithms Spark has no function
    for (sha3, blake2, shake)."""

    def one(a, b):
        if a is None or b is None:
            return None
        h = hashlib.new(a, bytes(b))
        if a.startswith("shake_"):
            return h.hexdigest(32 if a == "shake_128" else 64)
        return h.hexdigest()

    return pd.Series([one(a, b) for a, b in zip(algo, content)])


# ---------------------------------------------------------------- U1 -----

Step = Callable[[DataFrame], DataFrame]


def register_steps(df: DataFrame, main: Step, pre: Sequence[Step] = (), post: Sequence[Step] = (),
                   builtin_pre: Sequence[Step] = (), builtin_post: Sequence[Step] = (),
                   disable_builtins: bool = False) -> DataFrame:
    """Ordered user steps around the main step.

    A pre-step returns the frame with a boolean ``continue`` column; a row
    goes on to the main step only if every pre-step said so (rows stopped by
    a pre-step are kept, untouched, with ``continue = false``).  Built-in
    steps run before the user's in each phase unless disabled.
    """
    steps_pre = ([] if disable_builtins else list(builtin_pre)) + list(pre)
    steps_post = ([] if disable_builtins else list(builtin_post)) + list(post)
    cur = df.withColumn("continue", F.lit(True))
    for step in steps_pre:
        prev = F.col("continue")
        cur = step(cur.withColumnRenamed("continue", "_prev_continue"))
        if "continue" not in cur.columns:
            cur = cur.withColumn("continue", F.lit(True))
        cur = cur.withColumn("continue", F.col("_prev_continue") & F.coalesce(F.col("continue"), F.lit(False))).drop(
            "_prev_continue")
        del prev
    go = cur.filter(F.col("continue"))
    stop = cur.filter(~F.col("continue"))
    done = main(go)
    for step in steps_post:
        done = step(done)
    return done.unionByName(stop, allowMissingColumns=True)


# ---------------------------------------------------------------- U2 -----

JOB_ROW = T.StructType([
    T.StructField("spec_id", T.StringType()),
    T.StructField("job_name", T.StringType()),
    T.StructField("job_type", T.StringType()),
    T.StructField("job_queue", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])


def job_creator(specs: DataFrame, fn: Callable[..., list], spec_id: str = "spec_id", payload: str = "payload",
                job_type: str | None = "job_type") -> DataFrame:
    """Run a user job-creator function over job specs.

    ``fn(payload_dict[, job_type])`` returns a list of job dicts (job_name,
    job_type, job_queue, payload).  It runs inside ``mapInPandas`` on Arrow
    batches; a failing call yields one ``job-failed`` row with the error.
    """
    cols = [spec_id, payload] + ([job_type] if job_type else [])

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False):
                sid, pl = rec[0], rec[1]
                jt = rec[2] if job_type else None
                try:
                    body = json.loads(pl) if isinstance(pl, str) else pl
                    jobs = fn(body, jt) if job_type else fn(body)
                    for j in jobs or []:
                        rows.append((sid, j.get("job_name"), j.get("job_type", jt), j.get("job_queue"),
                                     json.dumps(j.get("payload"), sort_keys=True), "job-queued", None))
                except Exception as e:  # noqa: BLE001 - a user function's failure becomes a row
                    rows.append((sid, None, jt, None, None, "job-failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=JOB_ROW.fieldNames())

    return specs.select(*cols).mapInPandas(run, JOB_ROW)


# ---------------------------------------------------------------- U3 -----


def metadata_extractor(df: DataFrame, fn: Callable[[str, str | None], dict] | None, path: str = "path",
                       content: str | None = None, existing: str | None = "metadata") -> DataFrame:
    """User metadata extraction per dataset, vectorised.

    ``fn(path, content)`` returns a dict; values become strings.  Existing
    metadata wins over extracted keys; with no extractor configured the
    extracted map is empty.
    """
    empty = F.create_map().cast("map<string,string>")
    if fn is None:
        extracted = empty
    else:
        @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
        def run(p: pd.Series, c: pd.Series) -> pd.Series:
            out = []
            for a, b in zip(p, c):
                d = fn(a, b) or {}
                out.append({str(k): None if v is None else str(v) for k, v in d.items()})
            return pd.Series(out)

        extracted = run(F.col(path), F.col(content) if content else F.lit(None).cast("string"))
    if existing and existing in df.columns:
        merged = F.map_concat(extracted, F.coalesce(F.col(existing), empty))
    else:
        merged = extracted
    return df.withColumn("metadata", merged)


def digest(col: Column, algo: str) -> Column:
    """A digest column by algorithm name (native when Spark has it)."""
    from jobscope.operators.catalog import NATIVE_DIGESTS

    if algo in NATIVE_DIGESTS:
        return NATIVE_DIGESTS[algo](col)
    return digest_udf(F.lit(algo), col)
