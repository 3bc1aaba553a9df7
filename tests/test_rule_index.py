"""Many rules: filed by a term they demand, with the same matches as one by one."""

import random
import time
import uuid

import pytest

from jobscope.functions.predicates import RuleError, compile_rule
from jobscope.operators import rules as R
from jobscope.session import checkpoint_dir
from jobscope.streaming import ops as T

SCHEMA = "id string, dataset string, level string, n int, text string, index string"


def docs_rows(n=300, seed=1):
    rng = random.Random(seed)
    return [(f"d{i}", rng.choice(["src1", "src2", "it's", None, "SRC1"]), rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 100)]),
             rng.choice(["alpha beta", "100%", None, "x_y"]), f"cat_{i % 3}") for i in range(n)]


def rule(i, text, **more):
    return dict(rule_name=f"r{i:05d}", query_string=text, enabled=True, job_type="io-x", priority=i % 5, query_all=False, job_name_path=None, **more)


def all_rules():
    rules = [rule(i, f"dataset = '{d}' AND n > {n}") for i, (d, n) in enumerate((d, n) for d in ("src1", "src2", "none") for n in range(0, 100, 7))]
    rules += [rule(1000 + i, f"level='{v}' and text LIKE '%{w}%' and n <= {n}") for i, (v, w, n) in enumerate((v, w, n) for v in "ab" for w in ("alpha", "0%", "_") for n in (10, 60))]
    rules += [rule(2000, "dataset = 'src1' OR n > 90"), rule(2001, "NOT dataset = 'src1'"), rule(2002, "n BETWEEN 3 AND 9"), rule(2003, "dataset = 'it''s'"),
              rule(2004, "dataset = 'src1' AND (n > 3 OR level = 'a')"), rule(2005, "n ="), rule(2006, "dataset = 'src2' AND nothing = 'x'"), rule(2007, "'src1' = dataset AND n > 5"),
              rule(2008, "dataset = 'src1' AND level IN ('a', 'b')"), rule(2009, "dataset = 'src1' AND cast(n as string) = '7'"), rule(2010, "n = 7 AND dataset = 'src2'"),
              rule(2011, "dataset = 'src1'", index_pattern="cat_1"), rule(2012, 'dataset = "src1" AND n > 1'), rule(2013, "dataset = 'src1' AND n > 1.5"),
              rule(2014, "dataset = 'src1' AND n > -1"), rule(2015, "lower(dataset) = 'src1'"), {**rule(2016, "dataset = 'src2' AND n > 95"), "query_all": True}]
    return rules


def matches(docs, compiled):
    return sorted(map(tuple, R.match_dataset_rules(docs, None, version_col="level", name_prefix="io-", compiled=compiled).collect()), key=repr)


def test_filed_rules_match_as_the_others_do(spark):
    docs = spark.createDataFrame(docs_rows(), SCHEMA)
    one, many = R.compile_rules(docs, all_rules(), file_from=10**6), R.compile_rules(docs, all_rules(), file_from=0)
    assert not one.filed and sum(len(f.rules) for f in many.filed) > 50
    assert one.size == many.size and sorted(one.names()) == sorted(many.names()) and one.bad == many.bad
    assert {n for n, _ in one.bad} == {"r02005", "r02006"}
    got = matches(docs, many)
    assert got == matches(docs, one) and len({r[2] for r in got}) > 30
    summary = {r.id: r for r in R.rule_summary(docs, R.match_dataset_rules(docs, None, version_col="level", compiled=many), many).collect()}
    assert len(summary) == 300 and {r.candidates for r in summary.values()} == {len(all_rules())}
    assert {(i, n) for i, r in summary.items() for n in r.matched} == {(r[0], r[2]) for r in got}


def test_ten_thousand_rules_in_one_scan(spark):
    rules = [rule(i, f"dataset = 'src{i % 500}' AND n > {i % 97} AND level = 'a'") for i in range(10_000)]
    docs = spark.createDataFrame([(f"d{i}", f"src{i % 600}", "a", i % 100, "", "cat") for i in range(2000)], SCHEMA)
    began = time.time()
    out = R.match_dataset_rules(docs, rules, version_col=None)
    got = out.groupBy("id").count().collect()
    assert time.time() - began < 60
    want = {f"d{i}": sum(1 for k in range(i % 600, 10_000, 500) if i % 100 > k % 97) for i in range(2000) if i % 600 < 500}
    assert {r.id: r["count"] for r in got} == {k: v for k, v in want.items() if v}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_query_all_rule_without_versions_needs_no_join_of_the_jobs(spark):
    jobs = spark.createDataFrame([("b", "x", "q1"), ("a", "x", "q2"), ("c", "y", "q3")], "payload_id string, kind string, queue string")
    rules = [dict(rule_name="any", query_string="kind = 'x'", enabled=True, job_type="t", priority=0, query_all=True, job_name_path="_source.queue"),
             dict(rule_name="never", query_string="kind = 'z'", enabled=True, job_type="t", priority=0, query_all=True, job_name_path=None)]
    out = R.match_job_rules(jobs, rules)
    assert sorted((r.payload_id, r.rule_name, r.job_name, r.hit_id) for r in out.collect()) == [(j, "any", "t-q2", "a") for j in "abc"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("text", ["n < current_timestamp", "id <> current_user", "id = session_user", "ts < current_date", "ts < current_date()", "ts > now()"])
def test_a_rule_does_not_read_the_clock_or_the_user(spark, text):
    docs = spark.createDataFrame([("a", 1)], "id string, n int").selectExpr("*", "timestamp'2024-01-01' as ts")
    with pytest.raises(RuleError):
        compile_rule(docs, "r", text)


def test_streamed_rules_are_read_for_each_batch(spark, tmp_path):
    schema = "payload_id string, status string, kind string"
    src, name = str(tmp_path / "src"), uuid.uuid4().hex
    for k in range(2):
        spark.createDataFrame([(f"p{k}{i}", "job-completed" if i else "job-failed", "x") for i in range(3)], schema).coalesce(1).write.mode("append").parquet(src)
    reads = []

    def rules(_):
        reads.append(1)
        done = dict(rule_name="done", query_string="status = 'job-completed'", job_type="t", priority=1, query_all=False, enabled=True)
        return [done] if len(reads) == 1 else [done, {**done, "rule_name": "failed", "query_string": "status = 'job-failed'"}]

    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    T.stream_rules(ev, rules, T.batch_files(spark, name), f"{checkpoint_dir(spark)}/ck-{name}").awaitTermination()
    out = T.batch_rows(spark, name).collect()
    assert {r.batch for r in out} == {0, 1} and len(reads) == 2
    assert sorted(r.rule_name for r in out) == ["done"] * 4 + ["failed"]
    assert [r.payload_id[1] for r in out if r.rule_name == "failed"] == [next(r.payload_id[1] for r in out if r.batch == 1)]
