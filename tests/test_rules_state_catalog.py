"""Rules (J1/J2/A4), current state (A1/A2 order independence), dedup (J7),
recognition (J15), checksums (J13), publish decisions (J20), objects (J14)."""

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from jobscope.operators import catalog as K
from jobscope.operators import dedup, rules as R, state
from jobscope.sources.listing import list_tree

DOCS = "id string, system_version string, n_chars bigint, label string"


def docs(spark):
    return spark.createDataFrame([("d1", "v1", 10, "a"), ("d2", "v1", 500, "b"), ("d3", "v2", 900, "c")], DOCS)


def test_rules_hit_miss_query_all_and_bad_rules(spark):
    rules = [
        dict(rule_name="big", query_string="n_chars > 100", enabled=True, job_type="io-big", priority=1, query_all=False),
        dict(rule_name="any_a", query_string="label = 'a'", enabled=True, job_type="io-x", priority=0, query_all=True),
        dict(rule_name="broken", query_string="n_chars >>> 3", enabled=True, job_type="x", priority=0, query_all=False),
        dict(rule_name="unknown", query_string="nope = 1", enabled=True, job_type="x", priority=0, query_all=False),
        dict(rule_name="subquery", query_string="id IN (SELECT 1)", enabled=True, job_type="x", priority=0, query_all=False),
        dict(rule_name="off", query_string="n_chars > 0", enabled=False, job_type="x", priority=0, query_all=False),
    ]
    d = docs(spark)
    compiled = R.compile_rules(d, R.rules_frame(spark, rules))
    assert sorted(n for n, _ in compiled.bad) == ["broken", "subquery", "unknown"]
    got = sorted((r.id, r.rule_name, r.job_name, r.hit_id) for r in
                 R.match_dataset_rules(d, None, name_prefix="io-", compiled=compiled).collect())
    # query_all fires for every doc of the version where a doc matches (v1 only)
    assert got == [("d1", "any_a", "x-d1", "d1"), ("d2", "any_a", "x-d2", "d1"), ("d2", "big", "big-d2", "d2"),
                   ("d3", "big", "big-d3", "d3")]
    summ = {r.id: r for r in R.rule_summary(d, R.match_dataset_rules(d, None, compiled=compiled), compiled).collect()}
    assert summ["d2"].matched == ["any_a", "big"] and summ["d3"].errored == ["broken", "subquery", "unknown"]
    assert summ["d1"].candidates == 5


def test_no_rules_gives_nothing(spark):
    d = docs(spark)
    assert R.match_dataset_rules(d, R.rules_frame(spark, [])).count() == 0


def test_job_rules_name_path(spark):
    jobs = spark.createDataFrame([("j1", "job-completed", "alpha"), ("j2", "job-failed", None)],
                                 "payload_id string, status string, job struct<name string>".replace(
                                     "job struct<name string>", "name string"))
    jobs = jobs.select("payload_id", "status", F.struct(F.col("name")).alias("job"))
    rules = [dict(rule_name="r", query_string="status LIKE 'job-%'", enabled=True, job_type="io-retry", priority=0,
                  query_all=False, job_name_path="_source.job.name")]
    got = sorted((r.payload_id, r.job_name) for r in R.match_job_rules(jobs, R.rules_frame(spark, rules), name_prefix="io-").collect())
    assert got == [("j1", "retry-alpha"), ("j2", "retry-j2")]


def test_current_state_order_independent(spark):
    rnd = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        rows.append((f"k{rnd.randint(0, 20)}", rnd.choice(["job-queued", "job-started", "job-completed", "job-failed"]),
                     t0 + timedelta(seconds=rnd.randint(0, 50)), i, rnd.random() < 0.2))
    schema = "payload_id string, status string, ts timestamp, seq bigint, supervisory boolean"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame(list(reversed(rows)), schema).repartition(7)
    for fn in (state.current_state, state.current_state_guarded):
        x = sorted(tuple(r) for r in fn(a).collect())
        y = sorted(tuple(r) for r in fn(b).collect())
        assert x == y
    # guarded: a terminal authoritative write is never replaced
    term = {"job-completed", "job-failed"}
    g = {r.payload_id: r for r in state.current_state_guarded(a).collect()}
    for k, r in g.items():
        ks = [x for x in rows if x[0] == k]
        if any(x[1] in term and not x[4] for x in ks):
            assert r.status in term and not r.supervisory


def test_find_duplicates_excludes_self(spark):
    t = datetime(2024, 1, 1)
    jobs = spark.createDataFrame([("a", "h", "job-queued", t), ("b", "h", "job-started", t + timedelta(1)),
                                  ("c", "h", "job-failed", t - timedelta(1)), ("d", "z", "job-queued", t)],
                                 "payload_id string, payload_hash string, status string, time_queued timestamp")
    got = {r.payload_id: r.dedup_job for r in dedup.find_duplicates(jobs).collect()}
    assert got == {"a": "b", "b": "a", "c": "a", "d": None}


def test_recognize_first_match_alt_and_children(spark):
    cfg = [dict(position=0, match_pattern=r"/(?P<id>S1_\d+)$", alt_match_pattern=r"(?P<date>\d{8})\.h5$",
                ipath="p/s1", version="v1", level="L1", type="s1"),
           dict(position=1, match_pattern=r"/(?P<id>[A-Z0-9_]+)$", alt_match_pattern=None, ipath="p/any",
                version="v2", level="L0", type="any")]
    paths = spark.createDataFrame([("/d/S1_12", ["x_20240101.h5"]), ("/d/S1_13", ["y.txt"]), ("/d/lower", [])],
                                  "path string, kids array<string>")
    got = {r.path: r for r in K.recognize(paths, cfg, children="kids").collect()}
    assert got["/d/S1_12"].position == 0 and got["/d/S1_12"].date == "20240101" and got["/d/S1_12"].type == "s1"
    assert got["/d/S1_13"].position == 1 and got["/d/S1_13"].id == "S1_13" and got["/d/S1_13"].level == "L0"
    assert got["/d/lower"].position is None


def test_verify_checksums(spark, tmp_path):
    text = b"testing testing 123"
    large = bytes(range(256)) * 80_000  # more than two chunks
    md5, sha3 = hashlib.md5(text).hexdigest(), hashlib.sha3_256(text).hexdigest()
    there = {
        "f1": text, "f1.md5": md5.upper().encode(), "f2": text, "f2.sha3_256": (sha3 + "  f2\n").encode(),
        "sub/f3": b"other", "sub/f3.sha256": hashlib.sha256(text).hexdigest().encode(), "f4.md5": md5.encode(),
        "big": large, "big.sha512": hashlib.sha512(large).hexdigest().encode(), "big.shake_128": hashlib.shake_128(large).hexdigest(32).encode(),
        "empty": b"", "empty.sha1": hashlib.sha1(b"").hexdigest().encode(), "blank": text, "blank.md5": b"",
    }
    for name, data in there.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = list_tree(spark, str(tmp_path))
    assert {r.name: r.length for r in files.collect()} == {n.split("/")[-1]: len(d) for n, d in there.items()}
    got = {(r.path.split("/")[-1], r.algo): r.ok for r in K.verify_checksums(files).collect()}
    assert got == {("f1", "md5"): True, ("f2", "sha3_256"): True, ("f3", "sha256"): False, ("big", "sha512"): True, ("big", "shake_128"): True,
                   ("empty", "sha1"): True, ("blank", "md5"): False}
    plan = K.verify_checksums(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("MapInArrow") < plan.index("Exchange")  # both reads stand above every shuffle


def test_a_wide_and_deep_tree_is_listed(spark, tmp_path):
    want = set()
    for i in range(30):
        d = tmp_path / f"d{i % 5}" / f"e{i}" / "x y"
        d.mkdir(parents=True)
        (d / f".f{i}").write_text("")
        want.add(f".f{i}")
    (tmp_path / "none").mkdir()
    assert {r.name for r in list_tree(spark, f"file:{tmp_path}/").collect()} == want
    assert list_tree(spark, str(tmp_path / "none")).count() == 0


def test_objects_under_prefix_equi_join(spark):
    objs = spark.createDataFrame([("s3://b/x/1/a",), ("s3://b/x/12/a",), ("s3://b/y/1/a",)], "key string")
    pre = spark.createDataFrame([("s3://b/x/1",)], "prefix string")
    assert [r.key for r in K.objects_under(objs, pre).collect()] == ["s3://b/x/1/a"]


def test_publish_decision_table(spark):
    cands = spark.createDataFrame([
        ("free", "u_free", "p1", "t1", False), ("nopayload", "u_np", "p1", "t1", True),
        ("same_wait", "u_sw", "p1", "t1", True), ("same_cat", "u_sc", "p1", "t1", True),
        ("same_retry", "u_sr", "p1", "t1", True), ("other_failed", "u_of", "p1", "t1", True),
        ("other_started", "u_os", "p1", "t1", True), ("other_cat", "u_oc", "p1", "t1", True),
        ("other_free", "u_ofr", "p1", "t1", True), ("objs_cat", "u_obc", "p1", "t1", True),
        ("objs_free", "u_obf", "p1", "t1", True),
    ], "id string, url string, payload_id string, task_id string, objects_present boolean")
    ctx = spark.createDataFrame([
        ("u_np", None, "t9"), ("u_sw", "p1", "t2"), ("u_sc", "p1", "t1"), ("u_sr", "p1", "t1"),
        ("u_of", "p7", "t7"), ("u_os", "p8", "t8"), ("u_oc", "p9", "t9"), ("u_ofr", "p9", "t9"),
    ], "url string, ctx_payload_id string, ctx_task_id string")
    jobs = spark.createDataFrame([("p7", "job-failed"), ("p8", "job-started"), ("p9", "job-completed")],
                                 "payload_id string, status string")
    cat = spark.createDataFrame([("same_cat",), ("other_cat",), ("objs_cat",), ("other_failed",)], "id string")
    tasks = spark.createDataFrame([("t2", False)], "task_id string, finished boolean")
    got = {r.id: (r.decision, r.reason) for r in K.publish_decision(cands, ctx, jobs, cat, tasks).collect()}
    assert got["free"] == ("publish", None)
    assert got["nopayload"][0] == "reject"
    assert got["same_wait"] == ("reject", "other_task_unfinished")
    assert got["same_cat"] == ("reject", "in_catalog")
    assert got["same_retry"] == ("force", "retry_previous_failed")
    assert got["other_failed"] == ("force", "job_failed")  # catalog not consulted
    assert got["other_started"] == ("reject", "other_job_running")
    assert got["other_cat"] == ("reject", "in_catalog")
    assert got["other_free"] == ("force", "no_es_doc")
    assert got["objs_cat"] == ("reject", "in_catalog")
    assert got["objs_free"] == ("force", "no_es_doc")
