"""Rule conditions (F1), index patterns (J1) and trigger parameters (P25)."""

import json

import pytest

from jobscope.functions.predicates import RuleError, compile_rule
from jobscope.operators import rules as R
from jobscope.operators.dedup import mark_deduped
from jobscope.operators.state import job_timeline, timeline_and_state
from jobscope.operators.triggers import trigger_params, triggers
from jobscope.sources import readers as RD

BAD = [
    "id <> \"'\" AND reflect('java.lang.System', 'getProperty', 'user.home') <> \"'\"",
    "`try_reflect`('java.lang.System', 'getProperty', 'user.home') = 'x'",
    "id IN (SELECT id FROM t)",
    "java_method('java.lang.Math', 'abs', -1) = 1",
    "id = 'a'; DROP TABLE x",
    "",
]
GOOD = ["CASE WHEN id = 'a' THEN (true) ELSE (n > 1) END", "id LIKE 'a%' OR n BETWEEN 1 AND 3", "lower(id) RLIKE 'x' AND NOT (n IS NULL)",
        "exists(tags, t -> t = 'q')", "n + 1 > 2 AND id IN ('a', 'b')"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("a", 1, ["q"], "cat_x1"), ("b", 5, [], "cat_y")], "id string, n int, tags array<string>, index string")


@pytest.mark.parametrize("text", BAD)
def test_what_a_rule_may_not_say(docs, text):
    with pytest.raises(RuleError):
        compile_rule(docs, "r", text)


@pytest.mark.parametrize("text", GOOD)
def test_what_a_rule_may_say(docs, text):
    assert docs.filter(compile_rule(docs, "r", text)).count() >= 0


def test_a_rule_matches_only_inside_its_index_pattern(docs):
    rules = [dict(rule_name=n, query_string="n > 0", job_type="t", index_pattern=p) for n, p in
             (("in", "cat_x*"), ("two", "cat_y,cat_x1"), ("none", "other"), ("comma", "cat_x1,"), ("star", "**"), ("empty", " "))]
    got = {(r.rule_name, r.id) for r in R.match_dataset_rules(docs, rules, version_col=None).collect()}
    everywhere = {(n, i) for n in ("two", "comma", "star", "empty") for i in "ab"}
    assert got == everywhere | {("in", "a")}


def test_trigger_parameters(spark):
    hits = spark.createDataFrame(
        [("o1", "r", "u", '{"email_addresses":"e","x":{"y":1}}', [], "i", "d", "q", '{"job_id":"action-retry_job-j","a":[1,null]}', "j1"),
         ("o2", "r", "u", None, ["http://a", "s3://b"], "i", "d", "q", '{"job_id":"j"}', "j2")],
        "objectid string, rule_name string, username string, kwargs string, urls array<string>, index string, doctype string, query string, job string, job_id string")
    mail = [json.loads(r.params) for r in trigger_params(hits, "notify_by_email").collect()]
    assert mail == [{"id": "o1", "rule_name": "r", "username": "u", "emails": "e", "url": None}, {"id": "o2", "rule_name": "r", "username": "u", "emails": None, "url": "http://a"}]
    assert [json.loads(r.params)["prod_url"] for r in trigger_params(hits, "import_prov_es").collect()] == [None, "s3://b"]
    retry = trigger_params(hits, "retry_job").collect()
    assert [r.name for r in retry] == ["action-retry_job-j", "action-retry_job-j"]
    assert json.loads(retry[0].params)["job"] == {"job_id": "action-retry_job-j", "a": [1, None]}
    script = json.loads(trigger_params(hits, "custom_script").first().params)
    assert script["x"] == {"y": 1} and script["query"] == "q"
    with pytest.raises(ValueError):
        trigger_params(hits, "unknown")


def test_triggers_of_several_actions_are_those_of_each(spark):
    hits = spark.createDataFrame(
        [("o1", "r", "u", '{"email_addresses":"e","query":"own"}', [], "i", "q", "r1"), ("o1", "s", None, None, ["http://a"], None, "q", "r2"), ("o2", "r", "u", "{", ["http://a", "s3://b"], "i", None, "r3")],
        "objectid string, rule_name string, username string, kwargs string, urls array<string>, index string, query string, rule string")
    actions = ["notify_by_email", "custom_script", "purge_datasets"]
    got = triggers(hits, actions, "objectid", "rule")
    names = ["objectid", "rule", "type", "name", "tag", "username", "params", "localize_urls"]
    assert got.columns == ["action", *names]
    want = [(a, *r) for a in actions for r in trigger_params(hits, a).select(names).collect()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_dataset_triggers_join_their_hits_once(spark):
    from jobscope.plans.q_rules import p25_dataset_triggers

    plan = p25_dataset_triggers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2  # hits to documents, and versions to theirs; one of each for all actions


def test_only_an_earlier_job_makes_a_duplicate(spark):
    jobs = spark.createDataFrame([("a", "h", "job-queued", 1), ("b", "h", "job-queued", 1), ("c", "g", "job-queued", 1), ("d", None, "job-queued", 1), ("e", None, "job-queued", 2)],
                                 "payload_id string, payload_hash string, status string, time_queued int")
    assert [(r.payload_id, r.dedup_job) for r in mark_deduped(jobs).collect()] == [("b", "a")]


def test_a_supervisory_write_does_not_replace_the_final_status(spark):
    log = spark.createDataFrame([("p", "job-completed", "2024-01-01 00:00:00", 1, False), ("p", "job-offline", "2024-01-01 01:00:00", 2, True)],
                                "payload_id string, status string, ts string, seq long, supervisory boolean").selectExpr("* except (ts)", "cast(ts as timestamp) ts")
    assert job_timeline(log).first().final_status == "job-completed"
    assert timeline_and_state(log).first().final_status == "job-completed"


def test_a_broken_line_goes_to_quarantine(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"payload_id":"p1","status":"job-queued"}\n{"payload_id":"p2","status": \n[1]\n')
    rows, bad = RD.read_job_events(spark, str(tmp_path), with_quarantine=True)
    assert [r.payload_id for r in rows.collect()] == ["p1"]
    assert bad.count() == 2
