"""The adapted data reaches every branch of the decision tables, so that a green oracle row says something."""

import pytest

from jobscope.plans.registry import QUERIES, load_all

SF = "/root/testdata/sf0.01"
BRANCHES = {
    "j4_reconcile_orphans": ("action", {"keep", "report", "declined", "update"}),
    "w4_idle_hosts": ("idle", {True, False}),
    "w6_lease_staleness": ("state", {"stale", "observe"}),
    "r1_overdue_job_types": ("reason", {"no_success", "overdue"}),
    "r4_purge": ("removed", {True, False}),
    "j2_match_job_rules": ("rule_name", {"urgent_done", "big_limit", "any_low"}),
    "j1_match_dataset_rules": ("rule_name", {"en_long", "src_pick", "license", "huge_any", "in_index", "bad_index"}),
}


@pytest.mark.parametrize("name", list(BRANCHES))
def test_every_branch_has_rows(spark, name):
    load_all()
    column, want = BRANCHES[name]
    assert {r[0] for r in QUERIES[name](spark, SF).select(column).distinct().collect()} >= want
