"""jobscope: operations analytics for data-production pipelines on Spark.

Event logs of jobs, tasks and workers become current-state tables and
timelines; standing rules are matched against new jobs and datasets in one
scan; watchdogs (timeouts, orphans, divergence, drain) are joins and window
queries over those tables; dataset recognition, catalog and lineage assembly
and metric-log parsing are DataFrame transformations.  Every time-relative
operator takes an explicit ``as_of`` instead of reading the clock.

Subpackages
-----------
sources    readers, sinks, canonical schemas, driver-table adapters
functions  column functions and predicates (pure ``Column -> Column``)
operators  DataFrame -> DataFrame operators (state, rules, supervision, ...)
plans      registered queries, their oracle SQL, and physical-plan helpers
streaming  Structured Streaming variants of the stateful operators
"""

from jobscope.session import get_spark, checkpoint_dir  # noqa: F401

TERMINAL_JOB_STATUSES = (
    "job-completed",
    "job-failed",
    "job-deduped",
    "job-offline",
    "job-revoked",
)
