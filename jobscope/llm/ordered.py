"""Rows in ascending doc_id order over many tasks.

Ranges of ids are cut at quantiles, so that each holds about as many rows; a
range's rows meet sorted in one task and are streamed, never held.  What a
range needs of the next one travels with the shuffle.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Ranges for each shuffle partition: their hash spreads them evenly enough.
RANGES_EACH = 4
#: Most ranges: the cut points are one array in the driver.
MOST_RANGES = 100_000


def cut_points(docs: DataFrame, each: int = RANGES_EACH) -> np.ndarray:
    """Ascending distinct ids of ``docs`` at which ranges begin, the least id first (empty without ids).

    ``each``: ranges for each shuffle partition.
    """
    n = max(2, min(MOST_RANGES, each * partitions(docs.sparkSession)))
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()
    return np.array(sorted({row[0], *(row[1] or [])}), np.int64) if row[0] is not None else np.zeros(0, np.int64)


def range_of(cuts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(cuts, ids, "right") - 1, 0)


def in_order(rows: DataFrame, *then: str) -> DataFrame:
    """Rows with a ``range`` column, each range whole in one partition and sorted by ``then``."""
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "range").sortWithinPartitions("range", *then)
