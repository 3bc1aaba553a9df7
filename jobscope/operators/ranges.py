"""Ordered scans of a key's rows that spread a hot key over many tasks.

A window by key puts all rows of a key into one task.  Here the rows are cut
into ranges of (key, order), about as many rows in each, and written, so that
the cuts are the same for every later step.  A step then works in each
(key, range) alone, and what has to pass from one range to the next is a row
per (key, range): totals (``running``), border rows (``neighbour``), or the
state of an automaton (``jobscope.operators.drain``).

The order should be total within a key: rows that are equal in it stand in one
range and in any order there.  A null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobscope.session import stored

RANGE = "_range"


def _columns(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def ranged(df: DataFrame, key: str, order: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``: ascending by key and order, each about as large."""
    n = ranges or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(df.repartitionByRange(n, F.col(key), *_columns(order)).withColumn(RANGE, F.spark_partition_id()), "ranges")


def by_segment(rows: DataFrame, per_segment: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined with ``per_segment`` (key, _range, ...) by null-safe key and range."""
    other = per_segment.withColumnsRenamed({key: "_key", RANGE: "_at"})
    on = F.col(key).eqNullSafe(F.col("_key")) & (F.col(RANGE) == F.col("_at"))
    return rows.join(other, on, "left").drop("_key", "_at")


def running(df: DataFrame, key: str, order: Sequence[str | Column], value: str | Column, name: str,
            ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the key that stand before (0 for the first).

    Two levels: totals of each (key, range) are summed over the key's ranges,
    and added to the sums within a range.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = ranged(df.withColumn("_value", value), key, order, ranges)
    totals = rows.groupBy(key, RANGE).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, RANGE, F.sum("_total").over(before).alias("_offset"))
    within = Window.partitionBy(key, RANGE).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = by_segment(rows.withColumn("_local", F.sum("_value").over(within)), offsets, key)
    total = F.coalesce(F.col("_offset"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0))
    return rows.withColumn(name, total).drop("_value", "_local", "_offset", RANGE)


def neighbour(df: DataFrame, key: str, order: Sequence[str], value: str, name: str, back: bool = True,
              ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: struct of ``value`` of the key's row before (or after), null for the first (last).

    Only a range's border rows look beyond it: they get the last (first) row
    that the key has in an earlier (later) range.
    """
    rows = ranged(df, key, order, ranges)
    place, held = F.struct(*_columns(order)), F.struct(F.col(value).alias("value"))
    border = rows.groupBy(key, RANGE).agg((F.max_by if back else F.min_by)(held, place).alias("_border"))
    over = Window.partitionBy(key).orderBy(RANGE)
    carried = border.select(key, RANGE, (F.lag if back else F.lead)("_border").over(over).alias("_carried"))
    within = Window.partitionBy(key, RANGE).orderBy(*order)
    rows = rows.withColumn("_near", (F.lag if back else F.lead)(held).over(within))
    return by_segment(rows, carried, key).withColumn(name, F.coalesce("_near", "_carried")).drop("_near", "_carried", RANGE)
