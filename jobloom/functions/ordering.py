"""Exact global positions and running sums of a large table, without a window over all of it.

The rows are dealt into ranges of the order, sorted within each and written once. A row's position is its place in its
range plus the sizes of the ranges before; there are as many of those as partitions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.sources.tables import materialise

_SHIFT = 33  # of the partition's number in monotonically_increasing_id


def with_position(df: DataFrame, *order: Column | str, position: str = "position") -> DataFrame:
    """``df`` with the row number from 0 in the given order. The order should be total, so that it is repeatable."""
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("_id", _SHIFT).alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per partition: broadcast
    numbered = placed.withColumn("_range", F.shiftright("_id", _SHIFT)).join(F.broadcast(offsets), "_range")
    return numbered.withColumn(position, F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << _SHIFT) - 1))).drop("_id", "_range", "_offset")


def with_running_sum(df: DataFrame, value: str | Mapping[str, str], *order: Column | str, running: str = "running", within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to and including its own, in the given order within groups.

    ``value`` may map several columns to the names of their sums. Works for groups of any size: ranges of (``within``,
    order) are summed on their own and shifted by what lies before.
    """
    sums = {value: running} if isinstance(value, str) else dict(value)
    keys = [*within, *order]
    placed = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_id", _SHIFT))
    totals = placed.groupBy(*within, "_range").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in enumerate(sums)])
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*within, "_range", *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_offset_{k}") for k in range(len(sums))])
    own = Window.partitionBy(*within, "_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"_own_{k}": F.sum(c).over(own) for k, c in enumerate(sums)})
    out = summed.join(offsets, [*within, "_range"])
    spare = [f"_{kind}_{k}" for kind in ("own", "offset") for k in range(len(sums))]
    return out.withColumns({name: F.col(f"_own_{k}") + F.col(f"_offset_{k}") for k, name in enumerate(sums.values())}).drop("_id", "_range", *spare)
