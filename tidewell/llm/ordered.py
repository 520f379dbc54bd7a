"""Tables in one total order, stored as range-sorted partitions, and running sums along it.

A range exchange gives every partition a stretch of the order, and the total order cuts hot
keys and groups of equal rows like any others. The sorted rows are stored with the number of
their partition and their place in it, so every later pass, and a task that runs again after
a lost executor, sees the same stretches; only sums per group and partition travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.storage import materialize

#: A partition holds about so many rows at most.
ROWS = 200_000


def range_sorted(rows: DataFrame, order: Sequence[str | Column], label: str, most: int = ROWS, least: int | None = None) -> DataFrame:
    """Stored ``rows`` with ``part``, the number of a stretch, and ``pos``, which ascends in the order.

    ``least`` is the number of stretches of a small table, by default that of shuffle partitions.
    """
    least = least or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-rows.count() // most))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    return materialize(placed.withColumn("part", F.shiftright("pos", 33).cast("int")), label)


def offsets(placed: DataFrame, group: Sequence[str], value: Column) -> DataFrame:
    """(group, part, offset, total): sums of ``value`` over a group's earlier stretches, and over all; a row per group and stretch."""
    sums = placed.groupBy(*group, "part").agg(F.sum(value).alias("__sum"))
    whole = Window.partitionBy(*group)
    before = F.sum("__sum").over(whole.orderBy("part")) - F.col("__sum")
    return sums.select(*group, "part", before.alias("offset"), F.sum("__sum").over(whole).alias("total"))


def running(placed: DataFrame, group: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add ``name``, the sum of ``value`` over the earlier rows of the same group, which is never null."""
    inside = Window.partitionBy(*group, "part").orderBy("pos")
    local = placed.withColumn("__local", F.sum(value).over(inside) - value)
    before = offsets(placed, group, value).drop("total")  # joins on the window's own partitioning
    return local.join(before, [*group, "part"]).withColumn(name, F.col("__local") + F.col("offset")).drop("__local", "offset")
