"""Global order without a single task: row numbers, predecessors and running totals over range partitions.

Rows are range-partitioned and sorted; a row's number is its place in its partition plus the sizes of the
partitions before. Only one summary row for each partition meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

_ID_BITS = 33  # of monotonically_increasing_id, for the place within a partition


def _offsets(df: DataFrame, value: Column) -> DataFrame:
    """(part, before): the total of value over all partitions that come earlier."""
    sums = df.groupBy("part").agg(F.sum(value).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))


def number_rows(df: DataFrame, *order: Column) -> DataFrame:
    """Adds rn (1, 2, ... in this order, which should be total) and part (the range partition)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = ranged.withColumn("part", F.shiftright("_id", _ID_BITS).cast("int"))
    ranged = materialize(ranged.withColumn("_place", F.col("_id") - F.shiftleft(F.col("part").cast("long"), _ID_BITS)), "ordered")
    offsets = F.broadcast(_offsets(ranged, F.lit(1)))  # one row a partition
    return ranged.join(offsets, "part").withColumn("rn", F.col("before") + F.col("_place") + 1).drop("_id", "_place", "before")


def with_neighbour(df: DataFrame, value: str, name: str, step: int = 1) -> DataFrame:
    """Adds the value of the row `step` places before (after, if negative); null where there is none."""
    return df.join(df.select((F.col("rn") + step).alias("rn"), F.col(value).alias(name)), "rn", "left")


def running_total(df: DataFrame, flag: str, name: str) -> DataFrame:
    """Adds the sum of flag over this row and all before it, in the order of rn."""
    offsets = F.broadcast(_offsets(df, F.col(flag)))
    within = F.sum(flag).over(Window.partitionBy("part").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_within", within).join(offsets, "part").withColumn(name, F.col("before") + F.col("_within")).drop("_within", "before")


def ntile(df: DataFrame, groups: int, name: str) -> DataFrame:
    """Adds the number of the group, 1 to groups, when rn's order is cut into near-equal groups, larger first."""
    total = df.agg(F.count("*").alias("_n"))
    size, extra = F.expr(f"_n div {groups}"), F.col("_n") % groups
    big = extra * (size + 1)
    low = F.floor((F.col("rn") - 1) / (size + 1)) + 1
    high = extra + F.floor((F.col("rn") - 1 - big) / F.greatest(size, F.lit(1))) + 1
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("rn") <= big, low).otherwise(high).cast("int")).drop("_n")
