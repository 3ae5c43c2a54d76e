"""Numbers without gaps in a total order, and values carried along it, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

_ROWS = (1 << 33) - 1  # monotonically_increasing_id: the partition above 33 bits of row number


def numbered(d: DataFrame, order: list, out: str, start: int = 0, slices: int | None = None) -> DataFrame:
    """d with `out`, the place of each row in the order, from `start`. The order must be total: ties are numbered in any order.

    Rows are cut into ranges of the order and sorted range by range, written once, counted by range, and each range's rows get the sum of the ranges before. Ranges are as many as tasks, so their sums are a small table.
    """
    spark = d.sparkSession
    parts = slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    d = written(d.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__id", 33)
    counts = d.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) + start).alias("__start"))
    d = d.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return d.withColumn(out, F.col("__start") + F.col("__id").bitwiseAND(F.lit(_ROWS))).drop("__id", "__part", "__start")


def carried(d: DataFrame, group: list[str], block: str, at: str, value: Column, out: str) -> DataFrame:
    """d with `out`: the last value that isn't null among the rows of the group up to this one, in the order of (block, at).

    A segmented scan: each block is scanned on its own, the blocks' last values are scanned in turn, and a block's first rows take what the blocks before it end on. No task has more than one block's rows, or one row for each block of a
    group.
    """
    v = "__value"
    inside = Window.partitionBy(*group, block).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn(v, value)
    ends = d.groupBy(*group, block).agg(F.max(F.when(F.col(v).isNotNull(), F.struct(F.col(at).alias("at"), F.col(v).alias("v")))).alias("__end"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*group, block, F.last("__end.v", ignorenulls=True).over(before).alias("__carried"))
    d = d.withColumn(out, F.last(v, ignorenulls=True).over(inside)).join(ends, [*group, block])
    return d.withColumn(out, F.coalesce(out, "__carried")).drop(v, "__carried")


def running_sum(d: DataFrame, group: list[str], block: str, at: str, value: Column, out: str) -> DataFrame:
    """d with `out`: the sum of value over the rows of the group before this one, in the order of (block, at); in two levels, as carried."""
    v = "__value"
    d = d.withColumn(v, value)
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*group, block).agg(F.sum(v).alias("__sum")).select(*group, block, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn(out, F.coalesce(F.sum(v).over(inside), F.lit(0))).join(sums, [*group, block])
    return d.withColumn(out, F.col(out) + F.col("__start")).drop(v, "__start")
