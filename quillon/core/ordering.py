"""Running sums over a whole ordered table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.core import scratch


def running_sum(df: DataFrame, order: list[str], amount: Column | None = None, out: str = "upto") -> DataFrame:
    """df with the sum of amount (rows, if None) over all rows up to and with its own, in ascending order.

    Rows are dealt to ranges of the order, each range is summed in a task of its own, and the ranges' totals, one row
    each, become offsets. Rows that are equal in order share a range and are taken in any order.
    """
    dealt = df.repartitionByRange(*order).withColumn("_amount", F.lit(1).cast("long") if amount is None else amount.cast("long"))
    ranged = scratch.stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum("_amount").alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn(out, F.sum("_amount").over(inside)).join(F.broadcast(offsets), "_range")
    return summed.withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_amount", "_before")
