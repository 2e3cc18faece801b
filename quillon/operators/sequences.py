"""Sequences as rows: one row for each sequence with its observations in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gathered(df: DataFrame, seq_id: str, order: list[str], value: str, out: str = "obs") -> DataFrame:
    """(seq_id, out): the values of each sequence in the given order.

    Recurrences along a sequence are sequential, so a sequence is one row; it must fit in a task's memory.
    """
    item = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(value).alias("v"))
    return df.groupBy(seq_id).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(out))


def runs(df: DataFrame, seq_id: str, order: str, flag: str) -> DataFrame:
    """Q30: (seq_id, start, length) of the maximal runs of true flags, one that reaches the end included."""
    from pyspark.sql import Window

    w = Window.partitionBy(seq_id).orderBy(order)
    numbered = df.withColumn("_p", F.row_number().over(w) - 1)
    on = numbered.where(flag).withColumn("_g", F.col("_p") - F.row_number().over(w))
    return on.groupBy(seq_id, "_g").agg(F.min("_p").cast("long").alias("start"), F.count(F.lit(1)).alias("length")).drop("_g")
