"""Gapless numbers in a given order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with 1-based row numbers by ``order``: each range partition numbers its own, then what lies before it is added.

    Without an order rows are numbered as they come, and nothing is shuffled.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    parts = settle(
        dealt.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # a row for each partition
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_seq") + 1).drop("_part", "_seq", "_before")
