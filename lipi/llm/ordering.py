"""Positions in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, staged


def ranked(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """rows with their position (long, from 1) in the order.

    The rows are range-partitioned and sorted, and written with their partition
    and place, which fixes both; the sizes of the partitions (one row each) give
    every partition its offset. Rows equal in all order columns get consecutive
    positions in no stated order."""
    held = staged(rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("_part").agg(F.count("*").alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(sizes), "_part").select(
        *rows.columns, (F.col("_before") + F.col("_at") + 1).alias(name))
