"""Consecutive numbers in a total order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reedbed.plans.runtime import materialise, shuffle_partitions


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name`` counting from ``start`` in the order; ``order`` must tell all rows apart.

    The rows are range-partitioned and sorted; a window over one row for each partition gives where each begins."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = materialise(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "numbered",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(begins), "_part").withColumn(name, F.col("_first") + F.col("_nth") + start).drop("_part", "_nth", "_first")
