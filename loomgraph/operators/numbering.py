"""Numbers and running totals over a whole table, by ranges instead of one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.runtime import materialise


def running(df: DataFrame, order: list[str], amount: str | None = None, name: str = "number") -> DataFrame:
    """df with the sum of `amount` (1 each, without one) over the rows before each row in the order.

    Rows go to ranges of the order, each range sums its own, and a table with one row per range gives the starts.
    """
    value = F.col(amount).cast("bigint") if amount else F.lit(1).cast("bigint")
    parts = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()).withColumn("_value", value)
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = materialise(parts.withColumn("_own", F.coalesce(F.sum("_value").over(before), F.lit(0))), "running")
    sums = own.groupBy("_part").agg(F.sum("_value").alias("_all"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sums.select("_part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_start"))
    return own.join(F.broadcast(starts), "_part").withColumn(name, F.col("_own") + F.col("_start")).drop("_part", "_value", "_own", "_start")
