"""Audit events as JSON lines with a running sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.numbering import running

EVENT = "sequence bigint, operation string, outcome string, actor string, tenant string, model_id string, snapshot_id string, metadata map<string,string>"


def sequenced(events: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """Events numbered in order from after + 1; ties of the order have no order."""
    return running(events, order, None, "sequence").withColumn("sequence", F.col("sequence") + after + 1)


def last_sequence(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.schema(EVENT).json(path).agg(F.max("sequence")).first()[0] or 0
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def write(events: DataFrame, path: str, order: list[str]) -> None:
    sequenced(events, order, last_sequence(events.sparkSession, path)).write.mode("append").json(path)
