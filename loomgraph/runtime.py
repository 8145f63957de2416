"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df under spark.checkpoint.dir (where it is unset, a temporary folder in local mode, else an error) and read it back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loomgraph-')}")
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/loomgraph-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
