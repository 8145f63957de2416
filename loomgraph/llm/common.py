"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Python work on one Arrow batch goes in slices of about this many bytes of text.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables written by this process and not dropped yet.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, not a recomputation. It stays until
    `drop_written`, as what is returned reads it whenever it runs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written after the first `since`, but for the last `keep`; for callers that have stored what they read."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written() -> int:
    return len(_WRITTEN)


def without_gc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with the collector of cycles off until the last is done: for work that makes no cycles over a large cache."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield from batches
    finally:
        if on:
            gc.enable()


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch into runs of rows with about `limit` bytes of text each (one row at least)."""
    start = size = 0
    lengths = pa.compute.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null is an empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, so that other columns can't clash with what it adds."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
