"""Exact vector search: one query as an expression, many queries as block products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.vectors import cosine

#: Query vectors sent to the tasks at once; more queries take more passes.
QUERY_BLOCK = 4096


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): the k vectors nearest to the query by cosine; ties go to the smaller id. Other dimensions are dropped."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), q).alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), "id").limit(k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right dimension, and their places."""
    ok = np.flatnonzero(np.array([v is not None and len(v) == dims for v in column]))
    kept = column.take(pa.array(ok))
    return kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), dims), ok


def _partial(ids: np.ndarray, queries: np.ndarray, k: int, skip_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = _unit(queries)
        for batch in batches:
            m, at = _matrix(batch.column("vec"), queries.shape[1])
            if not len(at):
                continue
            own = batch.column("id").to_numpy()[at]
            order = np.argsort(own, kind="stable")
            own, m = own[order], _unit(m[order])
            score = np.round(unit @ m.T, 12)
            if skip_self:
                score[ids[:, None] == own[None, :]] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # stable: ties to the smaller id
            found = np.take_along_axis(score, best, axis=1)
            q = np.repeat(ids, best.shape[1])
            keep = np.isfinite(found.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(own[best.ravel()][keep]), pa.array(found.ravel()[keep])], ["query_id", "id", "score"])

    return run


def batched_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", skip_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank) of each query's k nearest vectors.

    Queries go out in blocks of QUERY_BLOCK; each Arrow batch of vectors is one matrix product and keeps
    k rows per query, so what is shuffled is k rows per query and batch, not the product of both tables.
    """
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).where("vec is not null and size(vec) > 0")
    found, block = None, []

    def one_pass(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows], np.int64)
        return base.mapInArrow(_partial(ids, np.array([r[1] for r in rows], np.float64), k, skip_self), "query_id bigint, id bigint, score double")

    for r in queries.select(F.col(id_col).cast("bigint"), F.col(vec_col)).where(F.size(vec_col) > 0).toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            found, block = one_pass(block) if found is None else found.union(one_pass(block)), []
    if block or found is None:
        if not block:
            return base.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        found = one_pass(block) if found is None else found.union(one_pass(block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def overlay_top_k(base_hits: DataFrame, session_hits: DataFrame, k: int) -> DataFrame:
    """Base hits and all session hits, the best per id, cut to k again."""
    both = base_hits.select("id", "score").unionByName(session_hits.select("id", "score"))
    return both.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def upsert_vectors(writes: DataFrame) -> DataFrame:
    """Last write per id by seq; an empty vector removes its id."""
    last = writes.groupBy("id").agg(F.max_by("embedding", "seq").alias("embedding"))
    return last.where(F.size("embedding") > 0)
