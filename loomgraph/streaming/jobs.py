"""The durable job queue: a fold over its log in batch, and a stateful stream with retries and dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.runtime import materialise

MAX_ATTEMPTS, BACKOFF_MS, KEEP_MS = 3, 100, 3_600_000
OUTPUT = "job_id bigint, status string, attempt int, retry_at_ms bigint"
STATE = "attempt int, done boolean"


def pending(log: DataFrame) -> DataFrame:
    """(id, attempt) of jobs enqueued but neither completed nor dead; log(id, op, attempt)."""
    ended = log.where(F.col("op").isin("complete", "dead_letter")).select("id")
    return log.where("op = 'enqueue'").join(ended, "id", "left_anti").groupBy("id").agg(F.max("attempt").alias("attempt"))


def counters(log: DataFrame) -> DataFrame:
    """One row: enqueued (distinct jobs), retried (further enqueues), completed, dead."""
    of = lambda op: F.when(F.col("op") == op, F.col("id"))
    return log.agg(F.count_distinct(of("enqueue")).alias("enqueued"), (F.count(of("enqueue")) - F.count_distinct(of("enqueue"))).alias("retried"), F.count_distinct(of("complete")).alias("completed"), F.count_distinct(of("dead_letter")).alias("dead"))


def dead_letters(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(id, attempts) of jobs that failed max_attempts times before any success; attempts(id, at, ok)."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    ranked = attempts.withColumn("n", n)
    good = ranked.where("ok").groupBy("id").agg(F.min("n").alias("first_ok"))
    tried = ranked.groupBy("id").agg(F.max("n").alias("tried")).join(good, "id", "left")
    return tried.where(f"coalesce(first_ok, {max_attempts + 1}) > {max_attempts} and tried >= {max_attempts}").select("id", F.lit(max_attempts).cast("bigint").alias("attempts"))


def newest(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The last rows by order, at most `limit`."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(limit)


def backoff_ms(attempt: int, base: int = BACKOFF_MS) -> int:
    return base * 2 ** (attempt - 1)


def _advance(max_attempts: int, keep_ms: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempt, done = state.get if state.exists else (0, False)
        columns = [x.split()[0] for x in OUTPUT.split(", ")]
        if state.hasTimedOut:  # a finished job is forgotten, a retry is due
            due = [] if done else [(key[0], "due", attempt, None)]
            if done:
                state.remove()
            else:
                state.update((attempt, done))
            yield pd.DataFrame(due, columns=columns).astype({"retry_at_ms": "Int64"})
            return
        out = []
        rows = pd.concat(list(frames)).sort_values("at_ms")
        for ok, at in zip(rows.ok, rows.at_ms, strict=True):
            if done:
                continue
            attempt += 1
            done = bool(ok) or attempt >= max_attempts
            status = "completed" if ok else "dead_letter" if done else "retry"
            out.append((key[0], status, attempt, int(at) + backoff_ms(attempt) if status == "retry" else None))
        state.update((attempt, done))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms if done else backoff_ms(attempt))
        yield pd.DataFrame(out, columns=columns).astype({"retry_at_ms": "Int64"})

    return run


def worker(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, keep_ms: int | None = None) -> DataFrame:
    """A stream of attempts(job_id, ok, at_ms) -> each job's course: retries with their time, completions, dead letters.

    With keep_ms (KEEP_MS, say), a retry whose pause has passed without an attempt is announced as due, and a
    finished job is forgotten after keep_ms without attempts. Such timers keep a stream going for ever, so they
    are for running streams, not for availableNow.
    """
    return attempts.groupBy("job_id").applyInPandasWithState(_advance(max_attempts, keep_ms), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def apply_jobs(batch: DataFrame, batch_id: int, dictionary: list, path: str) -> None:
    """foreachBatch body: entity nodes and edges of a batch of jobs(node_id, content), in a folder of the batch that a rerun overwrites."""
    from loomgraph.plans.ingest import mentions

    nodes, edges = mentions(batch.select(F.col("node_id").alias("id"), F.col("content").alias("data")), dictionary)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes/batch={batch_id}")
    edges.write.mode("overwrite").parquet(f"{path}/edges/batch={batch_id}")


class JobQueue(Protocol):
    """What workers need of a queue."""

    def enqueue(self, jobs: DataFrame) -> None: ...

    def pending(self) -> DataFrame: ...


JOB = "id bigint, op string, attempt int, node_id bigint, content string, model_id string, snapshot_id string"


@dataclass
class DurableJobs:
    """A queue whose log is a Parquet table: a job is stored first, and announced by its file (a stream may read the folder).

    The id of a job is its node's, so enqueuing a node again is no new job. `run` works off what is pending at
    least once: entities and mentions go to the store as one transaction before the jobs count as complete, and
    a rerun puts the same keys again. After max_attempts failures the jobs of a run are dead letters.
    """

    spark: SparkSession
    path: str
    max_attempts: int = MAX_ATTEMPTS

    def _write(self, rows: DataFrame) -> None:
        rows.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in JOB.split(", ")]).write.mode("append").parquet(self.path)

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(JOB).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], JOB)

    def enqueue(self, jobs: DataFrame) -> None:
        self._write(jobs.select(F.col("node_id").alias("id"), F.lit("enqueue").alias("op"), F.lit(0).alias("attempt"), "node_id", "content", "model_id", "snapshot_id"))

    def pending(self) -> DataFrame:
        """(id, attempt, node_id, content, model_id, snapshot_id) of open jobs."""
        open_ = pending(self.log()).withColumnRenamed("attempt", "tried")
        return self.log().where("op = 'enqueue'").join(open_, "id").where("attempt = tried").drop("op", "tried").dropDuplicates(["id"])

    def run(self, models, append: Callable[[DataFrame], int]) -> int:
        """Work off the pending jobs; returns how many were taken. `append` stores change rows as one transaction."""
        from loomgraph.plans.ingest import mentions

        taken = materialise(self.pending(), "jobs")
        n = taken.count()
        if not n:
            return 0
        try:
            changes = None
            for name in [r.model_id for r in taken.select("model_id").distinct().collect()]:  # one row per model
                own = taken.where(F.col("model_id").eqNullSafe(name))
                nodes, edges = mentions(own.select(F.col("node_id").alias("id"), F.col("content").alias("data")), models.resolve(name))
                part = entity_changes(nodes, edges)
                changes = part if changes is None else changes.unionByName(part)
            append(changes)
        except Exception:
            tried = F.col("attempt") + 1
            self._write(taken.withColumn("op", F.when(tried >= self.max_attempts, "dead_letter").otherwise("enqueue")).withColumn("attempt", tried))
            raise
        self._write(taken.withColumn("op", F.lit("complete")))
        return n


def entity_changes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Change rows of entity nodes, then of their mention edges, in one transaction (nodes have operation 0, edges 1)."""
    empty = F.create_map().cast("map<string,string>")
    puts = nodes.select(F.lit(0).alias("op_idx"), F.lit("put").alias("op"), F.struct("id", "embedding", "data", "metadata").alias("node"))
    links = edges.select(F.lit(1).alias("op_idx"), F.lit("put_edge").alias("op"), F.struct("source", "target", "relation", F.col("weight").cast("float").alias("weight"), empty.alias("metadata")).alias("edge"))
    both = puts.unionByName(links, allowMissingColumns=True)
    return both.withColumns({"node_id": F.lit(None).cast("bigint"), "idem": F.lit(None).cast("struct<key:string,ids:array<bigint>>")})
