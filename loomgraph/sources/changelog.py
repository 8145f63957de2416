"""The append-only change log: writing, integrity, replay to a state, snapshots and idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.schema import CHANGE


def append(changes: DataFrame, path: str, lsn: int) -> None:
    """One transaction: all its rows carry one LSN and become visible together (the commit of one job)."""
    payload = F.to_json(F.struct("op_idx", "op", "node", "edge", "node_id", "idem"))
    changes.withColumn("lsn", F.lit(lsn).cast("bigint")).withColumn("crc", F.crc32(payload.cast("binary"))).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, recover: bool = False) -> DataFrame:
    """The log. A row whose checksum fails is an error, or with `recover` the end: rows before its LSN remain."""
    log = spark.read.schema(CHANGE + ", crc bigint").parquet(path)
    payload = F.to_json(F.struct("op_idx", "op", "node", "edge", "node_id", "idem"))
    bad = F.crc32(payload.cast("binary")) != F.col("crc")
    if recover:
        first = log.agg(F.min(F.when(bad, F.col("lsn"))).alias("bad_lsn"))
        log = log.crossJoin(F.broadcast(first)).where("bad_lsn is null or lsn < bad_lsn").drop("bad_lsn")  # first is one row
        return log.drop("crc")
    return log.where(F.when(bad, F.raise_error(F.concat(F.lit("checksum fails at lsn "), F.col("lsn").cast("string"))).isNull()).otherwise(F.lit(True))).drop("crc")


def _when() -> Column:
    return F.struct("lsn", "op_idx")


def state_at(log: DataFrame, lsn: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after all changes up to lsn: the last write of each key wins; deleting a node deletes its edges.

    An edge lives if it is the last write of its key and no later delete touches either end.
    """
    seen = log if lsn is None else log.where(F.col("lsn") <= lsn)
    writes = seen.where(F.col("op").isin("put", "delete")).select(F.coalesce("node.id", "node_id").alias("id"), "op", "node", _when().alias("at"))
    last = writes.groupBy("id").agg(F.max_by(F.struct("op", "node"), "at").alias("w"))
    nodes = last.where("w.op = 'put'").select("w.node.*")
    edges = seen.where("op = 'put_edge'").select("edge.*", _when().alias("at"))
    edges = edges.groupBy("source", "target", "relation").agg(F.max_by(F.struct("at", "weight", "metadata"), "at").alias("w"))
    gone = writes.where("op = 'delete'").groupBy("id").agg(F.max("at").alias("gone"))
    s, t = gone.select(F.col("id").alias("source"), F.col("gone").alias("s_gone")), gone.select(F.col("id").alias("target"), F.col("gone").alias("t_gone"))
    alive = edges.join(s, "source", "left").join(t, "target", "left").where("(s_gone is null or w.at > s_gone) and (t_gone is null or w.at > t_gone)")
    # A later write goes to the end of its source's list, so its place is its time.
    return nodes, alive.select("source", "target", "relation", "w.weight", "w.metadata", (F.shiftleft(F.col("w.at.lsn"), 31) + F.col("w.at.op_idx")).alias("seq"))


def first_writes(log: DataFrame) -> DataFrame:
    """(key, ids, lsn): the first recorded result of each idempotency key."""
    rows = log.where("op = 'idempotency'").select("idem.key", "idem.ids", _when().alias("at"))
    return rows.groupBy("key").agg(F.min_by(F.struct("ids", "at"), "at").alias("w")).select("key", "w.ids", F.col("w.at.lsn").alias("lsn"))


def violations(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a transaction whose ends exist neither before it nor by an earlier operation of it."""
    made = changes.where("op = 'put'").groupBy(F.col("node.id").alias("id")).agg(F.min("op_idx").alias("made"))
    known = nodes.select("id", F.lit(-1).alias("made")).union(made).groupBy("id").agg(F.min("made").alias("made"))
    edges = changes.where("op = 'put_edge'").select("op_idx", "edge.source", "edge.target", "edge.relation")
    ends = edges.select("op_idx", "source", "target", "relation", F.explode(F.array("source", "target")).alias("id"))
    return ends.join(known, "id", "left").where("made is null or made > op_idx").select("op_idx", "source", "target", "relation", F.col("id").alias("missing")).distinct()


def catalog(log: DataFrame) -> DataFrame:
    """(snapshot_id, lsn) of every committed LSN."""
    return log.select("lsn").distinct().select(F.concat(F.lit("wal-lsn-"), F.col("lsn").cast("string")).alias("snapshot_id"), "lsn")


def resolve_as_of(snapshots: DataFrame, when: Column) -> DataFrame:
    """The last snapshot created at or before a time: one row, null without one."""
    return snapshots.where(F.col("created_at_ms") <= when).agg(F.max_by(F.struct("snapshot_id", "lsn", "created_at_ms"), F.struct("created_at_ms", "lsn")).alias("s")).select("s.*")


def as_of_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, right_cols: list[str], key: str | None = None, width: int = 86_400_000) -> DataFrame:
    """Each left row with the last right row at or before it, per key.

    Both sides are merged in time order within a key and carried forward, so no row meets more than one
    partner. Without a key, rows fall into buckets of `width` time units; each bucket starts from the last
    right row before it, which a window over one row per bucket finds.
    """
    part = key or "bucket"
    bucket = lambda t: [] if key else [F.floor(F.col(t) / width).alias("bucket")]
    own = [key] if key else []
    l_rows = left.select(*own, *bucket(left_time), F.col(left_time).alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("l"), F.lit(None).alias("r"))
    r_rows = right.select(*own, *bucket(right_time), F.col(right_time).alias("t"), F.lit(0).alias("side"), F.lit(None).alias("l"), F.struct(right_time, *right_cols).alias("r"))
    both = l_rows.unionByName(r_rows)
    w = Window.partitionBy(part).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("r", F.last("r", ignorenulls=True).over(w)).where("side = 1")
    if not key:
        last = both.groupBy("bucket").agg(F.max_by("r", F.when(F.col("side") == 0, F.col("t"))).alias("last"))
        earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select("bucket", F.last("last", ignorenulls=True).over(earlier).alias("before"))
        found = found.join(carried, "bucket").withColumn("r", F.coalesce("r", "before"))
    return found.select("l.*", *[F.col(f"r.{c}").alias(c) for c in right_cols])


def backup(nodes: DataFrame, edges: DataFrame, keys: DataFrame, path: str, lsn: int) -> None:
    """A base snapshot under lsn=<n>; the committer makes each table appear whole."""
    for name, df in (("nodes", nodes), ("edges", edges), ("idempotency", keys)):
        df.write.mode("overwrite").parquet(f"{path}/lsn={lsn:020d}/{name}")


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """LSNs of the complete base snapshots under a path, ascending."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(base):
        return []
    found = [f.getPath() for f in files.listStatus(base) if f.getPath().getName().startswith("lsn=")]
    done = lambda p: all(files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, f"{t}/_SUCCESS")) for t in ("nodes", "edges", "idempotency"))
    return sorted(int(p.getName().removeprefix("lsn=")) for p in found if done(p))


def latest_snapshot(spark: SparkSession, path: str, bound: int | None = None) -> int | None:
    """The greatest snapshot LSN at or before a bound."""
    return max((n for n in snapshots(spark, path) if bound is None or n <= bound), default=None)


def restore(spark: SparkSession, path: str, lsn: int | None, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State at the head from the base snapshot at lsn (the latest, without one) and the log after it; from the log alone if there is none."""
    lsn = latest_snapshot(spark, path) if lsn is None else lsn
    if lsn is None:
        return state_at(log)
    base_nodes = spark.read.parquet(f"{path}/lsn={lsn:020d}/nodes").select(F.lit(lsn).cast("bigint").alias("lsn"), F.lit(-1).alias("op_idx"), F.lit("put").alias("op"), F.struct("id", "embedding", "data", "metadata").alias("node"))
    base_edges = spark.read.parquet(f"{path}/lsn={lsn:020d}/edges").select(F.lit(lsn).cast("bigint").alias("lsn"), F.lit(0).alias("op_idx"), F.lit("put_edge").alias("op"), F.struct("source", "target", "relation", "weight", "metadata").alias("edge"))
    both = base_nodes.unionByName(base_edges, allowMissingColumns=True).unionByName(log.where(F.col("lsn") > lsn), allowMissingColumns=True)
    return state_at(both)
