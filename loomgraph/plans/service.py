"""The service: one store behind queries and ingestion, with snapshots, sessions, cache, access control and audit."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import lookup
from loomgraph.plans import ingest as ingestion
from loomgraph.plans.cache import SemanticCache
from loomgraph.plans.engine import DEFAULT_MODEL, Engine, Response
from loomgraph.plans.request import MAX_DEPTH, MAX_K, InvalidQuery, Request, as_of_millis, plan
from loomgraph.plans.security import Principal, Resource, authorize
from loomgraph.plans.session import Sessions, overlay_edges, overlay_nodes
from loomgraph.runtime import materialise
from loomgraph.sources import changelog
from loomgraph.streaming.jobs import DurableJobs


class NotFound(LookupError):
    code = "NOT_FOUND"


class DanglingEdge(InvalidQuery):
    """An edge of a transaction has an end that is not there when its turn comes."""


class StoreUnavailable(OSError):
    """Reading or writing the log failed; worth another try."""

    code = "INTERNAL"


@dataclass
class Snapshot:
    snapshot_id: str
    lsn: int
    pinned: bool


class Store:
    """A change log under a path, with its catalog (snapshot_id, lsn, created_at_ms) beside it. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.clock = spark, path, clock
        self.catalog: list[tuple[int, int]] = []  # (created_at_ms, lsn), ascending
        self.cuts: list[tuple[int, int]] = []  # (after, upto): LSNs in between are truncated
        try:
            rows = spark.read.parquet(f"{path}/catalog").groupBy("lsn").agg(F.min("created_at_ms").alias("at")).orderBy("lsn").collect()
            self.catalog = [(r.at, r.lsn) for r in rows]
            self.cuts = [(r.after, r.upto) for r in spark.read.schema("after bigint, upto bigint").parquet(f"{path}/cuts").collect()]  # one row per truncation
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise

    @property
    def lsn(self) -> int:
        return next((n for _, n in reversed(self.catalog) if not self._cut(n)), 0)

    def _cut(self, lsn: int) -> bool:
        return any(after < lsn <= upto for after, upto in self.cuts)

    def truncate_after(self, lsn: int) -> None:
        """Later transactions no longer count; their LSNs are not used again."""
        last = self.catalog[-1][1] if self.catalog else 0
        if lsn < last:
            self.spark.createDataFrame([(lsn, last)], "after bigint, upto bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/cuts")
            self.cuts.append((lsn, last))

    def validate(self, changes: DataFrame) -> None:
        """Every edge needs both ends, before the transaction or by an earlier operation of it."""
        if changes.where("op = 'put_edge'").isEmpty():
            return
        bad = changelog.violations(changes, changelog.state_at(self.log(), self.lsn)[0]).orderBy("op_idx").limit(3).collect()
        if bad:
            raise DanglingEdge("; ".join(f"operation {r.op_idx}: {r.source}-{r.relation}->{r.target} misses node {r.missing}" for r in bad))

    def append(self, changes: DataFrame) -> int:
        """Validates the rows and writes them as the next transaction with its catalog entry; returns the LSN."""
        self.validate(changes)
        lsn = (self.catalog[-1][1] if self.catalog else 0) + 1
        try:
            changelog.append(changes.drop("lsn"), f"{self.path}/log", lsn)
        except Exception as e:
            raise StoreUnavailable(str(e)) from e
        at = int(self.clock() * 1000)
        self.spark.createDataFrame([(f"wal-lsn-{lsn}", lsn, at)], "snapshot_id string, lsn bigint, created_at_ms bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/catalog")
        self.catalog.append((at, lsn))
        return lsn

    def log(self) -> DataFrame:
        if not self.catalog:
            from loomgraph.schema import CHANGE

            return self.spark.createDataFrame([], CHANGE)
        cut = F.lit(False)
        for after, upto in self.cuts:
            cut = cut | ((F.col("lsn") > after) & (F.col("lsn") <= upto))
        return changelog.read(self.spark, f"{self.path}/log").where((F.col("lsn") <= self.lsn) & ~cut)

    def resolve(self, request: Request) -> Snapshot:
        """A named snapshot, else the last one at or before a time, else the head."""
        if request.snapshot_id:
            number = request.snapshot_id.removeprefix("wal-lsn-")
            if not request.snapshot_id.startswith("wal-lsn-") or not number.isdigit():
                raise InvalidQuery(f"snapshot_id must be wal-lsn-<lsn>: {request.snapshot_id}")
            if int(number) > self.lsn or self._cut(int(number)):
                raise NotFound(f"snapshot_id {request.snapshot_id}")
            return Snapshot(request.snapshot_id, int(number), True)
        if request.time_travel:
            at = as_of_millis(request.time_travel)
            seen = [lsn for made, lsn in self.catalog if made <= at and not self._cut(lsn)]
            if not seen:
                raise NotFound(f"time_travel {request.time_travel}")
            return Snapshot(f"wal-lsn-{seen[-1]}", seen[-1], True)
        return Snapshot(f"wal-lsn-{self.lsn}", self.lsn, False)


@dataclass(frozen=True)
class FlushPolicy:
    """When buffered transactions become durable: each at once, after some time, or after a number of them."""

    kind: str = "always"
    interval_ms: int = 15
    batch: int = 32

    def due(self, waiting: int, since_ms: float) -> bool:
        return waiting > 0 and (self.kind == "always" or (self.kind == "interval" and since_ms >= self.interval_ms) or (self.kind == "batch" and waiting >= self.batch))

    def trigger(self) -> dict:
        """The same as options of writeStream.trigger."""
        return {"processingTime": f"{self.interval_ms} milliseconds"} if self.kind == "interval" else {"processingTime": "0 seconds"}


@dataclass
class Buffered:
    """Group commit before a store: transactions get their LSN when submitted and are written together when the policy says so."""

    store: Store
    policy: FlushPolicy = field(default_factory=FlushPolicy)
    clock: Callable[[], float] = time.monotonic
    waiting: list[DataFrame] = field(default_factory=list)
    first: float = 0.0

    @property
    def durable_lsn(self) -> int:
        return self.store.lsn

    @property
    def current_lsn(self) -> int:
        return self.store.lsn + len(self.waiting)

    def submit(self, changes: DataFrame) -> int:
        if not self.waiting:
            self.first = self.clock()
        self.waiting.append(changes)
        lsn = self.current_lsn
        if self.policy.due(len(self.waiting), (self.clock() - self.first) * 1000):
            self.flush()
        return lsn

    def flush(self) -> int:
        while self.waiting:
            self.store.append(self.waiting[0])
            self.waiting.pop(0)
        return self.durable_lsn


@dataclass
class Reply:
    """A response, or an error with its code; never an exception."""

    response: Response | None
    snapshot_id: str | None = None
    cached: bool = False
    error_code: str | None = None
    message: str | None = None


@dataclass
class Service:
    store: Store
    summaries: DataFrame | None = None
    sessions: Sessions = field(default_factory=Sessions)
    cache: SemanticCache = field(default_factory=SemanticCache)
    audit: Callable[[dict], None] | None = None
    forbidden: list[str] = field(default_factory=list)
    mask: bool = False
    dims: int = ingestion.DIMS
    jobs: DurableJobs | None = None

    def _audit(self, **event) -> None:
        if self.audit:
            self.audit(event)

    def query(self, request: Request | str, who: Principal | None = None, owner: str | None = None) -> Reply:
        tenant = who.tenant if who else None
        try:
            if who:
                authorize(who, Resource(who.tenant, "query"))
            r = Request.parse(request) if isinstance(request, str) else request
            r.validate()
            at = self.store.resolve(r)
            session = self.sessions.get(r.session_id, owner) if r.session_id else None
            key = None
            if tenant is None and session is None:  # what one tenant or session sees is not for others
                p = plan(r)
                key = (at.lsn, p.search_mode, p.depth, p.vector_top_k, r.top_k, r.mode, r.model_id or DEFAULT_MODEL, tuple(sorted(r.entity_types)), tuple(sorted(r.relation_types)), r.time_range, at.pinned)
                if (hit := self.cache.lookup(key, r.query)) is not None:
                    self._audit(operation="query", outcome="succeeded", tenant=tenant, snapshot_id=at.snapshot_id)
                    return Reply(hit, at.snapshot_id, True)
            nodes, edges = changelog.state_at(self.store.log(), at.lsn)
            if session:
                nodes, edges = overlay_nodes(nodes, session.nodes), overlay_edges(edges, session.edges)
            out = Engine(nodes, edges, self.summaries, at.lsn, at.pinned).execute(r, tenant)
            if key:
                self.cache.insert(key, r.query, out)
            self._audit(operation="query", outcome="succeeded", tenant=tenant, snapshot_id=at.snapshot_id)
            return Reply(out, at.snapshot_id)
        except (InvalidQuery, NotFound, PermissionError, StoreUnavailable) as e:
            self._audit(operation="query", outcome="failed", tenant=tenant, snapshot_id=None)
            return Reply(None, error_code=getattr(e, "code", "INTERNAL"), message=str(e))

    def insert_edges_to_session(self, session_id: str, edges: DataFrame, owner: str | None = None) -> None:
        """edges(source, target, relation, weight, metadata, seq) of the session alone."""
        self.sessions.get(session_id, owner)
        self.sessions.add(session_id, edges=edges, owner=owner)

    def node_ids(self, session_id: str | None = None, owner: str | None = None) -> DataFrame:
        """The sorted ids of the store, and of the session if given."""
        session = self.sessions.get(session_id, owner) if session_id else None
        return lookup.node_ids(changelog.state_at(self.store.log(), self.store.lsn)[0], session.nodes if session else None)

    def ingest(self, requests: DataFrame, who: Principal | None = None, session_id: str | None = None, owner: str | None = None) -> tuple[int, DataFrame]:
        """requests as for plans.ingest -> (LSN, rejected requests).

        With a session the nodes go there and nothing is stored (the LSN stays). With a job queue each stored
        chunk is enqueued for extraction, so vectors come first and entities later.
        """
        if who:
            authorize(who, Resource(who.tenant, "ingest"))
            requests = requests.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, _: k != "tenant"), F.create_map(F.lit("tenant"), F.lit(who.tenant))))
        known = changelog.first_writes(self.store.log()).select("key")
        rows, rejected = ingestion.ingest(requests, known, self.store.lsn + 1, self.forbidden, self.mask, self.dims)
        if session_id is not None:
            self.sessions.get(session_id, owner)
            self.sessions.add(session_id, materialise(rows.where("op = 'put'").select("node.*"), "session-nodes"), owner=owner)
            return self.store.lsn, rejected
        rows = materialise(rows, "changes")
        lsn = self.store.append(rows)
        if self.jobs:
            self.jobs.enqueue(rows.where("op = 'put'").select(F.col("node.id").alias("node_id"), F.col("node.data").alias("content"), F.col("node.metadata")["model_id"].alias("model_id"), F.lit(f"wal-lsn-{lsn}").alias("snapshot_id")))
        self._audit(operation="ingest", outcome="succeeded", tenant=who.tenant if who else None, snapshot_id=f"wal-lsn-{lsn}")
        return lsn, rejected


@dataclass
class Client:
    """Calls the service again when the store fails: attempts with growing pauses."""

    service: Service
    attempts: int = 3
    first_ms: float = 25.0
    most_ms: float = 250.0
    growth: float = 2.0
    sleep: Callable[[float], None] = time.sleep

    def _tried(self, call: Callable):
        for n in range(max(1, self.attempts)):
            try:
                return call()
            except StoreUnavailable:
                if n + 1 >= max(1, self.attempts):
                    raise
                self.sleep(min(self.first_ms * max(1.0, self.growth) ** n, self.most_ms) / 1000)

    def query(self, request: Request | str, **kw) -> Reply:
        return self._tried(lambda: self.service.query(request, **kw))

    def ingest(self, requests: DataFrame, **kw) -> tuple[int, DataFrame]:
        return self._tried(lambda: self.service.ingest(requests, **kw))


@dataclass
class RetrieverAdapter:
    """The calls that retrieval frameworks make: documents in, evidence of local search out."""

    client: Client

    def add_documents(self, requests: DataFrame) -> tuple[int, DataFrame]:
        return self.client.ingest(requests)

    def similarity_search(self, query: str, k: int = 4, **pins) -> Reply:
        return self.client.query(Request(query, top_k=min(max(k, 1), MAX_K), mode="evidence", search_mode="local", **pins))

    def graph_search(self, query: str, k: int = 4, depth: int = 2, **pins) -> Reply:
        return self.client.query(Request(query, top_k=min(max(k, 1), MAX_K), depth=min(max(depth, 1), MAX_DEPTH), mode="evidence", search_mode="local", **pins))

    query_subgraph = graph_search
