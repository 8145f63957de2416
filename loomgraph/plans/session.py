"""Session graphs: ephemeral nodes and edges over the persistent ones, with owner and fixed lifetime."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL_S = 30 * 60.0


class AccessDenied(PermissionError):
    code = "PERMISSION_DENIED"


@dataclass
class Session:
    session_id: str
    owner: str | None
    expires: float
    nodes: DataFrame | None = None
    edges: DataFrame | None = None


class Sessions:
    """Sessions by id; a session lives TTL seconds from its creation, however often it is used."""

    def __init__(self, ttl: float = TTL_S, clock=time.monotonic):
        self.ttl, self.clock, self.by_id = ttl, clock, {}

    def cleanup(self) -> int:
        gone = [k for k, s in self.by_id.items() if s.expires <= self.clock()]
        for k in gone:
            del self.by_id[k]
        return len(gone)

    def get_or_create(self, session_id: str, owner: str | None = None) -> Session:
        self.cleanup()
        return self.by_id.setdefault(session_id, Session(session_id, owner, self.clock() + self.ttl))

    def get(self, session_id: str, owner: str | None = None) -> Session | None:
        """A missing or expired session is none; with an owner given, a session of another or of none is denied."""
        self.cleanup()
        found = self.by_id.get(session_id)
        if found and owner is not None and found.owner != owner:
            raise AccessDenied(f"session {session_id} belongs to another owner")
        return found

    def add(self, session_id: str, nodes: DataFrame | None = None, edges: DataFrame | None = None, owner: str | None = None) -> Session:
        s = self.get_or_create(session_id, owner)
        s.nodes = nodes if s.nodes is None else s.nodes.unionByName(nodes) if nodes is not None else s.nodes
        s.edges = edges if s.edges is None else s.edges.unionByName(edges) if edges is not None else s.edges
        return s

    def promote(self, session_id: str, append) -> None:
        """Hands the session's rows to `append(nodes, edges)` as one transaction; puts the session back if that fails."""
        s = self.by_id.pop(session_id)
        try:
            append(s.nodes, s.edges)
        except Exception:
            self.by_id[session_id] = s
            raise


def overlay_nodes(base: DataFrame, session: DataFrame | None) -> DataFrame:
    """Session copies go before base nodes of the same id."""
    return base if session is None else session.unionByName(base.join(session.select("id"), "id", "left_anti"))


def overlay_edges(base: DataFrame, session: DataFrame | None) -> DataFrame:
    """Session edges come after the base ones of their source."""
    if session is None:
        return base
    after = base.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("after"))
    return base.unionByName(session.crossJoin(F.broadcast(after)).withColumn("seq", F.col("seq") + F.col("after") + 1).drop("after"))  # after is one row
