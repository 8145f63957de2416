import json

from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.plans.request import Request
from loomgraph.plans.security import Principal
from loomgraph.plans.service import Client, RetrieverAdapter, Service, Store, StoreUnavailable

REQ = "request_id int, content string, metadata map<string,string>, idempotency_key string, model_id string"


def test_ingest_query_time_travel(spark, tmp_path):
    now, events = [1_700_000_000.0], []
    s = Service(Store(spark, str(tmp_path / "store"), clock=lambda: now[0]), dims=8, audit=events.append)
    ada = Principal("ada", "t1", {"admin"})
    s.ingest(spark.createDataFrame([(1, "first text about rivers", {}, "k1", None)], REQ), ada)
    now[0] += 100
    s.ingest(spark.createDataFrame([(2, "second text about mills", {}, None, None), (3, "again", {}, "k1", None)], REQ), ada)
    head = s.query(Request("text about mills", search_mode="local"))
    assert head.snapshot_id == "wal-lsn-2" and head.response.state.n_nodes == 2 and not head.cached
    assert s.query(Request("about mills text", search_mode="local")).cached
    old = s.query(Request("text", search_mode="local", snapshot_id="wal-lsn-1"))
    assert old.response.state.n_nodes == 1
    past = s.query(Request("text", search_mode="local", time_travel="2023-11-14T22:13:30+00:00"))
    assert past.snapshot_id == "wal-lsn-1"
    assert s.query(Request("x", time_travel="2001-01-01")).error_code == "NOT_FOUND"
    assert s.query(Request("x", snapshot_id="latest")).error_code == "INVALID_ARGUMENT"
    assert s.query(json.dumps({"query": " "})).error_code == "INVALID_ARGUMENT"
    assert s.query(Request("x"), Principal("eve", "t1", {"ingestor"})).error_code == "PERMISSION_DENIED"
    assert s.query(Request("text", search_mode="local"), Principal("bob", "t2", {"reader"})).response.state.n_nodes == 0
    assert Store(spark, str(tmp_path / "store")).lsn == 2
    assert {e["outcome"] for e in events} == {"succeeded", "failed"}
    s.sessions.add("s1", s.query(Request("text", search_mode="local")).response.state.nodes.limit(0).select(F.lit(7).cast("bigint").alias("id"), F.array().cast("array<float>").alias("embedding"), "data", F.create_map().cast("map<string,string>").alias("metadata")))
    assert s.query(Request("text", search_mode="local", session_id="s1")).response is not None


def test_retries():
    class Flaky:
        calls = 0

        def query(self, request):
            self.calls += 1
            if self.calls < 3:
                raise StoreUnavailable("busy")
            return request.depth, request.top_k

    pauses = []
    assert RetrieverAdapter(Client(Flaky(), sleep=pauses.append)).graph_search("q", k=0, depth=99) == (8, 1)
    assert pauses == [0.025, 0.05]


def test_settings(tmp_path):
    (tmp_path / "default.json").write_text('{"server": {"port": 1, "host": "a"}}')
    (tmp_path / "production.json").write_text('{"server": {"port": 2}}')
    assert config.load(str(tmp_path), {"RUN_MODE": "production", "LOOMGRAPH_SERVER__HOST": "b"}) == {"server": {"port": 2, "host": "b"}}
    assert config.StorageProfile("gpu_vram").resolved()[2] and config.StorageProfile().resolved() == ("cpu_memory", "disabled", None)


def change(spark, rows):
    from loomgraph.schema import CHANGE

    return spark.createDataFrame(rows, CHANGE)


def test_transactions_are_validated_and_truncated(spark, tmp_path):
    import pytest

    from loomgraph.plans.service import Buffered, DanglingEdge, FlushPolicy

    store = Store(spark, str(tmp_path / "store"))
    node = lambda i, n: (None, i, "put", (n, [1.0], f"n{n}", {}), None, None, None)
    edge = lambda i, s, t: (None, i, "put_edge", None, (s, t, "r", 1.0, {}), None, None)
    assert store.append(change(spark, [node(0, 1), node(1, 2), edge(2, 1, 2)])) == 1
    for bad in ([edge(0, 1, 9)], [edge(0, 1, 3), node(1, 3)]):
        with pytest.raises(DanglingEdge):
            store.append(change(spark, bad))
    assert store.lsn == 1 and store.append(change(spark, [node(0, 3), edge(1, 1, 3)])) == 2
    store.truncate_after(1)
    assert store.lsn == 1 and store.append(change(spark, [node(0, 4)])) == 3
    again = Store(spark, str(tmp_path / "store"))
    from loomgraph.sources import changelog

    assert again.lsn == 3 and {r.id for r in changelog.state_at(again.log())[0].collect()} == {1, 2, 4}
    assert Service(again).query(Request("x", snapshot_id="wal-lsn-2")).error_code == "NOT_FOUND"
    late = Buffered(again, FlushPolicy("batch", batch=2))
    assert late.submit(change(spark, [node(0, 5)])) == 4 and (late.durable_lsn, late.current_lsn) == (3, 4)
    assert late.submit(change(spark, [node(0, 6)])) == 5 and late.durable_lsn == 5
    assert FlushPolicy().due(1, 0) and not FlushPolicy("interval").due(1, 3) and FlushPolicy("interval").trigger() == {"processingTime": "15 milliseconds"}
    nodes, edges = changelog.state_at(again.log())
    for lsn in (3, 5):
        changelog.backup(nodes, edges.drop("seq"), changelog.first_writes(again.log()), str(tmp_path / "base"), lsn)
    assert changelog.snapshots(spark, str(tmp_path / "base")) == [3, 5] and changelog.latest_snapshot(spark, str(tmp_path / "base"), 4) == 3
    assert changelog.latest_snapshot(spark, str(tmp_path / "base"), 2) is None and changelog.snapshots(spark, str(tmp_path / "none")) == []
    assert changelog.restore(spark, str(tmp_path / "base"), None, again.log())[0].count() == 5


def test_sessions_jobs_and_ids(spark, tmp_path):
    from loomgraph.plans.ingest import default_models
    from loomgraph.streaming.jobs import DurableJobs

    s = Service(Store(spark, str(tmp_path / "store")), dims=8, jobs=DurableJobs(spark, str(tmp_path / "jobs")))
    s.ingest(spark.createDataFrame([(1, "the Rust language", {}, None, "mock-ner"), (2, "a Graph of it", {}, None, None)], REQ))
    assert s.jobs.pending().count() == 2 and s.jobs.run(default_models(), s.store.append) == 2 and s.store.lsn == 2
    assert s.node_ids().count() == 4 and s.jobs.pending().count() == 0
    s.ingest(spark.createDataFrame([(3, "only in the session", {}, None, None)], REQ), session_id="s1", owner="ada")
    assert s.store.lsn == 2 and s.node_ids("s1", "ada").count() == 5 and s.node_ids().count() == 4
    log = s.store.log().where("lsn = 1")
    assert log.count() == log.select("op_idx").distinct().count() == 4


def test_odd_requests_are_answered():
    from loomgraph.plans.request import InvalidQuery

    for raw in ({"filters": {"time_range": {"from": "2024-01-01"}}}, {"filters": {"entity_type": [1]}}, {"filters": []}, {"traversal": "x"}, {"filters": {"relation_type": "a"}}, {"model_id": 3}, {"filters": {"time_range": "2024"}}):
        try:
            Request.parse(json.dumps({"query": "q"} | raw))
        except InvalidQuery:
            continue
        assert raw == {"filters": []}
