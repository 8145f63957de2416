import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import cache, ingest, request, security, session
from loomgraph.plans.engine import Engine
from loomgraph.sources import audit, changelog, payloads

NODE = "id bigint, embedding array<float>, data string, metadata map<string,string>"
EDGE = "source bigint, target bigint, relation string, weight float, metadata map<string,string>, seq bigint"


def small(spark):
    meta = lambda kind, day, src: {"entity_type": kind, "timestamp": day, "source": src}
    nodes = spark.createDataFrame([(1, [1.0, 0.0], "one", meta("Company", "2024-02-10", "s3://corp/1")), (2, [0.92, 0.08], "two", meta("Company", "2024-05-12", "s3://corp/2")), (3, [0.05, 0.95], "three", meta("Policy", "2022-07-01", "s3://policy/3"))], NODE)
    edges = spark.createDataFrame([(1, 2, "competitor_of", 0.9, {}, 0), (2, 3, "influenced_by", 0.6, {}, 1)], EDGE)
    return nodes, edges


def test_filters_apply_after_traversal(spark):
    nodes, edges = small(spark)
    r = request.Request("anything", entity_types=["Company"], time_range=("2024-01-01", "2024-12-31"), depth=3, top_k=10, search_mode="local")
    out = Engine(nodes, edges, now=0).execute(r)
    assert {x.id for x in out.state.nodes.collect()} == {1, 2}
    assert (3, "entity_type_filtered") in {(x.node_id, x.reason) for x in out.state.exclusions.collect()}
    assert out.answer.startswith("Answer synthesized from 2 evidence nodes:")
    assert {x.source for x in out.citations.collect()} == {"s3://corp/1", "s3://corp/2"}


def test_retention_and_empty_store(spark):
    nodes, edges = small(spark)
    old = nodes.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("retention_until_unix"), F.lit("1"))))
    out = Engine(old, edges, now=10).execute(request.Request("x", search_mode="drift"))
    assert out.state.n_nodes == 0 and out.state.notes[-1] == "drift_exhausted_no_evidence" and out.answer == "No evidence found for query: x"
    assert Engine(nodes.limit(0), edges.limit(0), now=0).execute(request.Request("x", search_mode="drift")).groundedness == 0


def test_requests():
    r = request.Request.parse(json.dumps({"query": "overall themes", "filters": {"relation_type": ["a"]}, "traversal": {"depth": 2, "relation_types": ["b"]}, "unknown": 1}))
    assert r.relation_types == ["a", "b"] and r.top_k == 20 and request.plan(r).search_mode == "global" and request.plan(r).vector_top_k == 20
    for bad in ({"query": " "}, {"query": "x", "top_k": 0}, {"query": "x", "top_k": 1001}, {"query": "x", "traversal": {"depth": 9}}, {"query": "x", "filters": {"time_range": {"from": "2024-02-01", "to": "2024-01-01"}}}, {"query": "x", "search_mode": "other"}, {"query": "x", "time_travel": "yesterday"}, {"query": "x", "filters": {"entity_type": [" "]}}):
        with pytest.raises(request.InvalidQuery):
            request.Request.parse(json.dumps(bad))
    assert request.as_of_millis("1970-01-01") == 86_399_999 and request.as_of_millis("1970-01-01T01:00:00+01:00") == 0
    assert request.plan(request.Request("x", search_mode="drift", depth=1, top_k=2)) == request.Plan("drift", 5, 3)


def test_cache():
    now = [0.0]
    c = cache.SemanticCache(capacity=2, ttl=10, clock=lambda: now[0])
    assert not c.insert(("k",), "a", 1)
    c.insert(("k",), "who made the first engine", "A")
    assert c.lookup(("k",), "the first engine who built") == "A" and c.lookup(("other",), "who made the first engine") is None
    now[0] = 11
    assert c.lookup(("k",), "who made the first engine") is None
    for i in range(3):
        now[0] += 1
        c.insert(("k",), f"question number {i} " + "abc" * i, i)
    assert len(c.entries) == 2


def test_sessions():
    now = [0.0]
    s = session.Sessions(ttl=5, clock=lambda: now[0])
    s.get_or_create("a", "ann")
    now[0] = 4
    assert s.get("a", "ann") and s.get("none") is None
    with pytest.raises(session.AccessDenied):
        s.get("a", "bob")
    now[0] = 5  # from creation, not from use
    assert s.get("a", "ann") is None


def token(claims, secret=b"k"):
    enc = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    body = f"{enc(json.dumps({'alg': 'HS256'}).encode())}.{enc(json.dumps(claims).encode())}"
    return f"{body}.{enc(hmac.new(secret, body.encode(), hashlib.sha256).digest())}"


def test_security():
    who = security.authenticate(token({"sub": "u", "tenant": "t", "roles": ["reader"], "exp": 10, "iss": "i", "aud": ["a"]}), b"k", "i", "a", now=5)
    security.authorize(who, security.Resource("t", "query"))
    for what, why in ((security.Resource("x", "query"), "tenant"), (security.Resource("t", "ingest"), "role_or_scope"), (security.Resource("t", "query", {"dept": "x"}), "attributes"), (security.Resource("t", "query", {}, 3), "clearance")):
        with pytest.raises(security.Denied, match=why):
            security.authorize(who, what)
    for bad in (token({"sub": "u", "tenant": "t", "exp": 5}), token({"sub": "u", "tenant": "t", "exp": 9}, b"other"), "x.y"):
        with pytest.raises(security.Unauthenticated):
            security.authenticate(bad, b"k", now=5)


def test_changelog_round_trip(spark, tmp_path):
    node = F.struct(F.col("id"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("x").alias("data"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))
    edge = F.lit(None).cast("struct<source:bigint,target:bigint,relation:string,weight:float,metadata:map<string,string>>")
    idem = F.lit(None).cast("struct<key:string,ids:array<bigint>>")
    for lsn in (1, 2):
        rows = spark.range(lsn, lsn + 1).select(F.lit(0).alias("op_idx"), F.lit("put").alias("op"), node.alias("node"), edge.alias("edge"), F.lit(None).cast("bigint").alias("node_id"), idem.alias("idem"))
        changelog.append(rows, str(tmp_path / "log"), lsn)
    log = changelog.read(spark, str(tmp_path / "log"))
    assert {r.id for r in changelog.state_at(log)[0].collect()} == {1, 2} and {r.id for r in changelog.state_at(log, 1)[0].collect()} == {1}
    assert changelog.read(spark, str(tmp_path / "log"), recover=True).count() == 2
    nodes, edges = changelog.state_at(log, 1)
    changelog.backup(nodes, edges, changelog.first_writes(log), str(tmp_path / "base"), 1)
    assert {r.id for r in changelog.restore(spark, str(tmp_path / "base"), 1, log)[0].collect()} == {1, 2}
    put = log.where("lsn = 2")
    wrong = spark.createDataFrame([(1, "put_edge", (2, 9, "r", 1.0, {}))], "op_idx int, op string, edge struct<source:bigint,target:bigint,relation:string,weight:float,metadata:map<string,string>>")
    bad = changelog.violations(put.select("op_idx", "op", "node").unionByName(wrong, allowMissingColumns=True), spark.createDataFrame([], "id bigint")).collect()
    assert [r.missing for r in bad] == [9]


def test_audit_continues(spark, tmp_path):
    e = spark.createDataFrame([("query", 1), ("ingest", 2)], "operation string, at int")
    for _ in range(2):
        audit.write(e, str(tmp_path / "audit"), ["at"])
    assert sorted(r.sequence for r in spark.read.json(str(tmp_path / "audit")).collect()) == [1, 2, 3, 4]


def test_extraction(spark):
    rows = [("file", b"plain", "a.txt", None, {}), ("file", b"\xff", "a.txt", "text/plain", {}), ("file", b"", "p.png", "", {"caption": " c ", "description": "c"}), ("file", b"", "x.zzz", "", {}), ("text", "tëxt".encode(), None, None, {})]
    out = payloads.extracted(spark.createDataFrame(rows, "kind string, content binary, filename string, mime_type string, metadata map<string,string>")).collect()
    assert [(r.text, r.error) for r in out] == [("plain", None), (None, "no_text_in_text"), ("c", None), (None, "unsupported_content"), ("tëxt", None)]


def test_chunks_and_ingest(spark):
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(60)) + "." for i in range(8)) + "x" * 2500
    parts = ingest.split_text(text)
    assert all(0 < len(p) <= 1000 and p == p.strip() for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
    req = spark.createDataFrame([(1, text, {}, "k", None), (2, text, {}, "k", None), (3, "a bad word", {}, None, None), (4, "mail me@x.org", {}, None, None), (5, "old", {}, "seen", None)], "request_id int, content string, metadata map<string,string>, idempotency_key string, model_id string")
    rows, rejected = ingest.ingest(req, spark.createDataFrame([("seen",)], "key string"), 9, ["BAD"], True, dims=4)
    assert [r.forbidden for r in rejected.collect()] == ["BAD"]
    got = rows.collect()
    assert sum(r.op == "put" for r in got) == len(parts) + 1 and sum(r.op == "idempotency" for r in got) == 2
    assert any(r.op == "put" and r.node.data == "mail [EMAIL]" for r in got)
    m = ingest.default_models()
    m.register("topic-lite", "2", [])
    assert m.resolve("topic-lite") == [] and m.resolve("topic-lite@1") == ingest.TOPICS and m.rollback("topic-lite") == "1" and m.resolve("nobody") == ingest.MOCK
