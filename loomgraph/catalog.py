"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

documents and embeddings that share an id are hybrid nodes; the business tables are a property graph
whose ids carry the table's tag (tag * 10**9 + key); events are a change log, a job log and a query log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import ids, text, vectors
from loomgraph.operators import ann, filters, graph, lookup, rank, traverse, vector
from loomgraph.operators.numbering import running
from loomgraph.plans import cache, ingest, metrics, request, security, session
from loomgraph.plans.engine import Engine
from loomgraph.runtime import materialise
from loomgraph.sources import audit, changelog, crypto, payloads
from loomgraph.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERY_TEXT = "the hention of eran and thonti"
TENANT, NOW = "t3", 1_720_000_000
TAG = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "orders": 5, "part": 6}
BILLION = 1_000_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the demonstration graph -------------------------------------------------------------------

NODES = """n AS (SELECT d.doc_id AS id, d.text AS data, d.source AS source, d.lang AS entity_type, 't' || e.label AS tenant,
  strftime(DATE '2024-01-01' + CAST(d.doc_id % 365 AS INTEGER), '%Y-%m-%d') AS ts, 1700000000 + d.doc_id * 86400 AS retention,
  CAST(e.embedding AS DOUBLE[]) AS v FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""


def hybrid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    until = (F.lit(1_700_000_000) + F.col("doc_id") * 86_400).cast("string")
    meta = F.create_map(F.lit("source"), "source", F.lit("entity_type"), "lang", F.lit("tenant"), F.concat(F.lit("t"), F.col("label").cast("string")), F.lit("timestamp"), day, F.lit("retention_until_unix"), until)
    return both.select(F.col("doc_id").alias("id"), "embedding", F.col("text").alias("data"), meta.alias("metadata"))


EDGES = f"""e AS (
  SELECT {2 * BILLION} + n_nationkey AS source, {BILLION} + n_regionkey AS target, 'in_region' AS relation, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT {3 * BILLION} + c_custkey, {2 * BILLION} + c_nationkey, 'in_nation', 1.0 FROM customer
  UNION ALL SELECT {4 * BILLION} + s_suppkey, {2 * BILLION} + s_nationkey, 'based_in', 1.0 FROM supplier
  UNION ALL SELECT {5 * BILLION} + o_orderkey, {3 * BILLION} + o_custkey, 'placed_by', 1.0 FROM orders
  UNION ALL SELECT {5 * BILLION} + l_orderkey, {6 * BILLION} + l_partkey, 'contains', sum(l_quantity) FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT {4 * BILLION} + l_suppkey, {6 * BILLION} + l_partkey, 'supplies', 1.0 FROM lineitem GROUP BY 1, 2)"""


def business_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(name: str, source: str, target: str, relation: str, weight=None) -> DataFrame:
        tags = {"n": "nation", "c": "customer", "s": "supplier", "o": "orders", "r": "region", "p": "part", "l": "orders"}
        s_tag, t_tag = (TAG[tags[x[0]]] for x in (source, target))
        s_col, t_col = source[2:], target[2:]
        df = table(spark, sf_dir, name)
        pair = (F.col(s_col).cast("bigint") + s_tag * BILLION).alias("source"), (F.col(t_col).cast("bigint") + t_tag * BILLION).alias("target")
        if name == "lineitem":
            w = F.sum(weight) if weight else F.lit(1.0)
            return df.groupBy(*pair).agg(w.alias("weight")).select("source", "target", F.lit(relation).alias("relation"), "weight")
        return df.select(*pair, F.lit(relation).alias("relation"), F.lit(1.0).alias("weight"))

    parts = [
        rows("nation", "n:n_nationkey", "r:n_regionkey", "in_region"),
        rows("customer", "c:c_custkey", "n:c_nationkey", "in_nation"),
        rows("supplier", "s:s_suppkey", "n:s_nationkey", "based_in"),
        rows("orders", "o:o_orderkey", "c:o_custkey", "placed_by"),
        rows("lineitem", "o:l_orderkey", "p:l_partkey", "contains", "l_quantity"),
        rows("lineitem", "s:l_suppkey", "p:l_partkey", "supplies"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("seq", F.col("target"))


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The business edges as a stored table: loops read it once a hop instead of building it again."""
    return materialise(business_edges(spark, sf_dir).withColumn("weight", F.col("weight").cast("float")), "edges")


KNN = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
k AS (SELECT a.id AS source, b.id AS target, round(list_cosine_similarity(a.v, b.v), 12) AS score FROM v a JOIN v b ON a.id <> b.id),
knn AS (SELECT source, target, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM k QUALIFY rank <= 3)"""


def knn_edges(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    best = vector.batched_top_k(e, e, k, "vec_id", skip_self=True)
    return best.select(F.col("query_id").alias("source"), F.col("id").alias("target"), F.lit("near").alias("relation"), F.col("score").cast("double").alias("weight"), F.col("rank").cast("bigint").alias("seq"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


# ---- vector search -----------------------------------------------------------------------------


@query("vec_topk_exact", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 5) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v) DESC, vec_id LIMIT 10")
def vec_topk_exact(spark, sf_dir):
    return vector.top_k(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, "vec_id").select("id", F.round("score", 5).alias("score"))


@query("knn_graph", f"WITH {KNN} SELECT source, target, CAST(rank AS BIGINT) AS rank, round(score, 5) AS score FROM knn")
def knn_graph(spark, sf_dir):
    return knn_edges(spark, sf_dir).select("source", "target", F.col("seq").alias("rank"), F.round("weight", 5).alias("score"))


@query("vec_topk_batched", "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.v, v.v), 12) AS score FROM v q JOIN v ON q.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 5) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10")
def vec_topk_batched(spark, sf_dir):
    """Queries: every vector whose id is divisible by 50, against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return vector.batched_top_k(e, e.where("vec_id % 50 = 0"), 10, "vec_id").select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("vec_topk_tenant_postfilter", f"WITH {NODES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0), t AS (SELECT n.id, n.tenant, list_cosine_similarity(n.v, q.qv) AS score FROM n, q ORDER BY score DESC, id LIMIT 20) SELECT id, round(score, 5) AS score FROM t WHERE tenant = '{TENANT}'")
def vec_topk_tenant_postfilter(spark, sf_dir):
    """The tenant filter comes after the cut."""
    nodes = hybrid_nodes(spark, sf_dir)
    hits = vector.top_k(nodes, first_vector(spark, sf_dir), 20)
    own = nodes.where(filters.belongs_to_tenant(TENANT)).select("id")
    return hits.join(own, "id", "left_semi").select("id", F.round("score", 5).alias("score"))


@query("session_overlay_topk", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS score FROM embeddings, q), b AS (SELECT id, score FROM s WHERE label <> 1 ORDER BY score DESC, id LIMIT 10), u AS (SELECT * FROM b UNION ALL SELECT id, score FROM s WHERE label = 1) SELECT id, round(max(score), 5) AS score FROM u GROUP BY id ORDER BY max(score) DESC, id LIMIT 10")
def session_overlay_topk(spark, sf_dir):
    """Label 1 plays the session's nodes: all of them compete with the ten best of the rest."""
    e, q = table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir)
    base = vector.top_k(e.where("label <> 1"), q, 10, "vec_id")
    mine = e.where("label = 1").select(F.col("vec_id").alias("id"), vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])).alias("score"))
    return vector.overlay_top_k(base, mine, 10).select("id", F.round("score", 5).alias("score"))


@query("vector_upsert", "WITH w AS (SELECT user_id AS id, max(event_id) AS seq FROM events WHERE event_type IN ('click', 'error') GROUP BY 1) SELECT w.id, round(e.value, 4) AS first_dim FROM w JOIN events e ON e.event_id = w.seq WHERE e.event_type = 'click'")
def vector_upsert(spark, sf_dir):
    """Clicks write a vector, errors an empty one; the last write counts."""
    ev = table(spark, sf_dir, "events").where("event_type in ('click', 'error')")
    vec = F.when(F.col("event_type") == "click", F.array("value")).otherwise(F.array().cast("array<double>"))
    out = vector.upsert_vectors(ev.select(F.col("user_id").alias("id"), vec.alias("embedding"), F.col("event_id").alias("seq")))
    return out.select("id", F.round(F.col("embedding")[0], 4).alias("first_dim"))


@query("vec_topk_approx")
def vec_topk_approx(spark, sf_dir):
    """The same queries as vec_topk_batched over an index of clusters; its recall is vec_approx_recall."""
    e = table(spark, sf_dir, "embeddings")
    found = ann.ClusterIndex.build(e, "vec_id").search(e.where("vec_id % 50 = 0"), 10, "vec_id")
    return found.select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("vec_approx_recall", "SELECT true AS reached")
def vec_approx_recall(spark, sf_dir):
    """Whether the approximate search finds nine of ten exact neighbours."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    exact = vector.batched_top_k(e, asked, 10, "vec_id")
    return ann.recall(ann.ClusterIndex.build(e, "vec_id").search(asked, 10, "vec_id"), exact).select((F.col("recall") >= 0.9).alias("reached"))


# ---- graph traversal ---------------------------------------------------------------------------

START = 3 * BILLION + 1


@query("graph_neighbors", f"WITH {EDGES} SELECT target, relation, weight FROM e WHERE source = {5 * BILLION + 1}")
def graph_neighbors(spark, sf_dir):
    return traverse.neighbors(business_edges(spark, sf_dir), 5 * BILLION + 1)


def _reach(depth: int) -> str:
    return f"WITH RECURSIVE {EDGES}, r AS (SELECT {4 * BILLION + 1}::BIGINT AS id, 0 AS hop UNION SELECT e.target, r.hop + 1 FROM r JOIN e ON e.source = r.id WHERE r.hop < {depth}) SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM r WHERE id <> {4 * BILLION + 1} GROUP BY id"


@query("graph_expand_2hop", _reach(2))
def graph_expand_2hop(spark, sf_dir):
    return traverse.expand(edge_table(spark, sf_dir), 4 * BILLION + 1, 2)


@query("graph_expand_n", "WITH RECURSIVE " + KNN + ", r AS (SELECT 0::BIGINT AS id, 0 AS hop UNION SELECT knn.target, r.hop + 1 FROM r JOIN knn ON knn.source = r.id WHERE r.hop < 5) SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM r WHERE id <> 0 GROUP BY id")
def graph_expand_n(spark, sf_dir):
    return traverse.expand(materialise(knn_edges(spark, sf_dir), "knn"), 0, 5)


def _bfs(condition: str = "true") -> str:
    return f"""RECURSIVE {EDGES}, p AS (
  SELECT {5 * BILLION + 1}::BIGINT AS node, 0 AS hop, [{5 * BILLION + 1}::BIGINT] AS path
  UNION ALL SELECT e.target, p.hop + 1, list_append(p.path, e.target) FROM p JOIN e ON e.source = p.node WHERE {condition} AND p.hop < 3 AND NOT list_contains(p.path, e.target)),
first AS (SELECT node, hop, path, row_number() OVER (PARTITION BY node ORDER BY hop, path) AS n FROM p)"""


@query("bfs_paths", f"WITH {_bfs()} SELECT node AS target, hop, array_to_string(path, '>') AS path FROM first WHERE n = 1 AND hop > 0")
def bfs_paths(spark, sf_dir):
    """Order 1 to its customer, nation, region and parts; equal paths go by the order of edges (their target)."""
    anchors = spark.createDataFrame([(5 * BILLION + 1, 0)], "id bigint, rank int")
    walk = traverse.traverse(edge_table(spark, sf_dir), anchors, 3)
    return walk.paths.select("target", "hop", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("bfs_relation_filtered", "WITH " + _bfs("e.relation IN ('placed_by', 'in_nation')") + " SELECT node AS target, hop FROM first WHERE n = 1 AND hop > 0")
def bfs_relation_filtered(spark, sf_dir):
    anchors = spark.createDataFrame([(5 * BILLION + 1, 0)], "id bigint, rank int")
    return traverse.traverse(edge_table(spark, sf_dir), anchors, 3, ["placed_by", "in_nation"]).paths.select("target", "hop")


@query("relation_exclusions", f"WITH RECURSIVE {EDGES}, p AS (SELECT {5 * BILLION + 1}::BIGINT AS node, 0 AS hop UNION SELECT e.target, p.hop + 1 FROM p JOIN e ON e.source = p.node WHERE e.relation = 'placed_by' AND p.hop < 3) SELECT DISTINCT 'relation_filtered:' || e.relation AS reason FROM p JOIN e ON e.source = p.node WHERE p.hop < 3 AND e.relation <> 'placed_by'")
def relation_exclusions(spark, sf_dir):
    anchors = spark.createDataFrame([(5 * BILLION + 1, 0)], "id bigint, rank int")
    pruned = traverse.traverse(edge_table(spark, sf_dir), anchors, 3, ["placed_by"]).pruned
    return pruned.select(F.concat(F.lit("relation_filtered:"), F.col("relation")).alias("reason"))


@query("min_hop_multi_anchor", "WITH RECURSIVE " + KNN + ", a(anchor, ord) AS (VALUES (0::BIGINT, 0), (1::BIGINT, 1), (2::BIGINT, 2)), r AS (SELECT anchor, anchor AS id, 0 AS hop FROM a UNION SELECT r.anchor, knn.target, r.hop + 1 FROM r JOIN knn ON knn.source = r.id WHERE r.hop < 3), m AS (SELECT anchor, id, min(hop) AS hop FROM r GROUP BY ALL), own AS (SELECT m.id, min(CASE WHEN m.anchor <> m.id THEN m.hop END) AS other, bool_or(m.anchor <> m.id AND a.ord < o.ord) AS early, bool_or(o.ord IS NOT NULL) AS is_anchor FROM m JOIN a USING (anchor) LEFT JOIN a o ON o.anchor = m.id GROUP BY m.id) SELECT id, CAST(CASE WHEN is_anchor AND NOT coalesce(early, false) THEN 0 ELSE other END AS INTEGER) AS hop FROM own")
def min_hop_multi_anchor(spark, sf_dir):
    """Three anchors in order: one that an earlier anchor has reached keeps the least hop over the others."""
    anchors = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "id bigint, rank int")
    return traverse.traverse(materialise(knn_edges(spark, sf_dir), "knn"), anchors, 3).hops


@query("induced_edges", "WITH " + KNN + " SELECT source, target FROM knn WHERE source % 3 = 0 AND target % 3 = 0")
def induced_edges(spark, sf_dir):
    edges = knn_edges(spark, sf_dir)
    chosen = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"))
    return traverse.induced_edges(edges, chosen).select("source", "target")


@query("edge_upsert", "SELECT user_id AS source, event_type AS relation, max(event_id) AS seq, round(arg_max(value, event_id), 4) AS weight FROM events GROUP BY ALL")
def edge_upsert(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    writes = ev.select(F.col("user_id").alias("source"), F.lit(0).alias("target"), F.col("event_type").alias("relation"), F.col("value").alias("weight"), F.col("event_id").alias("seq"))
    return traverse.upsert_edges(writes).select("source", "relation", "seq", F.round("weight", 4).alias("weight"))


@query("node_removal", f"WITH {EDGES} SELECT source, target, relation FROM e WHERE source // {BILLION} <> 2 AND target // {BILLION} <> 2")
def node_removal(spark, sf_dir):
    """All nations go, and with them the edges at either end."""
    gone = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("bigint") + 2 * BILLION).alias("id"))
    return traverse.remove_nodes(business_edges(spark, sf_dir), gone).select("source", "target", "relation")


@query("dangling_edge_violations", "SELECT vec_id AS source, vec_id + 7 AS target, vec_id + 7 AS missing FROM embeddings WHERE vec_id + 7 NOT IN (SELECT vec_id FROM embeddings)")
def dangling_edge_violations(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    edges = e.select(F.col("id").alias("source"), (F.col("id") + 7).alias("target"), F.lit("next").alias("relation"))
    return traverse.dangling(edges, e).select("source", "target", "missing")


@query("session_overlay_neighbors", "SELECT * FROM (SELECT conv_id AS session, turn AS source, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations QUALIFY target IS NOT NULL) UNION ALL SELECT -1, n_nationkey, n_regionkey FROM nation")
def session_overlay_neighbors(spark, sf_dir):
    """next_turn edges of every conversation, the session graph that lies over the base graph of nations in regions."""
    base = table(spark, sf_dir, "nation").select(F.lit(-1).cast("bigint").alias("session"), F.col("n_nationkey").cast("bigint").alias("source"), F.col("n_regionkey").cast("bigint").alias("target"), F.col("n_nationkey").cast("bigint").alias("seq"))
    nxt = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    mine = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("source"), nxt.alias("target")).where("target is not null")
    return session.overlay_edges(base, mine.withColumn("seq", F.col("source"))).select("session", "source", "target")


# ---- filters, ranking, evidence ----------------------------------------------------------------



@query("node_filter_reasons", f"WITH {NODES} SELECT id, CASE WHEN tenant <> '{TENANT}' THEN 'tenant_filtered' WHEN retention <= {NOW} THEN 'retention_expired' WHEN entity_type NOT IN ('en', 'fr') THEN 'entity_type_filtered' WHEN ts NOT BETWEEN '2024-02-01' AND '2024-10-31' THEN 'time_range_filtered' END AS reason FROM n")
def node_filter_reasons(spark, sf_dir):
    reason = filters.exclusion_reason(TENANT, NOW, ["en", "fr"], ("2024-02-01", "2024-10-31"))
    return hybrid_nodes(spark, sf_dir).select("id", reason.alias("reason"))


@query("time_range_filter", f"WITH {NODES} SELECT id FROM n WHERE ts BETWEEN '2024-03-01' AND '2024-03-31'")
def time_range_filter(spark, sf_dir):
    return hybrid_nodes(spark, sf_dir).where(filters.in_time_range("2024-03-01", "2024-03-31")).select("id")


@query("entity_filter", f"WITH {NODES} SELECT id, entity_type FROM n WHERE entity_type IN ('de', 'es')")
def entity_filter(spark, sf_dir):
    return hybrid_nodes(spark, sf_dir).where(filters.has_entity_type(["de", "es"])).select("id", F.col("metadata")["entity_type"].alias("entity_type"))


@query("retention_filter", f"WITH {NODES} SELECT id FROM n WHERE retention <= {NOW}")
def retention_filter(spark, sf_dir):
    return hybrid_nodes(spark, sf_dir).where(filters.retention_expired(NOW)).select("id")


@query("tenant_rows", f"WITH {NODES} SELECT tenant, count(*) AS n FROM n WHERE tenant = '{TENANT}' GROUP BY 1")
def tenant_rows(spark, sf_dir):
    own = hybrid_nodes(spark, sf_dir).where(filters.belongs_to_tenant(TENANT))
    return own.groupBy(F.col("metadata")["tenant"].alias("tenant")).agg(F.count("*").alias("n"))


@query("rank_topk_pruned", "WITH r AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) SELECT id, CAST(CASE WHEN rank <= 25 THEN rank END AS INTEGER) AS rank, rank > 25 AS pruned FROM r")
def rank_topk_pruned(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return rank.ranked(c, 25).select("id", "rank", "pruned")


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))"


@query("tokenize_terms", f"SELECT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark")
def tokenize_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.words("text")).alias("term"))


@query("lexical_similarity", f"WITH t AS (SELECT doc_id AS id, {WORDS.format('text')} AS w, {WORDS.format(repr(QUERY_TEXT))} AS q FROM documents) SELECT id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, q)) / greatest(len(w), len(q))::DOUBLE END, 5) AS score FROM t")
def lexical_similarity(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.round(text.overlap(text.words("text"), text.words(F.lit(QUERY_TEXT))), 5).alias("score"))


@query("jaccard_cache_lookup", f"WITH w AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark), p AS (SELECT a.item_id AS query_id, b.item_id AS entry_id, CASE WHEN a.w = b.w THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE END AS s FROM w a JOIN w b ON a.item_id % 4 = b.item_id % 4), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entry_id) AS n FROM p WHERE s >= 0.6) SELECT query_id, entry_id, round(s, 5) AS similarity FROM r WHERE n = 1")
def jaccard_cache_lookup(spark, sf_dir):
    """Benchmark items ask the cache that the same items fill; the exact key is the id modulo 4."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"), (F.col("item_id") % 4).alias("key"))
    found = cache.cached_matches(b.withColumnRenamed("item_id", "query_id"), b.withColumnRenamed("item_id", "entry_id"), ["key"])
    return found.select("query_id", "entry_id", F.round("similarity", 5).alias("similarity"))


EVIDENCE = f"{NODES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT n.id, n.source, n.data, list_cosine_similarity(n.v, q.qv) AS score FROM n, q), ev AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 30)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty hybrid nodes nearest to vector 0, ranked."""
    nodes = hybrid_nodes(spark, sf_dir)
    hits = vector.top_k(nodes, first_vector(spark, sf_dir), 30)
    top = hits.join(nodes, "id").select("id", "score", "data", F.col("metadata")["source"].alias("source"))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # thirty rows


@query("citations_first_per_source", f"WITH {EVIDENCE} SELECT source, arg_min(id, rank) AS id, CAST(arg_min(strlen(data), rank) AS BIGINT) AS span_end, CAST(min(rank) AS BIGINT) AS rank FROM ev GROUP BY source")
def citations_first_per_source(spark, sf_dir):
    return rank.citations(evidence(spark, sf_dir)).select("source", "id", F.col("span_end").cast("bigint").alias("span_end"), F.col("rank").cast("bigint").alias("rank"))


@query("source_diversity", "SELECT lang, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def source_diversity(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_distinct("source").alias("n_sources"))


@query("groundedness", f"WITH {EVIDENCE} SELECT round(least(greatest(avg(score), 0), 1) * 0.5 + least(count(DISTINCT source) / 3.0, 1) * 0.2 + 0.15 + least(count(*) / 3.0, 1) * 0.15, 5) AS groundedness, count(*) AS n_evidence, count(DISTINCT source) AS n_sources FROM ev")
def groundedness(spark, sf_dir):
    return rank.groundedness(evidence(spark, sf_dir), True).withColumn("groundedness", F.round("groundedness", 5))


@query("answer_top3", f"WITH {EVIDENCE} SELECT string_agg(data, ' | ' ORDER BY rank) AS answer FROM ev WHERE rank <= 3")
def answer_top3(spark, sf_dir):
    return rank.first_texts(evidence(spark, sf_dir))


HYBRID = f"""RECURSIVE {KNN}, {NODES}, q AS (SELECT v AS qv FROM v WHERE id = 0),
a AS (SELECT v.id, list_cosine_similarity(v.v, q.qv) AS score, row_number() OVER (ORDER BY list_cosine_similarity(v.v, q.qv) DESC, v.id) AS ord FROM v, q QUALIFY ord <= 5),
r AS (SELECT id AS anchor, id, 0 AS hop FROM a UNION SELECT r.anchor, knn.target, r.hop + 1 FROM r JOIN knn ON knn.source = r.id WHERE r.hop < 2),
m AS (SELECT anchor, id, min(hop) AS hop FROM r GROUP BY ALL),
h AS (SELECT m.id, min(CASE WHEN m.anchor <> m.id THEN m.hop END) AS other, coalesce(bool_or(m.anchor <> m.id AND x.ord < o.ord), false) AS early, bool_or(o.ord IS NOT NULL) AS is_anchor FROM m JOIN a x ON x.id = m.anchor LEFT JOIN a o ON o.id = m.id GROUP BY m.id),
t AS (SELECT h.id, CASE WHEN is_anchor AND NOT early THEN 0 ELSE other END AS hop, coalesce(a.score, 0) AS anchor_score, {WORDS.format('n.data')} AS w, {WORDS.format(repr(QUERY_TEXT))} AS qw FROM h JOIN n USING (id) LEFT JOIN a USING (id)),
l AS (SELECT id, hop, anchor_score, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, qw)) / greatest(len(w), len(qw))::DOUBLE END AS lex FROM t),
sc AS (SELECT id, hop, greatest(0.8 * anchor_score + 0.2 * lex, lex, 0.01) / (hop + 1) AS score FROM l)"""


@query("hybrid_local_search", f"WITH {HYBRID} SELECT id, CAST(hop AS INTEGER) AS hop, round(score, 5) AS score FROM sc ORDER BY round(sc.score, 9) DESC, id LIMIT 10")
def hybrid_local_search(spark, sf_dir):
    """Anchors nearest to vector 0, two hops over the 3-NN graph, hybrid scores, the best ten."""
    edges = materialise(knn_edges(spark, sf_dir), "knn")
    hits = vector.top_k(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 5, "vec_id").collect()  # five rows
    anchors = spark.createDataFrame([(r.id, i, r.score) for i, r in enumerate(hits)], "id bigint, rank int, anchor_score double")
    walk = traverse.traverse(edges, anchors.select("id", "rank"), 2)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    near = walk.hops.join(anchors.select("id", "anchor_score"), "id", "left").join(docs, "id")
    lexical = text.overlap(text.words("text"), text.words(F.lit(QUERY_TEXT)))
    scored = near.select("id", "hop", F.round(rank.evidence_score(F.coalesce("anchor_score", F.lit(0.0)), lexical, F.col("hop")), 9).alias("score"))
    return rank.ranked(scored, 10).where("not pruned").select("id", "hop", F.round("score", 5).alias("score"))


@query("alias_resolve", "WITH a AS (SELECT n_name AS alias, arg_max(n_nationkey, n_nationkey) AS id FROM (SELECT n_name, n_nationkey FROM nation UNION ALL SELECT 'CANADA', 99) GROUP BY 1) SELECT c_custkey AS customer, CAST(a.id AS BIGINT) AS id FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN a ON a.alias = n_name AND n_regionkey <> 1 OR (a.alias = 'CANADA' AND n_name = 'CANADA')")
def alias_resolve(spark, sf_dir):
    """Customers by their nation's name; one alias is registered again, and names of region 1 are unknown but for it."""
    nation = table(spark, sf_dir, "nation")
    first = nation.where("n_regionkey <> 1").select(F.col("n_name").alias("alias"), F.col("n_nationkey").cast("bigint").alias("id"), F.lit(0).alias("seq"))
    again = spark.createDataFrame([("CANADA", 99, 1)], "alias string, id bigint, seq int")
    names = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer"), F.col("n_name").alias("alias"))
    return lookup.resolve(names, first.unionByName(again)).select("customer", "id")


@query("node_id_listing", "SELECT doc_id AS id FROM documents JOIN embeddings ON doc_id = vec_id UNION SELECT conv_id FROM conversations")
def node_id_listing(spark, sf_dir):
    """Ids of the hybrid nodes and of a session that holds the conversations."""
    return lookup.node_ids(hybrid_nodes(spark, sf_dir), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")))


@query("graph_counts", f"WITH {EDGES} SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM (SELECT source FROM e UNION SELECT target FROM e)) AS nodes")
def graph_counts(spark, sf_dir):
    edges = edge_table(spark, sf_dir)
    return edges.agg(F.count("*").alias("edges")).crossJoin(graph.graph_nodes(edges).agg(F.count("*").alias("nodes")))  # one row each


# ---- whole-graph analytics ---------------------------------------------------------------------


@query("degree_stats", f"WITH {EDGES}, b AS (SELECT source AS u, target AS v, weight AS w FROM e UNION ALL SELECT target, source, weight FROM e) SELECT u AS id, sum(w) AS degree, count(DISTINCT v) AS neighbours FROM b GROUP BY u")
def degree_stats(spark, sf_dir):
    return graph.degrees(business_edges(spark, sf_dir))


@query("undirected_weights", "WITH " + KNN + ", b AS (SELECT source AS u, target AS v, score AS w FROM knn UNION ALL SELECT target, source, score FROM knn) SELECT u, v, round(sum(w), 5) AS w FROM b GROUP BY u, v")
def undirected_weights(spark, sf_dir):
    return graph.undirected(knn_edges(spark, sf_dir)).select("u", "v", F.round("w", 5).alias("w"))


def _pagerank_sql(rounds: int) -> str:
    parts = [KNN, "g AS (SELECT source AS id FROM knn UNION SELECT target FROM knn)", "sh AS (SELECT source, target, score / sum(score) OVER (PARTITION BY source) AS share FROM knn)", "c AS (SELECT count(*) AS n FROM g)", "r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM g, c)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT g.id, 0.15 / n + 0.85 * (coalesce(f.x, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT source FROM sh)) / n) AS rank FROM g CROSS JOIN c LEFT JOIN (SELECT target AS id, sum(rank * share) AS x FROM r{i} JOIN sh ON sh.source = r{i}.id GROUP BY target) f USING (id))")
    return "WITH " + ", ".join(parts) + f" SELECT id, round(rank, 7) AS rank FROM r{rounds}"


@query("pagerank_k_iters", _pagerank_sql(10))
def pagerank_k_iters(spark, sf_dir):
    return graph.pagerank(materialise(knn_edges(spark, sf_dir), "knn"), 10).select("id", F.round("rank", 7).alias("rank"))


@query("top10pct_nodes", f"WITH {EDGES}, d AS (SELECT id, sum(w) AS degree FROM (SELECT source AS id, weight AS w FROM e UNION ALL SELECT target, weight FROM e) GROUP BY id), r AS (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) AS n, count(*) OVER () AS c FROM d) SELECT id, degree FROM r WHERE n <= ceil(c * 0.1)")
def top10pct_nodes(spark, sf_dir):
    d = materialise(graph.degrees(business_edges(spark, sf_dir)).select("id", F.col("degree").alias("rank")), "degree")
    return graph.top_share(d).select("id", F.col("rank").alias("degree"))


@query("connected_components", "WITH RECURSIVE " + KNN + ", b AS (SELECT source AS u, target AS v FROM knn UNION SELECT target, source FROM knn), r AS (SELECT DISTINCT u AS id, u AS c FROM b UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.id) SELECT id, min(c) AS component FROM r GROUP BY id")
def connected_components(spark, sf_dir):
    return graph.connected_components(materialise(knn_edges(spark, sf_dir), "knn"))


@query("super_graph", "WITH " + KNN + " SELECT s.label AS source, t.label AS target, round(sum(score), 5) AS weight FROM knn JOIN v s ON s.id = source JOIN v t ON t.id = target WHERE s.label <> t.label GROUP BY ALL")
def super_graph(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("community"))
    return graph.super_graph(knn_edges(spark, sf_dir), labels).select("source", "target", F.round("weight", 5).alias("weight"))


def label_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as level-0 communities; ids divisible by 10 as top nodes."""
    e = table(spark, sf_dir, "embeddings")
    levels = e.groupBy(F.lit(0).alias("level"), F.col("label").alias("community_id")).agg(F.array_sort(F.collect_list("vec_id")).alias("node_ids"))
    return graph.summaries(levels, e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("id")))


SUMMARY = "s AS (SELECT label AS community_id, count(*) AS n, coalesce(list_sort(list(vec_id) FILTER (vec_id % 10 = 0)), [min(vec_id)]) AS top FROM embeddings GROUP BY label), y AS (SELECT community_id, top, 'L0-C' || community_id || ': ' || n || ' nodes, key [' || array_to_string(top, ', ') || ']' AS summary FROM s)"


@query("community_topnodes", f"WITH {SUMMARY} SELECT community_id, array_to_string(top, ',') AS top_nodes, summary FROM y")
def community_topnodes(spark, sf_dir):
    return label_summaries(spark, sf_dir).select("community_id", F.array_join(F.col("top_nodes").cast("array<string>"), ",").alias("top_nodes"), "summary")


@query("community_summary_rank", f"WITH {SUMMARY}, w AS (SELECT community_id, {WORDS.format('summary')} AS w, {WORDS.format(repr('nodes 10 20 30 key c3'))} AS q FROM y) SELECT community_id, round(len(list_intersect(w, q)) / greatest(len(w), len(q))::DOUBLE, 5) AS score FROM w")
def community_summary_rank(spark, sf_dir):
    return graph.rank_summaries("nodes 10 20 30 key c3", label_summaries(spark, sf_dir)).select("community_id", F.round("score", 5).alias("score"))


@query("global_node_ids", "WITH x AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings) SELECT vec_id AS id, CAST(row_number() OVER (ORDER BY label, pos) AS BIGINT) AS place FROM x WHERE label < 3")
def global_node_ids(spark, sf_dir):
    """Nodes of the first three communities, each once, in order of community and place."""
    e = table(spark, sf_dir, "embeddings").where("label < 3")
    sets = e.groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("node_ids"))
    first = sets.select("label", F.posexplode("node_ids")).groupBy(F.col("col").alias("id")).agg(F.min(F.struct("label", "pos")).alias("at"))
    flat = first.select("id", F.col("at.label").alias("label"), F.col("at.pos").alias("pos"))
    return running(flat, ["label", "pos"], None, "place").select("id", (F.col("place") + 1).alias("place"))


@query("leiden_communities")
def leiden_communities(spark, sf_dir):
    """Order-dependent local moves: held against a sequential version in the tests."""
    return graph.communities(materialise(knn_edges(spark, sf_dir), "knn"))


@query("community_hierarchy")
def community_hierarchy(spark, sf_dir):
    return graph.hierarchy(materialise(knn_edges(spark, sf_dir), "knn"), 3).select("level", "community_id", F.explode("node_ids").alias("id"))


# ---- change log, snapshots, idempotency ----------------------------------------------------------


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of user nodes: an error deletes, everything else puts."""
    ev = table(spark, sf_dir, "events")
    node = F.struct(F.col("user_id").alias("id"), F.array().cast("array<float>").alias("embedding"), F.col("event_type").alias("data"), F.create_map(F.lit("value"), F.col("event_id").cast("string")).alias("metadata"))
    is_put = F.col("event_type") != "error"
    edge = F.lit(None).cast("struct<source:bigint,target:bigint,relation:string,weight:float,metadata:map<string,string>>")
    idem = F.when(F.col("event_type") == "signup", F.struct(F.col("user_id").cast("string").alias("key"), F.array("event_id").alias("ids")))
    return ev.select(F.col("event_id").alias("lsn"), F.lit(0).alias("op_idx"), F.when(is_put, "put").otherwise("delete").alias("op"), F.when(is_put, node).alias("node"), edge.alias("edge"), F.when(~is_put, F.col("user_id")).alias("node_id"), idem.alias("idem"))


@query("changelog_latest_state", "SELECT user_id AS id, arg_max(event_type, event_id) AS data, max(event_id) AS written FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def changelog_latest_state(spark, sf_dir):
    nodes, _ = changelog.state_at(event_log(spark, sf_dir))
    return nodes.select("id", "data", F.col("metadata")["value"].cast("bigint").alias("written"))


@query("state_as_of_lsn", "SELECT user_id AS id, arg_max(event_type, event_id) AS data FROM events WHERE event_id <= 500 GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def state_as_of_lsn(spark, sf_dir):
    return changelog.state_at(event_log(spark, sf_dir), 500)[0].select("id", "data")


@query("edge_state_after_deletes", "WITH w AS (SELECT user_id AS s, (user_id * 7 + 1) % 50 AS t, max(event_id) AS put FROM events WHERE event_type = 'view' GROUP BY 1, 2), d AS (SELECT user_id AS id, max(event_id) AS gone FROM events WHERE event_type = 'error' GROUP BY 1) SELECT s AS source, t AS target, put AS lsn FROM w LEFT JOIN d a ON a.id = s LEFT JOIN d b ON b.id = t WHERE put > coalesce(a.gone, -1) AND put > coalesce(b.gone, -1)")
def edge_state_after_deletes(spark, sf_dir):
    """Views put an edge, errors delete a node with its edges."""
    ev = table(spark, sf_dir, "events").where("event_type in ('view', 'error')")
    edge = F.when(F.col("event_type") == "view", F.struct(F.col("user_id").alias("source"), ((F.col("user_id") * 7 + 1) % 50).alias("target"), F.lit("viewed").alias("relation"), F.lit(1.0).cast("float").alias("weight"), F.create_map().cast("map<string,string>").alias("metadata")))
    node = F.lit(None).cast("struct<id:bigint,embedding:array<float>,data:string,metadata:map<string,string>>")
    log = ev.select(F.col("event_id").alias("lsn"), F.lit(0).alias("op_idx"), F.when(F.col("event_type") == "view", "put_edge").otherwise("delete").alias("op"), node.alias("node"), edge.alias("edge"), F.when(F.col("event_type") == "error", F.col("user_id")).alias("node_id"))
    _, edges = changelog.state_at(log)
    return edges.select("source", "target", F.shiftright("seq", 31).alias("lsn"))


@query("catalog_as_of", "WITH d AS (SELECT CAST(ts AS DATE) AS day, max(event_id) AS lsn, epoch_ms(max(ts)) AS at FROM events GROUP BY 1), t AS (SELECT event_id, epoch_ms(ts) AS at FROM events WHERE event_type = 'purchase'), j AS (SELECT t.event_id, max(d.at) AS seen FROM t LEFT JOIN d ON d.at <= t.at GROUP BY 1) SELECT j.event_id, 'wal-lsn-' || max(d.lsn) AS snapshot_id FROM j LEFT JOIN d ON d.at = j.seen GROUP BY 1")
def catalog_as_of(spark, sf_dir):
    """Each purchase with the last daily snapshot made at or before it."""
    ev = table(spark, sf_dir, "events")
    days = ev.groupBy(F.to_date("ts").alias("day")).agg(F.max("event_id").alias("lsn"), F.unix_millis(F.max("ts").cast("timestamp")).alias("created_at_ms"))
    snapshots = days.select(F.concat(F.lit("wal-lsn-"), F.col("lsn").cast("string")).alias("snapshot_id"), "created_at_ms")
    asked = ev.where("event_type = 'purchase'").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return changelog.as_of_join(asked, snapshots, "at", "created_at_ms", ["snapshot_id"]).select("event_id", "snapshot_id")


@query("as_of_per_key", "WITH p AS (SELECT event_id, user_id FROM events WHERE event_type = 'purchase') SELECT p.event_id, p.user_id, max(v.event_id) AS last_view FROM p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.event_id <= p.event_id GROUP BY ALL")
def as_of_per_key(spark, sf_dir):
    """Each purchase with the user's last view before it."""
    ev = table(spark, sf_dir, "events")
    views = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("last_view"))
    asked = ev.where("event_type = 'purchase'").select("event_id", "user_id")
    return changelog.as_of_join(asked, views, "event_id", "at", ["last_view"], "user_id")


@query("idempotency_first_write", "SELECT CAST(user_id AS VARCHAR) AS key, min(event_id) AS lsn FROM events WHERE event_type = 'signup' GROUP BY 1")
def idempotency_first_write(spark, sf_dir):
    log = event_log(spark, sf_dir).where("idem is not null").withColumn("op", F.lit("idempotency"))
    return changelog.first_writes(log).select("key", "lsn")


@query("snapshot_names", "SELECT event_id AS lsn, 'wal-lsn-' || event_id AS snapshot_id FROM events")
def snapshot_names(spark, sf_dir):
    names = changelog.catalog(event_log(spark, sf_dir))
    return names.select(text.snapshot_lsn("snapshot_id").alias("lsn"), "snapshot_id")


# ---- hashes, text, ingestion -------------------------------------------------------------------


@query("content_hash", "SELECT doc_id, sha256('text' || text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.request_hash(F.lit("text"), F.col("text")).alias("content_hash"))




def _u64(digest: str) -> str:
    """The first eight bytes of a hex digest, least byte first, as a signed number."""
    parts = " || ".join(f"substr({digest}, {2 * i + 1}, 2)" for i in range(7, -1, -1))
    unsigned = f"CAST('0x' || {parts} AS UBIGINT)"
    return f"CAST(CASE WHEN {unsigned} >= 9223372036854775808 THEN CAST({unsigned} AS HUGEINT) - 18446744073709551616 ELSE CAST({unsigned} AS HUGEINT) END AS BIGINT)"


@query("entity_id_u64", f"WITH h AS (SELECT DISTINCT source AS name, sha256(source) AS d FROM documents) SELECT name, {_u64('d')} AS id FROM h")
def entity_id_u64(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct().select("name", ids.entity_id(F.col("name")).alias("id"))


@query("chunk_id_u64", f"WITH h AS (SELECT doc_id, sha256(encode(sha256('text' || text)) || unhex('0300000000000000')) AS d FROM documents) SELECT doc_id, {_u64('d')} AS id FROM h")
def chunk_id_u64(spark, sf_dir):
    """The id that the fourth chunk (index 3) of each document would have."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", ids.chunk_id(ids.request_hash(F.lit("text"), F.col("text")), F.lit(3)).alias("id"))


@query("deterministic_embedding", "WITH h AS (SELECT item_id, sha256('embedding-default-v1' || text) AS d FROM benchmark), i AS (SELECT item_id, d, unnest(range(40)) AS i FROM h) SELECT item_id, i AS dim, round(CAST('0x' || substr(d, CAST((i % 32) * 2 + 1 AS INTEGER), 2) AS INTEGER) / 127.5 - 1, 5) AS value FROM i")
def deterministic_embedding(spark, sf_dir):
    e = ids.deterministic_embedding(F.lit("embedding-default-v1"), F.col("text"), 40)
    each = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(e).alias("dim", "value"))
    return each.select("item_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 5).alias("value"))


@query("mask_pii", "SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), lambda t: CASE WHEN contains(t, '@') AND contains(t, '.') THEN '[EMAIL]' WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) >= 7 THEN '[PHONE]' ELSE t END), ' ') AS masked FROM documents")
def mask_pii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.mask_personal("text").alias("masked"))


@query("forbidden_words", "SELECT doc_id, CASE WHEN contains(lower(text), 'moron') THEN 'Moron' WHEN contains(lower(text), 'stupid') THEN 'stupid' END AS word FROM documents WHERE contains(lower(text), 'moron') OR contains(lower(text), 'stupid')")
def forbidden_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.forbidden_word("text", ["Moron", "stupid"]).alias("word"))
    return d.where("word is not null")


WORDS_IN = [("stion", "Stem", 0.9), ("Heit", "Ending", 0.8), ("eaux", "Ending", 0.7)]
_PER_WORD = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS entity, '{lab}' AS label, {c} AS confidence FROM documents WHERE contains(lower(text), lower('{k}'))" for k, lab, c in WORDS_IN)


@query("entity_extract", f"SELECT doc_id, entity, label, round(confidence::DOUBLE, 2) AS confidence FROM ({_PER_WORD})")
def entity_extract(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(ingest.entities(F.col("text"), WORDS_IN)).alias("e"))
    return each.select("doc_id", F.col("e.text").alias("entity"), F.col("e.label").alias("label"), F.round(F.col("e.confidence").cast("double"), 2).alias("confidence"))


@query("mentions_edges", f"SELECT doc_id AS source, {_u64('sha256(entity)')} AS target, 'mentions' AS relation FROM ({_PER_WORD})")
def mentions_edges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("data"))
    return ingest.mentions(docs, WORDS_IN)[1].select("source", "target", "relation")


@query("content_kind", "WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'Text/Plain; charset=utf-8' WHEN 1 THEN 'image/png' WHEN 2 THEN 'AUDIO/ogg' WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'application/octet-stream' WHEN 5 THEN '' END AS mime, CASE page_id % 3 WHEN 0 THEN 'a.b.MD' WHEN 1 THEN 'x.unknown' END AS filename FROM pages) SELECT page_id, CASE WHEN lower(trim(split_part(coalesce(mime, ''), ';', 1))) LIKE 'image/%' THEN 'image' WHEN lower(trim(split_part(coalesce(mime, ''), ';', 1))) LIKE 'audio/%' THEN 'audio' WHEN lower(trim(split_part(coalesce(mime, ''), ';', 1))) = 'text/plain' THEN 'text' WHEN lower(mime) = 'application/pdf' THEN 'pdf' WHEN filename = 'a.b.MD' THEN 'markdown' ELSE 'unsupported' END AS kind FROM p")
def content_kind(spark, sf_dir):
    m, k = F.col("page_id") % 7, F.col("page_id") % 3
    mime = F.when(m == 0, "Text/Plain; charset=utf-8").when(m == 1, "image/png").when(m == 2, "AUDIO/ogg").when(m == 3, "application/pdf").when(m == 4, "application/octet-stream").when(m == 5, "")
    name = F.when(k == 0, "a.b.MD").when(k == 1, "x.unknown")
    return table(spark, sf_dir, "pages").select("page_id", payloads.content_kind(mime, name).alias("kind"))


@query("media_text_merge", "WITH m AS (SELECT doc_id, list_filter([trim(' ' || source), trim(lang), trim(source)], lambda x: x <> '') AS v FROM documents) SELECT doc_id, CASE WHEN len(v) > 0 THEN v[1] || CASE WHEN v[2] <> v[1] THEN chr(10) || v[2] ELSE '' END END AS text FROM m")
def media_text_merge(spark, sf_dir):
    meta = F.create_map(F.lit("ocr_text"), F.concat(F.lit(" "), "source"), F.lit("caption"), "lang", F.lit("description"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", payloads.media_text(meta, payloads.IMAGE_FIELDS).alias("text"))


@query("chunk_overlap", "WITH t AS (SELECT conv_id AS doc, turn AS i, text AS piece, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT doc, i, coalesce(right(before, 100), '') || piece AS content FROM t")
def chunk_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("i"), F.col("text").alias("piece"))
    return ingest.overlapped(c).select("doc", "i", "content")


@query("semantic_chunks")
def semantic_chunks(spark, sf_dir):
    """Our own splitter; its invariants are tested."""
    return ingest.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc", "chunk_index", F.char_length("content").alias("n_chars"))


@query("ingest_documents", "SELECT count(DISTINCT text) AS n_requests FROM documents")
def ingest_documents(spark, sf_dir):
    """Documents without keys: equal texts are one request."""
    d = table(spark, sf_dir, "documents")
    req = d.select(F.col("doc_id").alias("request_id"), F.col("text").alias("content"), F.create_map(F.lit("source"), "source").alias("metadata"), F.lit(None).cast("string").alias("idempotency_key"), F.lit(None).cast("string").alias("model_id"))
    none = spark.createDataFrame([], "key string")
    rows, _ = ingest.ingest(req, none, 1, dims=8)
    return rows.where("op = 'idempotency'").agg(F.count("*").alias("n_requests"))


@query("ingest_one_chunk", f"WITH r AS (SELECT doc_id, text, sha256('text' || text) AS h, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE length(trim(text, ' \t\n\x0B\f\r')) BETWEEN 1 AND 1000), d AS (SELECT h, sha256(encode(h) || unhex('0000000000000000')) AS d FROM r WHERE n = 1) SELECT h AS key, 1::BIGINT AS n, {_u64('d')} AS id FROM d")
def ingest_one_chunk(spark, sf_dir):
    """Keys and node ids of the texts that fit one chunk."""
    d = table(spark, sf_dir, "documents").where("length(trim(both ' \t\n\u000b\f\r' from text)) between 1 and 1000")
    req = d.select(F.col("doc_id").alias("request_id"), F.col("text").alias("content"), F.create_map(F.lit("source"), "source").alias("metadata"), F.lit(None).cast("string").alias("idempotency_key"), F.lit(None).cast("string").alias("model_id"))
    rows, _ = ingest.ingest(req, spark.createDataFrame([], "key string"), 1, dims=8)
    return rows.where("op = 'idempotency'").select("idem.key", F.size("idem.ids").cast("bigint").alias("n"), F.element_at("idem.ids", 1).alias("id"))


def _model_sql(words: list) -> str:
    return " UNION ALL ".join(f"SELECT id, '{k}' AS entity, '{lab}' AS label, {c} AS confidence FROM t WHERE contains(lower(x), lower('{k}'))" for k, lab, c in words)


@query("model_entities", "WITH t AS (SELECT event_id AS id, 'Rust ' || event_type || CASE event_id % 4 WHEN 0 THEN ' graph index' WHEN 1 THEN ' AI Database' WHEN 2 THEN ' company acquired' ELSE ' vector query' END AS x FROM events) " + " UNION ALL ".join(f"SELECT '{name}' AS model, id, entity, label, round(confidence::DOUBLE, 2) AS confidence FROM ({_model_sql(words)})" for name, words in (("mock-ner", ingest.MOCK), ("relation-lite", ingest.RELATION_SIGNALS), ("topic-lite", ingest.TOPICS))))
def model_entities(spark, sf_dir):
    """The three extraction models over texts that hold some of their keywords."""
    m = F.col("event_id") % 4
    more = F.when(m == 0, " graph index").when(m == 1, " AI Database").when(m == 2, " company acquired").otherwise(" vector query")
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("Rust "), "event_type", more).alias("x"))
    models, out = ingest.default_models(), None
    for name in ("mock-ner", "relation-lite", "topic-lite"):
        each = t.select(F.lit(name).alias("model"), "id", F.explode(ingest.entities(F.col("x"), models.resolve(name))).alias("e"))
        part = each.select("model", "id", F.col("e.text").alias("entity"), F.col("e.label").alias("label"), F.round(F.col("e.confidence").cast("double"), 2).alias("confidence"))
        out = part if out is None else out.union(part)
    return out


# ---- jobs, metrics, governance, audit ------------------------------------------------------------


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type").isin("signup", "view", "click"), "enqueue").when(F.col("event_type") == "purchase", "complete").otherwise("dead_letter")
    return ev.select((F.col("event_id") % 997).alias("id"), op.alias("op"), (F.col("event_id") % 5).cast("int").alias("attempt"))


JOBS = "j AS (SELECT event_id % 997 AS id, CASE WHEN event_type IN ('signup', 'view', 'click') THEN 'enqueue' WHEN event_type = 'purchase' THEN 'complete' ELSE 'dead_letter' END AS op, CAST(event_id % 5 AS INTEGER) AS attempt FROM events)"


@query("job_pending", f"WITH {JOBS} SELECT id, max(attempt) AS attempt FROM j WHERE op = 'enqueue' AND id NOT IN (SELECT id FROM j WHERE op <> 'enqueue') GROUP BY id")
def job_pending(spark, sf_dir):
    return jobs.pending(job_log(spark, sf_dir))


@query("job_counters", f"WITH {JOBS} SELECT count(DISTINCT CASE WHEN op = 'enqueue' THEN id END) AS enqueued, count(CASE WHEN op = 'enqueue' THEN id END) - count(DISTINCT CASE WHEN op = 'enqueue' THEN id END) AS retried, count(DISTINCT CASE WHEN op = 'complete' THEN id END) AS completed, count(DISTINCT CASE WHEN op = 'dead_letter' THEN id END) AS dead FROM j")
def job_counters(spark, sf_dir):
    return jobs.counters(job_log(spark, sf_dir))


ATTEMPTS = "a AS (SELECT user_id AS id, event_id AS tried, event_type = 'purchase' AS ok FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tried) AS n FROM a)"


@query("dead_letters", f"WITH {ATTEMPTS} SELECT id, 3::BIGINT AS attempts FROM r GROUP BY id HAVING max(n) >= 3 AND coalesce(min(CASE WHEN ok THEN n END), 4) > 3")
def dead_letters(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return jobs.dead_letters(ev.select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), (F.col("event_type") == "purchase").alias("ok")))


@query("dead_letter_cap", "SELECT event_id AS id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def dead_letter_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), "ts")
    return jobs.newest(e, ["ts", "id"], 100).select("id")


@query("latency_percentiles", "WITH l AS (SELECT value AS latency FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000), t AS (SELECT count(*) AS total, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failed, round(avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 5) AS hit_rate FROM events) SELECT t.*, p50, p95, p99 FROM t, (SELECT quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, quantile_disc(latency, 0.99) AS p99 FROM l)")
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("value").alias("latency"), (F.col("event_type") == "click").alias("hit"), F.col("value").alias("confidence"), (F.col("event_type") == "error").alias("failed"))
    return metrics.snapshot(log).select("total", "failed", F.round("hit_rate", 5).alias("hit_rate"), "p50", "p95", "p99")


@query("bench_percentile_index", "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT max(CASE WHEN i = round((n - 1) * 0.5) THEN value END) AS p50, max(CASE WHEN i = round((n - 1) * 0.95) THEN value END) AS p95, max(CASE WHEN i = round((n - 1) * 0.99) THEN value END) AS p99 FROM s")
def bench_percentile_index(spark, sf_dir):
    return metrics.index_percentiles(table(spark, sf_dir, "events"), "value")


@query("latency_split", "SELECT count(*) FILTER (event_type = 'purchase') AS write_n, quantile_disc(value, 0.5) FILTER (event_type = 'purchase') AS write_p50, quantile_disc(value, 0.95) FILTER (event_type = 'purchase') AS write_p95, quantile_disc(value, 0.99) FILTER (event_type = 'purchase') AS write_p99, count(*) FILTER (event_type <> 'purchase') AS read_n, quantile_disc(value, 0.5) FILTER (event_type <> 'purchase') AS read_p50, quantile_disc(value, 0.95) FILTER (event_type <> 'purchase') AS read_p95, quantile_disc(value, 0.99) FILTER (event_type <> 'purchase') AS read_p99 FROM events")
def latency_split(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return metrics.latency_split(e.select((F.col("event_type") == "purchase").alias("is_write"), F.col("value").alias("latency")))


@query("duration_text", "SELECT event_id, CASE WHEN ns < 1000 THEN ns || 'ns' WHEN ns < 1000000 THEN printf('%.2f', ns / 1000.0) || 'us' WHEN ns < 1000000000 THEN printf('%.2f', ns / 1000000.0) || 'ms' ELSE printf('%.2f', ns / 1000000000.0) || 's' END AS text, round(ns / 1000000.0, 6) AS ms FROM (SELECT event_id, event_id * event_id * event_id AS ns FROM events)")
def duration_text(spark, sf_dir):
    """Cubes as whole decimals: those of event ids from 2,097,152 on don't fit a bigint (SQL fails there); up to 2.09e9 the seconds do."""
    i = F.col("event_id").cast("decimal(19,0)")
    e = table(spark, sf_dir, "events").select("event_id", (i * i * i).alias("ns")).select("*", F.col("ns").cast("double").alias("real"))
    return e.select("event_id", metrics.format_ns(F.col("ns"), F.col("real")).alias("text"), metrics.rounded(metrics.to_ms(F.col("real")), 6).alias("ms"))


@query("read_quality", "SELECT count(*) AS reads, round(avg(CASE WHEN event_id % 4 > 0 THEN 1.0 ELSE 0 END), 5) AS evidence_rate, round(avg(CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 4 > 0 THEN 1.0 ELSE 0 END END), 5) AS answer_evidence_rate, round(avg(CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 > 0 THEN 1.0 ELSE 0 END END), 5) AS answer_citation_rate, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END), 5) AS hit_rate FROM events")
def read_quality(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = metrics.read_quality(e.select((F.col("event_type") == "view").alias("is_answer"), (F.col("event_id") % 4).alias("n_evidence"), (F.col("event_id") % 3).alias("n_citations"), (F.col("event_type") == "click").alias("hit"), F.col("value").alias("groundedness")))
    return out.select("reads", *[F.round(c, 5).alias(c) for c in ("evidence_rate", "answer_evidence_rate", "answer_citation_rate", "hit_rate")])


@query("governance_stamp", f"WITH p AS (SELECT n_name AS tenant, CASE n_regionkey WHEN 0 THEN 'eu' ELSE 'us' END AS region_of, n_nationkey + 30 AS days FROM nation WHERE n_nationkey % 2 = 0) SELECT c_custkey AS id, p.region_of AS residency, CAST({NOW} + p.days * 86400 AS BIGINT) AS retention_until, CASE WHEN p.tenant IS NOT NULL AND p.region_of <> 'eu' THEN 'residency_violation' END AS error FROM customer JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN p ON p.tenant = n.n_name")
def governance_stamp(spark, sf_dir):
    """Customers ingest from region eu under their nation's policy; odd nations have none."""
    nation = table(spark, sf_dir, "nation")
    policies = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("tenant"), F.when(F.col("n_regionkey") == 0, "eu").otherwise("us").alias("residency_region"), (F.col("n_nationkey") + 30).alias("retention_days"), F.lit(None).cast("string").alias("kms_key_id"))
    req = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("tenant"), F.lit("eu").alias("region"), F.create_map(F.lit("source"), "c_name").alias("metadata"))
    out = security.governed(req, policies, F.lit(NOW).cast("bigint"))
    return out.select("id", F.col("metadata")["residency_region"].alias("residency"), F.col("metadata")["retention_until_unix"].cast("bigint").alias("retention_until"), "error")


@query("audit_sequence", "SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) + 10 AS BIGINT) AS sequence FROM events WHERE event_type = 'error'")
def audit_sequence(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "ts")
    return audit.sequenced(e, ["ts", "event_id"], 10).select("event_id", F.col("sequence").cast("bigint").alias("sequence"))


@query("encrypted_round_trip", "SELECT doc_id, true AS same, true AS hidden FROM documents")
def encrypted_round_trip(spark, sf_dir):
    c = crypto.Cipher({"k1": b"secret of the demonstration"}, "k1")
    d = table(spark, sf_dir, "documents")
    sealed = materialise(d.select("doc_id", "text", c.encrypt(F.col("text")).alias("sealed")), "sealed")  # once: the nonce is random
    return sealed.select("doc_id", (c.decrypt(F.col("sealed")).cast("string") == F.col("text")).alias("same"), (F.col("sealed") != F.col("text").cast("binary")).alias("hidden"))


# ---- whole requests ------------------------------------------------------------------------------


def engine(spark: SparkSession, sf_dir: str, with_summaries: bool = False) -> Engine:
    nodes = hybrid_nodes(spark, sf_dir)
    edges = materialise(knn_edges(spark, sf_dir).withColumn("weight", F.col("weight").cast("float")).withColumn("metadata", F.create_map().cast("map<string,string>")), "knn")
    return Engine(nodes, edges, label_summaries(spark, sf_dir) if with_summaries else None, now=1_705_000_000)


@query("drift_search")
def drift_search(spark, sf_dir):
    r = request.Request(QUERY_TEXT, search_mode="drift", top_k=10, depth=2)
    return engine(spark, sf_dir).execute(r).state.nodes.select("id", "rank", "hop", F.round("score", 5).alias("score"))


@query("global_search")
def global_search(spark, sf_dir):
    r = request.Request("overall nodes of key 10", search_mode="auto", top_k=10)
    out = engine(spark, sf_dir, True).execute(r)
    return spark.createDataFrame([(out.answer, float(round(out.groundedness, 5)), ",".join(out.plan.steps))], "answer string, groundedness double, steps string")


@query("auto_fallback")
def auto_fallback(spark, sf_dir):
    r = request.Request(QUERY_TEXT, top_k=1, depth=1)
    out = engine(spark, sf_dir).execute(r)
    return out.state.nodes.select("id", "rank", F.lit(out.plan.search_mode).alias("mode"), F.lit(",".join(out.state.notes)).alias("notes"))


@query("job_worker")
def job_worker(spark, sf_dir):
    """Events as a stream of job attempts, run to the end of what is there."""
    from loomgraph.runtime import materialise as written

    ev = table(spark, sf_dir, "events").select((F.col("event_id") % 211).alias("job_id"), (F.col("event_type") == "purchase").alias("ok"), F.col("event_id").alias("at_ms"))
    source = written(ev, "attempts")
    path = source.inputFiles()[0].rsplit("/", 1)[0]
    stream = jobs.worker(spark.readStream.schema(source.schema).parquet(path))
    out = f"{path}-course"
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
