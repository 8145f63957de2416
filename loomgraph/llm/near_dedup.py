"""MinHash near-duplicate groups with min-max hashing.

64 hash functions give 128 signature values (the minimum and the maximum under each), cut into 25
bands of 5. Two documents at the threshold of 0.85 miss every band with a chance of 5e-7.

Cases: a null or blank text has an empty set, links with nothing and is kept. Equal word sequences
are one text: the least doc_id stands for them. A row whose doc_id is null links with nothing, has
a null component and is kept. Repeated rows with one doc_id get the same answer each. Rows of one doc_id
with different texts are answered by their own text each (text_hash, the xxhash64 of the text, tells them
apart). Texts of any length are used whole. Other columns are ignored. An empty table gives an empty result.

Skew: copies collapse to one node before any bucket exists, and at the end texts of more than HOT rows
(so one for HOT rows at most) find their component by broadcast. In a bucket, members are
compared with the bucket's least member (a star, as many pairs as members). The members of buckets
that still hold more than one component then go through an exact prefix-filter join: a pair at the
threshold must share one of each side's rarest shingles, so a text that only resembles a large group
from below the threshold meets almost none of it. No bucket is capped and no pair within one
component is formed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import keyed, materialise, text_slices, texts
from loomgraph.llm.components import components
from loomgraph.llm.shingles import MinMax, normal_hashes, shingle_set

FUNCTIONS, BANDS, ROWS = 64, 25, 5
SHINGLE_WORDS = 5
#: Ratio of the sizes within one band of partner sizes.
BAND = 1.03
#: Rows from which a text is hot.
HOT = 1_000_000

_SIGNED = "doc_id long, text_hash long, digest binary, n_shingles long, bands array<long>"
_SETS = "node long, shingles binary"


@cache
def _family() -> MinMax:
    return MinMax(FUNCTIONS, BANDS, ROWS)


def _digest(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family = _family()
    for batch in batches:
        for part in text_slices(batch):
            digests, sizes, bands = [], [], []
            for text in texts(part):
                words = normal_hashes(text)
                s = shingle_set(words, SHINGLE_WORDS)
                digests.append(_digest(words))
                sizes.append(len(s))
                bands.append(family.band_keys(s) if len(s) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "text_hash", "digest", "n_shingles", "bands"])


def _node_sets(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(node, shingle set) of the rows whose text is the node's."""
    for node, digest, text in zip(part.column("node").to_pylist(), part.column("digest").to_pylist(), texts(part), strict=True):
        words = normal_hashes(text)
        if _digest(words) == digest:
            yield node, shingle_set(words, SHINGLE_WORDS)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            found = [(node, s.tobytes()) for node, s in _node_sets(part)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["node", "shingles"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of the sets."""
    for batch in batches:
        for part in text_slices(batch, "shingles"):
            found = [np.frombuffer(s.as_buffer(), np.int64) for s in part.column("shingles")]
            nodes = np.repeat(part.column("node").to_numpy(), [len(s) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(found))], ["node", "shingle"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("sx"), batch.column("sy"), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


def _all_sets(rows: DataFrame, nodes: DataFrame, texts_of: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in rows. The texts are met once; nodes(node, rep, digest, text_hash), texts_of(doc_id, text_hash, text)."""
    ids = rows.select("node").distinct()
    wanted = nodes.join(ids, "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "text_hash", "digest")
    sets = texts_of.join(wanted, ["doc_id", "text_hash"]).select("node", "digest", "text").mapInArrow(_sets, _SETS)
    return materialise(sets.dropDuplicates(["node"]), "sets")  # repeated rows give one set


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    x = sets.select(F.col("node").alias("u"), F.col("shingles").alias("sx"))
    y = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sy"))
    both = pairs.join(x, "u").join(y, "v").select("u", "v", "sx", "sy")
    return materialise(both.mapInArrow(_confirm(percent), "u long, v long"), f"{label}-links")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n, centre, centre_n) of the buckets of several nodes; the centre has the least doc_id, most often the original."""
    rows = nodes.select("rep", "node", "n", F.explode("bands").alias("key"))
    # Both min_by see the same rows by the same order, so they tell of one row also where two texts have one doc_id.
    centres = rows.groupBy("key").agg(F.min_by("node", "rep").alias("centre"), F.min_by("n", "rep").alias("centre_n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    return materialise(rows.join(centres.where("lo < hi").drop("lo", "hi"), "key").select("key", "node", "n", "centre", "centre_n"), "buckets")


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """Each member of a bucket against the bucket's centre."""
    fit = f"centre <> node and 100 * least(n, centre_n) >= {percent} * greatest(n, centre_n)"
    return rows.where(fit).select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()


def _with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    at = rows.join(comps.select(F.col("id").alias("node"), F.col("component").alias("c")), "node", "left")
    return at.select("key", "node", "n", F.coalesce("c", "node").alias("component"))


def _prefixes(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each document: as many as a partner at the threshold can't all lack."""
    words = materialise(sets.join(docs, "node", "left_semi").mapInArrow(_tokens, "node long, shingle long"), "tokens")
    often = words.groupBy("shingle").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    size = F.expr(f"n - ceil({percent} * n / 100) + 1")
    return words.join(often, "shingle").withColumn("rank", rank).join(docs, "node").where(F.col("rank") <= size).select("node", "n", "component", "mass", "rank", F.col("shingle").alias("key"))


def _residual(rows: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components, in buckets that hold several, that share a rare shingle."""
    at = _with_components(rows, comps)
    many = at.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi and size > 2").select("key")
    docs = at.join(many, "key", "left_semi").select("node", "n", "component").distinct()
    mass = docs.groupBy("component").agg(F.count("*").alias("mass"))
    docs = materialise(docs.join(mass, "component"), "apart")
    pre = materialise(_prefixes(docs, sets, percent), "prefixes")
    # In each posting list the heaviest component stays on one side only: its own pairs don't arise.
    lists = pre.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.struct("mass", "component")).alias("top")).where("lo < hi").select("key", F.col("top.component").alias("top"))
    pre = pre.join(lists, "key")
    # The first shingle that a linked pair shares is at most at place n + 1 - overlap on either side. A side
    # therefore asks each band of partner sizes only with the shingles early enough for such partners.
    share = percent / (100 + percent)
    band = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND)))
    bands = F.sequence(band(F.col("n") * percent / 100), band(F.col("n") * 100 / percent))
    early = F.filter(bands, lambda b: F.col("rank") <= F.col("n") + 1 - share * (F.col("n") + F.pow(F.lit(BAND), b)) + 0.001)
    x = pre.where("component <> top").select("key", F.explode(early).alias("band"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), F.col("rank").alias("rx"))
    y = pre.select("key", band(F.col("n")).alias("band"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), F.col("rank").alias("ry"), (F.col("component") == F.col("top")).alias("at_top"))
    fit = f"cx <> cy and (at_top or x < y) and 100 * least(nx, ny) >= {percent} * greatest(nx, ny) and (1 + least(nx - rx, ny - ry)) * {100 + percent} >= {percent} * (nx + ny)"
    pairs = x.join(y, ["key", "band"]).where(fit)
    return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every row of docs; links have 100 * intersection >= percent * union."""
    base = keyed(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    signed = materialise(base.mapInArrow(_sign, _SIGNED), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # Equal digests have equal sets, so any of their rows tells n and bands. A node's text is one of rep's.
    nodes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = _buckets(nodes)
    sets = _all_sets(rows, nodes, base.where("doc_id is not null"))
    links = _linked(_stars(rows, percent), sets, percent, "star")
    comps = components(links)
    more = _linked(_residual(rows, comps, sets, percent), sets, percent, "residual")
    stars = comps.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
    comps = components(stars.union(more)).withColumnRenamed("id", "node")

    least = comps.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("least"))
    named = nodes.join(comps.join(least, "component"), "node", "left").select("digest", "rows", F.coalesce("least", "rep").alias("component"))
    named = materialise(named, "named")
    hot, cold = named.where(F.col("rows") > HOT).drop("rows"), named.where(F.col("rows") <= HOT).drop("rows")
    at_hot = some.join(F.broadcast(hot), "digest")  # hot has at most one row for HOT rows of docs
    at_cold = some.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest")
    alone = signed.where("n_shingles = 0 or doc_id is null").withColumn("component", F.col("doc_id"))
    out = at_hot.unionByName(at_cold).unionByName(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"), "text_hash")
