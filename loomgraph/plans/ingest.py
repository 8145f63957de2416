"""Ingestion: text to chunks, ids, embeddings and change-log rows; entity extraction to graph rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ids import chunk_hash, chunk_id, deterministic_embedding, entity_id, request_hash
from loomgraph.functions.text import forbidden_word, mask_personal, tail
from loomgraph.operators.numbering import running
from loomgraph.runtime import materialise

MAX_CHARS, OVERLAP, DIMS = 1000, 100, 768

#: Entity dictionaries of the extraction models: (keyword, label, confidence). Fixed values.
MOCK = [("Rust", "Language", 0.9), ("Python", "Language", 0.9), ("AI", "Topic", 0.9), ("Database", "Topic", 0.9), ("Graph", "Concept", 0.9), ("Vector", "Concept", 0.9)]
RELATION_SIGNALS = [("acquired", "RelationSignal", 0.86), ("merged", "RelationSignal", 0.86), ("invested", "RelationSignal", 0.86), ("partnership", "RelationSignal", 0.86), ("company", "EntityHint", 0.82), ("organization", "EntityHint", 0.82), ("startup", "EntityHint", 0.82), ("rust", "TechnicalTopic", 0.8)]
TOPICS = [("graph", "TechnicalTopic", 0.84), ("vector", "TechnicalTopic", 0.84), ("database", "TechnicalTopic", 0.84), ("index", "TechnicalTopic", 0.84), ("query", "TechnicalTopic", 0.84)]

_BREAKS = [re.compile(p) for p in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"\s+")]


def split_text(text: str, limit: int = MAX_CHARS) -> list[str]:
    """Pieces of at most `limit` characters, trimmed: paragraphs, else lines, sentences, words, and characters last; neighbours are packed."""

    def cut(part: str, level: int) -> Iterator[str]:
        if len(part.strip()) <= limit:
            yield part
        elif level == len(_BREAKS):
            yield from (part[i : i + limit] for i in range(0, len(part), limit))
        else:
            at = 0
            for m in _BREAKS[level].finditer(part):
                yield from cut(part[at : m.end()], level + 1)
                at = m.end()
            yield from cut(part[at:], level + 1)

    out, open_ = [], ""
    for piece in cut(text, 0):
        if len((open_ + piece).strip()) > limit:
            out.append(open_.strip())
            open_ = piece
        else:
            open_ += piece
    return [x for x in [*out, open_.strip()] if x]


def split_column(text: Column | str) -> Column:
    """The pieces of a text, by a pandas UDF."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or ""))

    return F.pandas_udf(run, "array<string>")(text)


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, chunk_index, content, n_chunks): pieces, each after the first with the last 100 characters of the one before."""
    pieces = docs.select(F.col(id_col).alias("doc"), split_column(text_col).alias("pieces"))
    each = pieces.select("doc", F.size("pieces").alias("n_chunks"), F.posexplode("pieces").alias("chunk_index", "piece"), F.col("pieces").alias("all"))
    before = F.when(F.col("chunk_index") > 0, tail(F.element_at("all", F.col("chunk_index")), OVERLAP))
    return each.select("doc", "chunk_index", F.concat(F.coalesce(before, F.lit("")), "piece").alias("content"), "n_chunks")


def overlapped(pieces: DataFrame, n: int = OVERLAP) -> DataFrame:
    """(doc, i, piece) -> the same with the tail of the piece before in front."""
    before = F.lag("piece").over(Window.partitionBy("doc").orderBy("i"))
    return pieces.withColumn("content", F.concat(F.coalesce(tail(before, n), F.lit("")), "piece"))


def entities(text: Column, dictionary: list[tuple[str, str, float]]) -> Column:
    """Entries of the dictionary whose keyword is in the text, ignoring case."""
    every = F.array(*[F.struct(F.lit(k).alias("text"), F.lit(label).alias("label"), F.lit(c).cast("float").alias("confidence")) for k, label, c in dictionary])
    return F.filter(every, lambda e: F.contains(F.lower(text), F.lower(e["text"])))


def mentions(nodes: DataFrame, dictionary: list[tuple[str, str, float]]) -> tuple[DataFrame, DataFrame]:
    """(entity nodes, mention edges) of nodes(id, data): an entity's id is its text's hash, an edge weighs its confidence."""
    each = nodes.select("id", F.explode(entities(F.col("data"), dictionary)).alias("e")).select("id", "e.*").withColumn("entity", entity_id(F.col("text")))
    found = each.select(F.col("entity").alias("id"), F.array().cast("array<float>").alias("embedding"), F.col("text").alias("data"), F.create_map(F.lit("type"), F.lit("entity"), F.lit("label"), "label").alias("metadata")).dropDuplicates(["id"])
    edges = each.select(F.col("id").alias("source"), F.col("entity").alias("target"), F.lit("mentions").alias("relation"), F.col("confidence").alias("weight")).distinct()
    return found, edges


@dataclass
class Models:
    """Extraction models by name and version; `name@version` or the active version, with rollback."""

    versions: dict[str, dict[str, list]] = field(default_factory=dict)
    active: dict[str, list[str]] = field(default_factory=dict)
    default: str | None = None

    def register(self, name: str, version: str, dictionary: list, activate: bool = True) -> None:
        self.versions.setdefault(name, {})[version] = dictionary
        if activate:
            self.activate(name, version)

    def activate(self, name: str, version: str) -> None:
        if version not in self.versions.get(name, {}):
            raise KeyError(f"{name}@{version}")
        self.active.setdefault(name, []).append(version)
        self.default = self.default or name

    def rollback(self, name: str) -> str:
        if len(self.active.get(name, [])) < 2:
            raise KeyError(f"{name} has no earlier version")
        self.active[name].pop()
        return self.active[name][-1]

    def resolve(self, reference: str | None) -> list:
        """An unknown model is the default one."""
        name, at, version = (reference or "").partition("@")
        if at and name and version and version in self.versions.get(name, {}):
            return self.versions[name][version]
        name = name if name in self.active else self.default
        return self.versions[name][self.active[name][-1]]


#: A column of texts -> why each is rejected, or null.
ContentPolicy = Callable[[Column], Column]


def default_models() -> Models:
    m = Models()
    for name, words in (("mock-ner", MOCK), ("relation-lite", RELATION_SIGNALS), ("topic-lite", TOPICS)):
        m.register(name, "1", words)
    return m


def ingest(requests: DataFrame, known_keys: DataFrame, lsn: int, forbidden: list[str] = (), mask: bool = False, dims: int = DIMS, model: str = "embedding-default-v1", splitter: Callable = split_column, policies: Sequence[ContentPolicy] = ()) -> tuple[DataFrame, DataFrame]:
    """requests(request_id, content, metadata, idempotency_key, model_id) -> (change rows, rejected).

    Requests whose key (or content hash, without one) is recorded are left out; of equal keys in one batch
    the first request counts. A forbidden word, or a policy that gives a reason, rejects its request.
    """
    keyed = requests.withColumn("content_hash", request_hash(F.lit("text"), F.col("content"))).withColumn("key", F.coalesce("idempotency_key", "content_hash"))
    fresh = keyed.join(known_keys.select("key"), "key", "left_anti")
    first = fresh.groupBy("key").agg(F.min("request_id").alias("request_id"))
    fresh = fresh.join(first, ["key", "request_id"], "left_semi")
    words = [forbidden_word("content", list(forbidden))] if forbidden else []
    word = F.coalesce(*words, *[p(F.col("content")) for p in policies], F.lit(None).cast("string"))
    checked = fresh.withColumn("forbidden", word)
    rejected = checked.where("forbidden is not null").select("request_id", "forbidden")
    ok = checked.where("forbidden is null").withColumn("content", mask_personal("content") if mask else F.col("content"))
    pieces = ok.select("request_id", "key", "content_hash", "metadata", F.coalesce("model_id", F.lit(model)).alias("model_id"), splitter("content").alias("pieces"))
    # Operations are numbered through the transaction: each request's chunks, then its idempotency mark.
    size = pieces.select("key", "request_id", (F.size("pieces") + 1).alias("ops"))
    pieces = materialise(pieces.join(running(size, ["request_id", "key"], "ops", "first_op").select("key", "first_op"), "key"), "pieces")
    each = pieces.select("*", F.posexplode("pieces").alias("i", "piece"))
    before = F.when(F.col("i") > 0, tail(F.element_at("pieces", F.col("i")), OVERLAP))
    each = each.withColumn("text", F.concat(F.coalesce(before, F.lit("")), "piece"))
    stamps = {"content_hash": chunk_hash(F.col("text")), "model_id": F.col("model_id"), "idempotency_key": F.col("key"), "chunk_index": F.col("i").cast("string"), "chunk_chars": F.octet_length("text").cast("string"), "chunk_overlap": F.lit(str(OVERLAP))}
    meta = F.map_concat(F.map_filter("metadata", lambda k, _: ~k.isin(*stamps)), F.create_map(*[x for k, v in stamps.items() for x in (F.lit(k), v)]))
    node = F.struct(chunk_id(F.col("content_hash"), F.col("i")).alias("id"), deterministic_embedding(F.col("model_id"), F.col("text"), dims).alias("embedding"), F.col("text").alias("data"), meta.alias("metadata"))
    puts = each.select(F.lit(lsn).cast("bigint").alias("lsn"), (F.col("first_op") + F.col("i")).cast("int").alias("op_idx"), F.lit("put").alias("op"), node.alias("node"), F.lit(None).cast("struct<source:bigint,target:bigint,relation:string,weight:float,metadata:map<string,string>>").alias("edge"), F.lit(None).cast("bigint").alias("node_id"), F.lit(None).cast("struct<key:string,ids:array<bigint>>").alias("idem"), "key")
    keys = puts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("op_idx", "node.id"))), lambda x: x["id"]).alias("ids"), F.max("op_idx").alias("last"))
    marks = keys.select(F.lit(lsn).cast("bigint").alias("lsn"), (F.col("last") + 1).alias("op_idx"), F.lit("idempotency").alias("op"), F.struct("key", "ids").alias("idem"))
    return puts.drop("key").unionByName(marks, allowMissingColumns=True), rejected
