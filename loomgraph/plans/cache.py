"""Semantic cache: answers found again for reworded queries, as a driver cache and as a join."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import jaccard, normalised, words

MIN_SIMILARITY, MAX_ENTRIES, TTL_S, MIN_LENGTH = 0.6, 256, 300.0, 3
_TOKEN = re.compile(r"[^\W]+", re.UNICODE)


@dataclass
class _Entry:
    key: tuple
    text: str
    tokens: frozenset
    value: object
    made: float
    used: float
    hits: int = 0


@dataclass
class SemanticCache:
    """Exact key plus token similarity; expired entries go, then the least recently (lru) or least often (lfu) used."""

    policy: str = "lru"
    capacity: int = MAX_ENTRIES
    ttl: float = TTL_S
    clock: object = time.monotonic
    entries: list[_Entry] = field(default_factory=list)

    @staticmethod
    def _prepare(query: str) -> tuple[str, frozenset]:
        text = " ".join(query.split()).lower()
        return text, frozenset(_TOKEN.findall(text))

    def lookup(self, key: tuple, query: str) -> object | None:
        text, own = self._prepare(query)
        now = self.clock()
        self.entries = [e for e in self.entries if now - e.made < self.ttl]
        best, top = None, 0.0
        for e in self.entries:
            if e.key != key:
                continue
            score = 1.0 if e.text == text else len(own & e.tokens) / len(own | e.tokens) if own | e.tokens else 0.0
            if score >= MIN_SIMILARITY and score > top:
                best, top = e, score
        if best is None:
            return None
        best.used, best.hits = now, best.hits + 1
        return best.value

    def insert(self, key: tuple, query: str, value: object) -> bool:
        if len(re.sub(r"\s", "", query)) < MIN_LENGTH or not self.capacity:
            return False
        text, own = self._prepare(query)
        now = self.clock()
        self.entries = [e for e in self.entries if not (e.key == key and e.text == text)]
        while len(self.entries) >= self.capacity:
            self.entries.remove(min(self.entries, key=lambda e: (e.used,) if self.policy == "lru" else (e.hits, e.used)))
        self.entries.append(_Entry(key, text, own, value, now, now))
        return True


def cached_matches(queries: DataFrame, entries: DataFrame, key_cols: list[str]) -> DataFrame:
    """queries(query_id, query, keys) -> (query_id, entry_id, similarity) of the best entry with equal keys and similarity >= 0.6."""
    q = queries.select("query_id", *key_cols, normalised("query").alias("q_text"), words("query").alias("q_words"))
    e = entries.select("entry_id", *key_cols, normalised("query").alias("e_text"), words("query").alias("e_words"))
    score = F.when(F.col("q_text") == F.col("e_text"), 1.0).otherwise(jaccard(F.col("q_words"), F.col("e_words")))
    # Of n words, a partner at the threshold shares one of the first n - ceil(threshold * n) + 1 in any common order (here by hash).
    first = lambda c: F.expr(f"slice(array_sort(transform({c}, w -> xxhash64(w))), 1, cast(size({c}) - ceil({MIN_SIMILARITY} * size({c})) + 1 as int))")
    met = lambda df, w, t: df.withColumn("met", F.explode(F.array_distinct(F.concat(first(w), F.array(F.xxhash64(t))))))
    near = met(q, "q_words", "q_text").join(met(e, "e_words", "e_text"), [*key_cols, "met"]).select("query_id", "entry_id").distinct()
    pairs = near.join(q, "query_id").join(e.drop(*key_cols), "entry_id").withColumn("similarity", score).where(F.col("similarity") >= MIN_SIMILARITY)
    return pairs.groupBy("query_id").agg(F.max(F.struct("similarity", -F.col("entry_id"))).alias("m")).select("query_id", (-F.col("m.col2")).alias("entry_id"), F.col("m.similarity").alias("similarity"))
