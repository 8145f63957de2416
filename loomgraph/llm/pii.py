"""Bootstrapped contextual extraction of personal data.

The base patterns (email, ip, card, phone) give seed entities. An entity's lexical patterns are the two
words before it, the two after it, and the word on either side; words are compared without case and with
every digit as 0, and what is glued to the entity counts as a word. Spark scores the graph of patterns and
instances for ROUNDS rounds: a pattern's confidence for a kind is the score of the accepted instances it
introduces over all its occurrences in the corpus (whatever fills the slot), provided MIN_SEEDS distinct
seeds support it; an instance scores as its best pattern. Identifier-like tokens (MIN_DIGITS digits or
an @) whose score reaches MIN_CONFIDENCE are accepted: in the next round they are seeds too, so that each
round can support new patterns. To a pattern, an instance scores as the best of its other patterns: what a
pattern found itself doesn't support it. Instances accepted at the end become spans of their kind. Base
spans always stay.

Cases: a null text is empty and has no spans. Texts, words and tokens of any length are used whole. A null
doc_id passes through. Repeated rows are answered each; copies of one seed count as one seed. Masking
replaces overlapping spans by one, of the longest one's kind. Other columns are ignored. An empty table
gives an empty result.

Scale: instances and patterns stay in tables. Pattern occurrences are counted over the whole corpus
behind a bitmap of fixed size that lets through what may be a supported pattern.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import keyed, materialise, text_slices, texts
from loomgraph.llm.shingles import mix, utf8, windows, word_hashes, word_spans
from loomgraph.llm.spans import PERSONAL, Taken, joined, united

KINDS = list(PERSONAL)
ROUNDS = 3
MIN_SEEDS, MIN_CONFIDENCE, MIN_DIGITS = 3, 0.5, 5
BITMAP_BITS = 1 << 22
SURFACE_BLOCK = 200_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}<>\"'=|"
_TAGGED = re.compile(r"[0-9@]")
#: Sides of a pattern.
BEFORE, AFTER, AROUND = 1, 2, 3
_GENERAL = np.arange(256, dtype=np.uint8)
_GENERAL[65:91] += 32
_GENERAL[48:58] = 48

_SCANNED = "doc_id long, row binary, n_email long, n_ip long, n_card long, n_phone long, base string, seen array<struct<kind:string,surface:long,patterns:array<long>,start:long,end:long>>"
_SEEN = pa.list_(pa.struct([("kind", pa.string()), ("surface", pa.int64()), ("patterns", pa.list_(pa.int64())), ("start", pa.int64()), ("end", pa.int64())]))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _word_keys(words: list[str]) -> np.ndarray:
    data = _GENERAL[utf8(" ".join(words))]
    return word_hashes(data, *word_spans(data))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.stack([a, b], axis=1).ravel()
    return windows(both, 2)[::2] if len(both) else both


def _sided(pairs: np.ndarray, side: int) -> np.ndarray:
    """Patterns of one side, so that equal words before, after and around differ."""
    return mix(pairs ^ np.uint64(side))


def _around(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[list[str], list[str]]]:
    """For each span the words before it and after it, nearest first, at most two each.

    A glued prefix or suffix reaches to the word's edge or the next span, so that all of them together are no longer than the text.
    """
    words = [m.span() for m in _WORD.finditer(text)]
    heads, order = [w[0] for w in words], sorted(spans)
    starts, ends = [s for s, _ in order], sorted(e for _, e in spans)
    for s, e in spans:
        i, j = bisect_right(heads, s) - 1, bisect_right(heads, e - 1) - 1
        k, n = bisect_right(ends, s), bisect_left(starts, e)
        prefix = text[max(words[i][0], ends[k - 1] if k else 0) : s]
        suffix = text[e : min(words[j][1], starts[n] if n < len(starts) else len(text))]
        before = [text[slice(*words[x])] for x in range(i - 1, max(i - 3, -1), -1)]
        after = [text[slice(*words[x])] for x in range(j + 1, min(j + 3, len(words)))]
        yield ([prefix] if prefix else []) + before[: 1 if prefix else 2], ([suffix] if suffix else []) + after[: 1 if suffix else 2]


def patterns_of(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """The hashes of each span's patterns: two words before, two after, one on either side; where there are such words."""
    around = list(_around(text, spans))
    every = list({w for pair in around for side in pair for w in side})
    key = dict(zip(every, _word_keys(every), strict=True))
    asked: list[tuple[int, int, np.uint64, np.uint64]] = []
    for n, (before, after) in enumerate(around):
        if len(before) == 2:
            asked.append((n, BEFORE, key[before[1]], key[before[0]]))
        if len(after) == 2:
            asked.append((n, AFTER, key[after[0]], key[after[1]]))
        if before and after:
            asked.append((n, AROUND, key[before[0]], key[after[0]]))
    out: list[list[int]] = [[] for _ in spans]
    for side in (BEFORE, AFTER, AROUND):
        own = [x for x in asked if x[1] == side]
        if own:
            hashes = _sided(_pairs(np.array([x[2] for x in own]), np.array([x[3] for x in own])), side).view(np.int64)
            for (n, *_), h in zip(own, hashes.tolist(), strict=True):
                out[n].append(h)
    return out


def candidates(text: str, base: list) -> list[tuple[int, int]]:
    """Identifier-like tokens apart from the base spans."""
    if not _TAGGED.search(text):
        return []
    found, taken = [], Taken(base)
    for m in _WORD.finditer(text):
        word = m.group()
        if not _TAGGED.search(word):
            continue
        bare = word.strip(_EDGE)
        if "@" in bare or sum(map(bare.count, "0123456789")) >= MIN_DIGITS:
            start = m.start() + word.index(bare)
            if not taken.overlaps(start, start + len(bare)):
                found.append((start, start + len(bare)))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part), strict=True):
                found = {k: f(text) for k, f in PERSONAL.items()}
                base = [s for spans in found.values() for s in spans]
                spans = base + [(s, e, None) for s, e in candidates(text, base)]
                patterns = patterns_of(text, [(s, e) for s, e, _ in spans]) if spans else []
                seen = [{"kind": k, "surface": _hash(text[s:e]), "patterns": p, "start": s, "end": e} for (s, e, k), p in zip(spans, patterns, strict=True)]
                row = hashlib.blake2b(f"{doc_id}:{text}".encode(), digest_size=16).digest()
                rows.append((row, *map(len, found.values()), joined(base, KINDS), seen))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.binary(), *[pa.int64()] * 4, pa.string(), _SEEN)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base", "seen"])


def _occurrences(bitmap: np.ndarray):
    """Counts of the patterns that the bitmap lets through, whatever fills their slot, summed within each slice."""
    shift = np.uint64(64 - (BITMAP_BITS.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                kept = []
                for text in texts(part):
                    data = _GENERAL[utf8(text)]
                    h = word_hashes(data, *word_spans(data))
                    if len(h) > 1:
                        near, apart = windows(h, 2), _pairs(h[:-2], h[2:])
                        for w in (_sided(near, BEFORE), _sided(near, AFTER), _sided(apart, AROUND)):
                            kept.append(w[bitmap[(w >> shift).astype(np.int64)]])
                pairs, n = np.unique(np.concatenate(kept) if kept else np.empty(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(n.astype(np.int64))], ["pattern", "n"])

    return run


def _supported(seeds: DataFrame, open_: DataFrame, scores: DataFrame) -> DataFrame:
    """(pattern, kind, seeds, hits) of the base and the scored instances; an instance scores as the best of its other patterns."""
    other = F.when(F.col("pattern") == F.col("by"), F.coalesce("next", F.lit(0.0))).otherwise(F.col("score"))
    scored = open_.join(scores, "surface").withColumn("score", other).where(F.col("score") >= MIN_CONFIDENCE)
    found = scored.groupBy("pattern", "kind").agg(F.count("*").alias("seeds"), F.sum(F.col("n") * F.col("score")).alias("hits"))
    both = seeds.withColumn("hits", F.col("hits").cast("double")).unionByName(found)
    return both.groupBy("pattern", "kind").agg(F.sum("seeds").alias("seeds"), F.sum("hits").alias("hits"))


def _accepted(base: DataFrame, scanned: DataFrame) -> DataFrame:
    """(surface, kind): the candidates that confident patterns introduce."""
    seen = scanned.select(F.explode("seen").alias("s")).select("s.kind", "s.surface", F.explode("s.patterns").alias("pattern"))
    edges = materialise(seen.groupBy("pattern", "surface", "kind").agg(F.count("*").alias("n")), "pii-edges")
    # Only patterns with a candidate, and with enough surfaces that are or can become seeds, can matter in any round.
    useful = edges.groupBy("pattern").agg(F.count_distinct("surface").alias("surfaces"), F.sum(F.when(F.col("kind").isNull(), 1).otherwise(0)).alias("open")).where(f"surfaces >= {MIN_SEEDS} and open > 0").select("pattern")
    useful = materialise(useful, "pii-patterns")
    shift = BITMAP_BITS.bit_length() - 1
    cells = [r.cell for r in useful.select(F.shiftrightunsigned("pattern", 64 - shift).alias("cell")).distinct().collect()]  # BITMAP_BITS at most
    bitmap = np.zeros(BITMAP_BITS, bool)
    bitmap[cells] = True
    counted = base.mapInArrow(_occurrences(bitmap), "pattern long, n long") if cells else useful.select("pattern", F.lit(0).cast("long").alias("n"))
    total = counted.groupBy("pattern").agg(F.sum("n").alias("total"))
    edges = materialise(edges.join(useful, "pattern").join(total, "pattern", "left"), "pii-graph")
    seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count_distinct("surface").alias("seeds"), F.sum("n").alias("hits"))
    open_ = edges.where("kind is null").select("pattern", "surface", "n")
    totals = edges.groupBy("pattern").agg(F.max(F.coalesce("total", F.lit(0))).alias("total"), F.sum("n").alias("least"))
    totals = totals.select("pattern", F.greatest("total", "least").alias("all"))
    scores = None
    for _ in range(ROUNDS):
        support = seeds if scores is None else _supported(seeds, open_, scores)
        conf = support.where(f"seeds >= {MIN_SEEDS}").join(totals, "pattern").select("pattern", "kind", F.least(F.lit(1.0), F.col("hits") / F.col("all")).alias("conf"))
        pairs = materialise(open_.join(conf, "pattern").select("surface", "kind", "pattern", "conf"), "pii-pairs")
        first = pairs.groupBy("surface", "kind").agg(F.max(F.struct("conf", "pattern")).alias("b")).select("surface", "kind", F.col("b.conf").alias("score"), F.col("b.pattern").alias("by"))
        second = pairs.join(first.select("surface", "kind", "by"), ["surface", "kind"]).where("pattern <> by").groupBy("surface", "kind").agg(F.max("conf").alias("next"))
        scores = materialise(first.join(second, ["surface", "kind"], "left"), "pii-scores")
    best = scores.groupBy("surface").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.where(F.col("b.score") >= MIN_CONFIDENCE).select("surface", F.col("b.kind").alias("kind"))


def _span(kind: Column, start: Column, end: Column) -> Column:
    """Sorts by start, then by the order of kinds."""
    return F.struct(start.alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), kind).alias("order"), kind.alias("kind"), end.alias("end"))


def _masking(surfaces: np.ndarray, kinds: list[str], columns: list[str], text_col: str, size_col: str | None):
    """Replace base spans, and candidates among the (sorted) surfaces, by their kind in brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                out = []
                for text in part.column(text_col).to_pylist():
                    base = [s for f in PERSONAL.values() for s in f(text)] if text else []
                    spans = list(base)
                    for s, e in candidates(text, base) if text and len(surfaces) else []:
                        i = int(np.searchsorted(surfaces, h := _hash(text[s:e])))
                        if i < len(surfaces) and surfaces[i] == h:
                            spans.append((s, e, kinds[i]))
                    done, at = [], 0
                    for s, e, kind in united(spans):
                        done += [text[at:s], f"[{kind.upper()}]"]
                        at = e
                    out.append("".join([*done, text[at:]]) if spans else text)
                new = {text_col: pa.array(out, part.column(text_col).type)}
                if size_col:
                    new[size_col] = pa.array([None if t is None else len(t) for t in out], part.column(size_col).type)
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in columns], columns)

    return run


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """docs with its personal data replaced by [KIND]; size_col, if given, gets the new length.

    The discovered surfaces go out in blocks of SURFACE_BLOCK, one pass each. Passes before the last are
    written, so neither a task nor the driver holds more than a block.
    """
    base = keyed(docs, id_col, text_col)
    accepted = _accepted(base, materialise(base.mapInArrow(_scan, _SCANNED), "pii-scan")).orderBy("surface")
    passes, block = 0, []

    def one_pass(df: DataFrame, rows: list) -> DataFrame:
        surfaces = np.array([r.surface for r in rows], np.int64)
        return df.mapInArrow(_masking(surfaces, [r.kind for r in rows], docs.columns, text_col, size_col), docs.schema)

    for r in accepted.toLocalIterator():
        block.append(r)
        if len(block) == SURFACE_BLOCK:
            docs, block, passes = materialise(one_pass(docs, block), "pii-masked"), [], passes + 1
    return one_pass(docs, block) if block or not passes else docs


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: counts of the base kinds, their digest, and all spans."""
    base = keyed(docs, id_col, text_col)
    scanned = materialise(base.mapInArrow(_scan, _SCANNED), "pii-scan")
    accepted = _accepted(base, scanned)
    found = scanned.select("row", F.explode("seen").alias("s")).where("s.kind is null").select("row", "s.surface", "s.start", "s.end")
    added = found.join(accepted, "surface").groupBy("row").agg(F.collect_set(F.struct("start", F.col("end"), "kind")).alias("added"))
    parts = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: _span(F.split(x, ":")[0], F.split(x, ":")[1].cast("long"), F.split(x, ":")[2].cast("long")))
    merged = F.array_sort(F.concat(parts, F.transform("added", lambda a: _span(a["kind"], a["start"], a["end"]))))
    text = F.array_join(F.transform(merged, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    out = scanned.select("doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base").join(added, "row", "left")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.when(F.col("added").isNull(), F.col("base")).otherwise(text).alias("spans"))

