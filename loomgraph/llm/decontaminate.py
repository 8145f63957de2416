"""Benchmark decontamination by SimHash over item-sized windows.

Words are compared in lower case without ASCII punctuation, in shingles of five. For an item of m
shingles, each document window of m shingles in which enough shingles occur in the benchmark at all
(a necessary condition for the similarity) gets a 128-bit SimHash. BLOCKS blocks of 16 bits index the
items' fingerprints: of two fingerprints within RADIUS bits, one block at least differs in no more than
RADIUS // BLOCKS bits, so probing each block's table at all values so near finds every item within RADIUS
(8 of 100 unrelated pairs share such a block; the whole distance leaves none of them). What is found goes
to the exact similarity: sum of least over sum of greatest shingle weights, a weight being the shingle's
count. At the threshold of 0.8 the expected distance is 19.4 bits with a deviation of 4, so RADIUS misses
2 pairs in 1000 there, and fewer above.

A document with fewer shingles than an item is one window as a whole, if it has enough of them for the
similarity. Even numbers of shingles tie more often (4 of an item's 5: 24 bits expected), so such a
window is looked up within SHORT_RADIUS.

Items shorter than five words have the whole sequence as their one shingle. The benchmark is read in
blocks of at most BLOCK_ITEMS items and BLOCK_CHARS characters (one item at least), one pass over the
documents each, so neither the driver nor a task holds more than a block. A Python worker builds a
block's index once.

Cases: null or blank texts and items match nothing. Null ids match like others and are returned as
null. Repeated rows are reported once per distinct (doc_id, item_id), with the best window, the
first of equals. Texts are used whole. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import keyed, materialise, text_slices, texts
from loomgraph.llm.shingles import mix, utf8, windows, word_hashes, word_spans

RADIUS, BLOCKS = 31, 8
SHORT_RADIUS = 39
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 1 << 26
#: Windows whose neighbours are probed at once.
PROBED = 1024
#: Windows are fingerprinted in runs of at most about so many words.
SPAN = 4096
WIDTH = 5
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_BITS = (_POPCOUNT[:, None] + _POPCOUNT[None, :]).ravel()
_FOUND = "doc_id long, text_hash long, item_id long, similarity double, start_word long, n_words long"


def plain_hashes(text: str) -> np.ndarray:
    data = utf8(text, True)
    data = data[~_PUNCTUATION[data]]
    return word_hashes(data, *word_spans(data))


def simhash_signs(shingles: np.ndarray) -> np.ndarray:
    """(n, 128) of +1 and -1: the bits of two hashes of each shingle."""
    both = np.stack([mix(shingles), mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(shingles), 16), axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """(n, 16) bytes: the signs of the sums."""
    return np.packbits(sums > 0, axis=1)


def near_masks(bits: int) -> np.ndarray:
    """All 16-bit values with at most `bits` bits set."""
    return np.flatnonzero(_BITS <= bits).astype(np.uint16)


_MASKS = {r: near_masks(r // BLOCKS) for r in (RADIUS, SHORT_RADIUS)}


class BlockIndex:
    """Fingerprints in one hash table per block: a block's value -> the items that have it.

    With fewer items than near values, their block values are compared one by one instead, with the same result.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.few = len(prints) < len(_MASKS[RADIUS])
        keys = prints.view(np.uint16)
        if self.few:
            return
        self.order = np.argsort(keys, axis=0, kind="stable").T.copy()
        self.starts = np.stack([np.searchsorted(keys[o, k], np.arange((1 << 16) + 1)) for k, o in enumerate(self.order)]).astype(np.int32)

    def blocked(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (window, item) pairs with a block within radius // BLOCKS bits."""
        keys, n = prints.view(np.uint16), len(self.prints)
        if self.few:
            apart = keys[:, None, :] ^ self.prints.view(np.uint16)[None, :, :]
            return np.nonzero((_BITS[apart] <= radius // BLOCKS).any(axis=2))
        pairs = [np.empty(0, np.int64)]
        for k in range(BLOCKS):
            probed = keys[:, k, None] ^ _MASKS[radius][None, :]
            first, last = self.starts[k][probed], self.starts[k][probed.astype(np.int32) + 1]
            w, j = np.nonzero(first < last)
            lo, size = first[w, j], (last - first)[w, j]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            pairs.append(np.repeat(w, size) * n + self.order[k][place])
        found = np.unique(np.concatenate(pairs))
        return found // n, found % n

    def candidates(self, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within `radius` bits."""
        out = []
        for at in range(0, len(prints), PROBED):
            w, i = self.blocked(prints[at : at + PROBED], radius)
            ok = _POPCOUNT[prints[at + w] ^ self.prints[i]].sum(axis=1) <= radius
            out.append((at + w[ok], i[ok]))
        return np.concatenate([w for w, _ in out]), np.concatenate([i for _, i in out])


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


class Benchmark:
    def __init__(self, items: list[tuple[int | None, str]], threshold: float):
        self.threshold = threshold
        of: dict[int, list] = {}
        for item, text in items:
            h = plain_hashes(text)
            if len(h):
                width = min(WIDTH, len(h))
                of.setdefault(width, []).append((item, windows(h, width)))
        self.known = {w: np.unique(np.concatenate([s for _, s in v])) for w, v in sorted(of.items())}
        self.sized: dict[int, dict[int, list]] = {}
        for w, v in of.items():
            for item, s in v:
                self.sized.setdefault(w, {}).setdefault(len(s), []).append((item, s))
        self.shingles = {(w, m): [(item, np.unique(s, return_counts=True)) for item, s in v] for w, by in self.sized.items() for m, v in by.items()}
        self.index = {(w, m): BlockIndex(np.concatenate([fingerprints(simhash_signs(s).sum(axis=0, keepdims=True)) for _, s in v])) for w, by in self.sized.items() for m, v in by.items()}

    def matches(self, text: str) -> list[tuple[int | None, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item found."""
        h = plain_hashes(text)
        best: dict[int | None, tuple[float, int, int]] = {}
        for width, known in self.known.items():
            if len(h) < width:
                continue
            s = windows(h, width)
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            hits = np.concatenate([[0], np.cumsum(known[at] == s)])
            if not hits[-1]:
                continue
            for m in sorted(self.sized[width]):
                n, least = min(m, len(s)), ceil(self.threshold * m)
                if n < least:
                    continue
                starts = np.flatnonzero(hits[n:] - hits[:-n] >= least)
                for run in np.split(starts, np.flatnonzero((np.diff(starts) > n) | (np.diff(starts // SPAN) > 0)) + 1):
                    for p, b in self._near(s, run, n, width, m):
                        item, own = self.shingles[width, m][b]
                        similarity = weighted_similarity(np.unique(s[p : p + n], return_counts=True), own)
                        if similarity >= self.threshold and similarity > best.get(item, (0.0,))[0]:
                            best[item] = (similarity, p, n + width - 1)
        return [(i, *found) for i, found in best.items()]

    def _near(self, s: np.ndarray, starts: np.ndarray, n: int, width: int, m: int) -> Iterator[tuple[int, int]]:
        """(start, item) pairs of the windows of n shingles whose fingerprints are near those of items of m."""
        if not len(starts):
            return
        lo, hi = int(starts[0]), int(starts[-1]) + n
        sums = np.zeros((hi - lo + 1, 128), np.int32)
        np.cumsum(simhash_signs(s[lo:hi]), axis=0, out=sums[1:])
        window, item = self.index[width, m].candidates(fingerprints(sums[starts + n - lo] - sums[starts - lo]), RADIUS if n == m else SHORT_RADIUS)
        yield from zip(starts[window].tolist(), item.tolist(), strict=True)


#: The index of the block that this Python worker looked up last, by the block's name.
_BUILT: dict[str, Benchmark] = {}


def _built(name: str, items: list, threshold: float) -> Benchmark:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Benchmark(items, threshold)
    return _BUILT[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", by_text: bool = False) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: each document that holds an item, with its best window.

    With by_text, texts of one doc_id are told apart: text_hash names the text.
    """
    base = keyed(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    rows = benchmark.select(benchmark[item_col].cast("long").alias("i"), F.coalesce(benchmark[item_text_col], F.lit("")).alias("t")).toLocalIterator()
    found: list[DataFrame] = []
    block, chars = [], 0

    def one_pass(items: list) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _built(name, items, threshold)
            for batch in batches:
                for part in text_slices(batch):
                    out = [(d, x, *m) for d, x, t in zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), texts(part), strict=True) for m in known.matches(t)]
                    cols = list(zip(*out, strict=True)) if out else [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in _FOUND.split(", ")])

        return base.mapInArrow(run, _FOUND)

    for r in rows:
        if block and (len(block) == BLOCK_ITEMS or chars + len(r.t) > BLOCK_CHARS):
            found.append(materialise(one_pass(block), "leaks"))  # written, so that the plan doesn't keep the block
            block, chars = [], 0
        block.append((r.i, r.t))
        chars += len(r.t)
    found.append(one_pass(block))
    best = F.max_by(F.struct("similarity", "start_word", "n_words"), F.struct("similarity", -F.col("start_word"))).alias("m")
    keys = ["doc_id", "text_hash"] if by_text else ["doc_id"]
    return reduce(DataFrame.union, found).groupBy(*keys, "item_id").agg(best).select(*keys, "item_id", F.round("m.similarity", 6).alias("similarity"), F.col("m.start_word").alias("start_word"), F.col("m.n_words").alias("n_words"))
