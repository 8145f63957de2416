"""Merge-type (BPE) segmentation: a score-ordered agenda of adjacent symbol pairs.

`Merges.run` takes many symbol sequences at once. Each round pops from every sequence's agenda its
best pair (least rank, leftmost of equals), merges it, and puts the two new neighbour pairs on the
agenda; numpy does a round for all sequences. A long sequence goes through a heap instead, whose cost
is its length times the logarithm of its length.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Sequences of more symbols than this go through the heap.
LONG = 192
_NONE = np.int64(1) << np.int64(60)


class Merges:
    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, symbols: int):
        """Pairs (left, right) of symbol ids below `symbols`, which merge into `merged`; a lower rank goes first."""
        self.symbols = np.int64(symbols)
        key = left.astype(np.int64) * self.symbols + right
        order = np.argsort(key)
        self.key = np.append(key[order], np.int64(2**63 - 1))
        self.rank = np.append(rank[order].astype(np.int64), _NONE)
        self.merged = np.append(merged[order].astype(np.int64), -1)
        self.pairs = dict(zip(key[order].tolist(), zip(rank[order].tolist(), merged[order].tolist(), strict=True), strict=True))
        bits = 22
        # A filter of one bit per hashed key: most pairs that don't merge stop here.
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self._cell(key)] = True

    def _cell(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the table; its last place stands for no pair."""
        key = left * self.symbols + right
        out = np.full(len(key), len(self.key) - 1, np.int64)
        maybe = np.flatnonzero(self.filter[self._cell(key)])
        at = np.searchsorted(self.key, key[maybe])
        hit = self.key[at] == key[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def run(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all sequences, lengths) -> the same after all merges, in the same order."""
        n = len(lengths)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        pieces: list[np.ndarray | None] = []
        owners: list[np.ndarray] = []
        seq = np.repeat(np.arange(n), lengths)
        long = np.flatnonzero(lengths > LONG)
        for i in long:
            done = np.array(self.one(flat[starts[i] : starts[i + 1]].tolist()), np.int64)
            pieces.append(done)
            owners.append(np.full(len(done), i))
        short = lengths[seq] <= LONG if len(long) else slice(None)
        sym, seq = flat[short].astype(np.int64), seq[short]
        place = np.full(len(sym), len(self.key) - 1, np.int64)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        place[inner] = self._find(sym[inner], sym[inner + 1])
        while len(sym):
            rank = self.rank[place]
            heads = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(sym)))
            live = np.repeat(best < _NONE, sizes)
            if not live.all():
                pieces.append(sym[~live])
                owners.append(seq[~live])
                sym, seq, place, rank = sym[live], seq[live], place[live], rank[live]
                sizes, best = sizes[best < _NONE], best[best < _NONE]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            first = np.concatenate([[True], seq[hits[1:]] != seq[hits[:-1]]])
            hits = hits[first]
            sym[hits] = self.merged[place[hits]]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            now = np.cumsum(keep)[hits] - 1
            sym, seq, place = sym[keep], seq[keep], place[keep]
            end = len(self.key) - 1
            for at in (now, now - 1):
                ok = (at >= 0) & (at + 1 < len(sym))
                at = at[ok]
                same = seq[at] == seq[at + 1]
                place[at[~same]] = end
                place[at[same]] = self._find(sym[at[same]], sym[at[same] + 1])
            place[-1] = end
        if not pieces:
            return np.empty(0, np.int64), np.zeros(n, np.int64)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(pieces)[order], np.bincount(owner, minlength=n)

    def one(self, sym: list[int]) -> list[int]:
        """The same agenda as a heap, for one sequence."""
        n, pairs, width = len(sym), self.pairs, int(self.symbols)
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        agenda = []

        def put(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := pairs.get(sym[i] * width + sym[j])):
                heapq.heappush(agenda, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            put(i)
        while agenda:
            _, i, a, b, c = heapq.heappop(agenda)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # one of the two has merged meanwhile
            sym[i], sym[j] = c, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [s for s in sym if s >= 0]
