"""Word shingles as 64-bit hashes, and their min-max signatures."""

from __future__ import annotations

import hashlib

import numpy as np

#: Constants of a 64-bit mixer.
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: Whitespace bytes 09-0D and 20; they never occur inside a longer UTF-8 sequence.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0xD1342543DE82EF95
_BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, _BLOCK), _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (starts, ends) of the words [^\x20\x09-\x0D]+."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hash of each word: a polynomial modulo 2**64 over random byte values, finalised.

    Works through the bytes in blocks, so tables and sums stay small however long the text is.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
        stop = int(ends[j - 1])
        if stop - at > _BLOCK:  # one word longer than a block
            out[i] = int.from_bytes(hashlib.blake2b(data[at:stop].tobytes(), digest_size=8).digest(), "little")
        else:
            total = np.zeros(stop - at + 1, np.uint64)
            np.cumsum(_BYTE[data[at:stop]] * _POW[: stop - at], out=total[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((total[e] - total[s]) * _INV[s] + (e - s).astype(np.uint64))
        i = j
    return out


def utf8(text: str, lower: bool = False) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return _LOWER[data] if lower else data


def normal_hashes(text: str) -> np.ndarray:
    """Hashes of the words of the text with A-Z lower-cased."""
    data = utf8(text, True)
    return word_hashes(data, *word_spans(data))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words, in order; with fewer words, of the whole sequence as one run."""
    if len(h) == 0:
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    acc = np.full(n, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        acc = (acc ^ h[j : j + n]) * _STEP
        acc ^= acc >> np.uint64(29)
    return mix(acc)


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    return np.unique(windows(hashes, width))


class MinMax:
    """Min-max signatures: of each hash function both the least and the greatest value are kept.

    `functions` evaluations give 2 * functions signature values. A band never holds the minimum and
    the maximum of one function, so its values come from different functions.
    """

    def __init__(self, functions: int, bands: int, rows: int, seed: int = 7):
        if bands * rows > 2 * functions:
            raise ValueError("bands * rows must be at most 2 * functions")
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(1, 2**31, functions, dtype=np.int64) * 2 + 1).astype(np.uint32)
        self.b = rng.integers(0, 2**32, functions, dtype=np.int64).astype(np.uint32)
        self.functions, self.bands, self.rows = functions, bands, rows
        self.salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """All minima, then all maxima: 2 * functions values of a non-empty set."""
        lo, hi = np.empty(self.functions, np.uint32), np.empty(self.functions, np.uint32)
        s = (s >> np.uint64(32)).astype(np.uint32)
        step = max(1, 32768 // len(s))
        for k in range(0, self.functions, step):
            v = s[None, :] * self.a[k : k + step, None]
            v += self.b[k : k + step, None]
            v ^= v >> np.uint32(15)
            lo[k : k + step] = v.min(axis=1)
            hi[k : k + step] = v.max(axis=1)
        return np.concatenate([lo, hi])

    def band_keys(self, s: np.ndarray) -> np.ndarray:
        """One int64 key for each band, its number mixed in."""
        v = self.signature(s).astype(np.uint64)[: self.bands * self.rows].reshape(self.bands, self.rows)
        acc = self.salt.copy()
        for j in range(self.rows):
            acc = mix((acc ^ v[:, j]) * _STEP)
        return acc.view(np.int64)
