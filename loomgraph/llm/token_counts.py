"""Token counts for byte-level BPE vocabularies, with a whole-token shortcut.

Offline proof: every vocabulary string runs through the merges alone; those that come out as one token,
their own, form the whole-token set. A pre-token in that set counts as one without any merging; only
the rest merge. Texts are cut at single spaces between visible characters, where no pre-token can
reach across, so that a bounded cache can keep the counts of frequent chunks.

Cases: a null text is empty and has 0 tokens. Special strings in a text (as <|endoftext|>) are one token
each, as the library takes them by default. Texts of any length are counted whole. A null doc_id passes
through. Repeated rows and other columns change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomgraph.llm.common import keyed, text_slices, texts, without_gc
from loomgraph.llm.merging import Merges

HOT_CHUNKS = 60_000
SLICE_BYTES = 1 << 20
#: The pre-token pattern of byte-level BPE (a fixed value); white space as Unicode has it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: A lone surrogate: not valid in UTF-8.
_FIRST = "\ud800"
_UNSAFE = re.compile(r"\s\s|^\s|\s$|[^\S ]")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible Latin-1, else the next free one from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class ByteModel:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or spec["model"].get("ignore_merges"):
            raise ValueError("only byte-level vocabularies without a prefix space are counted here")
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.byte_id = np.array([vocab[c] for c in characters], np.int64)
        left, right, merged = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self.merges = Merges(left, right, np.arange(len(merges)), merged, max(vocab.values()) + 1)
        strings = [bytes(byte_of[c] for c in s) for s in vocab]
        ids, sizes = self._merge(strings)
        at = np.cumsum(sizes) - sizes
        own = np.fromiter(vocab.values(), np.int64, len(vocab))
        self.whole = {s for s, n, i, v in zip(strings, sizes.tolist(), ids[at].tolist(), own.tolist(), strict=True) if n == 1 and i == v}
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.hot: dict[str, int] = {}

    def _merge(self, many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = self.byte_id[np.frombuffer(b"".join(many), np.uint8)]
        return self.merges.run(flat, np.fromiter(map(len, many), np.int64, len(many)))

    def _chunks(self, text: str) -> list[str]:
        """Pieces of the text, each but the first without the space before it. The first has a mark in front that no text holds."""
        parts = _SAFE_CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
        return [_FIRST + parts[0], *parts[1:]]

    def learn(self, chunks: list[str]) -> dict[str, int]:
        if not chunks:
            return {}
        tokens = [[t.encode() for t in self.find(c[1:] if c[:1] == _FIRST else " " + c)] for c in chunks]
        rest = list({t for ts in tokens for t in ts if t not in self.whole})
        sizes = dict(zip(rest, self._merge(rest)[1].tolist(), strict=True)) if rest else {}
        get = sizes.get
        return {c: sum([get(t, 1) for t in ts]) for c, ts in zip(chunks, tokens, strict=True)}

    def count(self, many: list[str]) -> list[int]:
        """Tokens of each text."""
        owners, split, totals = [], [], [0] * len(many)
        for i, text in enumerate(many):
            pieces = self.special.split(text) if self.special and self.special.search(text) else [text]
            totals[i] = len(pieces) - 1
            for p in pieces:
                if p:
                    owners.append(i)
                    split.append(self._chunks(p))
        get = self.hot.get
        found = [list(map(get, chunks)) for chunks in split]
        new = self.learn(list({c for chunks, rows in zip(split, found, strict=True) if None in rows for c, r in zip(chunks, rows, strict=True) if r is None}))
        for i, chunks, rows in zip(owners, split, found, strict=True):
            totals[i] += sum([new[c] if r is None else r for c, r in zip(chunks, rows, strict=True)] if None in rows else rows)
        if len(self.hot) < HOT_CHUNKS:
            self.hot.update(new)
        return totals


@cache
def model(path: str) -> ByteModel:
    return ByteModel(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in without_gc(batches):
            for part in text_slices(batch, limit=SLICE_BYTES):
                many = texts(part)
                n = m.count(many)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in many], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
