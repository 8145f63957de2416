"""SentencePiece encoding and decoding for merge-type vocabularies.

Texts are cut where no piece of the vocabulary can reach across: before each run of spaces and around
line ends. Segments are merged by a score-ordered agenda (see merging), and a bounded cache keeps those
that return. Each segment that is new to a batch is checked against the sentencepiece library; a
difference raises an error, as no result could then be trusted.

Cases: a null text is empty; an empty text has no tokens and decodes to an empty text. Texts of any
length are encoded whole. A null doc_id passes through. Repeated rows and other columns change
nothing. Characters outside the vocabulary become byte pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import keyed, text_slices, texts, without_gc
from loomgraph.llm.merging import Merges

#: The first segments a worker meets stay known; the others live as long as their slice of texts.
HOT_SEGMENTS = 60_000
SLICE_BYTES = 1 << 20
SPACE = "▁"


class PieceModel:
    """A merge-type model: pieces with scores, byte pieces for what it lacks, a space put before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.bytes_of = [b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.byte_id = [0] * 256
        for i in range(n):
            if sp.is_byte(i):
                b = int(pieces[i][3:5], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])
        self.text_of_id = [str(i).encode() for i in range(n)]
        self.size = n
        self.char_id = np.arange(n, n + 0x110000, dtype=np.int64)
        scores = sorted({sp.get_score(i) for i in normal.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        # Single characters that are no pieces may still be halves of pieces; they keep the id of their character.
        ids = lambda s: normal.get(s, n + ord(s) if len(s) == 1 else None)
        left, right, rank, merged = [], [], [], []
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
            for k in range(1, len(p)):
                a, b = ids(p[:k]), ids(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(rank_of[sp.get_score(i)]), merged.append(i)
        self.merges = Merges(*(np.array(x, np.int64) for x in (left, right, rank, merged)), n + 0x110000)
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in normal):
            raise ValueError("the vocabulary has pieces that reach across word or line starts")
        self.segments = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        #: Segment -> its decimal ids joined by commas; and what decodes to something else than the segment.
        self.hot: dict[str, bytes] = {}
        self.changed: dict[str, bytes] = {}
        self.width = np.array([len(b) for b in self.bytes_of])

    def split(self, text: str) -> list[str]:
        return self.segments((" " + text).replace(" ", SPACE)) if text else []

    def _merge(self, segs: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all segments in a row, and the place where each ends."""
        flat = self.char_id[np.frombuffer("".join(segs).encode("utf-32-le"), np.uint32)]
        out, sizes = self.merges.run(flat, np.fromiter(map(len, segs), np.int64, len(segs)))
        if len(lacking := np.flatnonzero(out >= self.size)):
            as_bytes = [list(map(self.byte_id.__getitem__, chr(c - self.size).encode())) for c in out[lacking].tolist()]
            more = np.ones(len(out), np.int64)
            more[lacking] = [len(b) for b in as_bytes]
            owner = np.repeat(np.repeat(np.arange(len(segs)), sizes), more)
            whole = np.repeat(out, more)
            whole[np.repeat(out >= self.size, more)] = np.concatenate(as_bytes)
            out, sizes = whole, np.bincount(owner, minlength=len(segs))
        return out.tolist(), np.cumsum(sizes).tolist()

    def _check(self, segs: list[str], ids: list[int], ends: list[int]) -> None:
        """The library puts a space before each text; a segment without one goes after a line end."""
        asked = [s[1:].replace(SPACE, " ") if s[0] == SPACE else "\n" + s for s in segs]
        lead = len(self.library.encode("\n"))
        at = 0
        for seg, end, other in zip(segs, ends, self.library.encode(asked, num_threads=1), strict=True):
            if ids[at:end] != (other if seg[0] == SPACE else other[lead:]) and seg != SPACE:
                raise ValueError(f"segment {seg[:80]!r}: {ids[at:end][:20]}, the library has {other[:20]}")
            at = end

    def learn(self, segs: list[str]) -> dict[str, bytes]:
        """Segment -> its decimal ids joined by commas."""
        if not segs:
            return {}
        ids, ends = self._merge(segs)
        self._check(segs, ids, ends)
        starts = [0, *ends[:-1]]
        digits = list(map(self.text_of_id.__getitem__, ids))
        found = {s: b",".join(digits[a:b]) for s, a, b in zip(segs, starts, ends, strict=True)}
        # Decoded, the segments must come back: as a whole, and each with its own length.
        plain = [s.replace(SPACE, " ").encode() for s in segs]
        widths = np.add.reduceat(self.width[ids], starts).tolist()
        if b"".join(map(self.bytes_of.__getitem__, ids)) != b"".join(plain) or widths != list(map(len, plain)):
            for s, p, a, b in zip(segs, plain, starts, ends, strict=True):
                if (data := b"".join(map(self.bytes_of.__getitem__, ids[a:b]))) != p:
                    self.changed[s] = data
        return found

    def encode(self, many: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Per text: number of ids, the decimal ids joined by commas, and the decoded text in UTF-8.

        Each segment's ids are decoded when it is learnt; where all gave the segment back, so does the whole.
        """
        split = list(map(self.split, many))
        get = self.hot.get
        found = [list(map(get, segs)) for segs in split]
        found_new = self.learn(list({s for segs, rows in zip(split, found, strict=True) if None in rows for s, r in zip(segs, rows, strict=True) if r is None}))
        for text, segs, rows in zip(many, split, found, strict=True):
            if None in rows:
                rows = [found_new[s] if r is None else r for s, r in zip(segs, rows, strict=True)]
            ids = b",".join(rows)
            if self.changed:
                data = b"".join([self.changed.get(s) or s.replace(SPACE, " ").encode() for s in segs])[1:]
            else:
                data = text.replace(SPACE, " ").encode()
            yield ids.count(b",") + 1 if ids else 0, ids, data
        if len(self.hot) < HOT_SEGMENTS:
            self.hot.update(found_new)

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the space that encoding puts first goes."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids as text, if asked) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in without_gc(batches):
            for part in text_slices(batch, limit=SLICE_BYTES):
                counts, ids, decoded, own = [], [], [], []
                for n, text_ids, data in m.encode(texts(part)):
                    counts.append(n)
                    ids.append(hashlib.sha256(text_ids).hexdigest())
                    decoded.append(hashlib.sha256(data).hexdigest())
                    if with_ids:
                        own.append(text_ids.decode())
                cols = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(own, pa.string())} if with_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string" if with_ids else "")
    return keyed(docs, id_col, text_col).mapInArrow(run, schema)
