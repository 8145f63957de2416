"""Quality rules: a hashed n-gram log-likelihood ratio, target corpus against raw corpus.

Word 1- and 2-grams fall into BUCKETS hashed cells. The raw multinomial counts every document; the
target multinomial counts every document labelled good. A document's score is the mean over its n-grams of
log p_target - log p_raw. One threshold decides every document alike; it is fitted on all labelled
documents, where a good one counts by its score without its own n-grams in the target (`held_out`).
Labels meet the documents in joins by doc_id: neither the driver nor a task holds them all.

Cases: a null or blank text has no words and fails the base rules. A null doc_id is scored like any
other and never counts as labelled. Rows of one doc_id with different texts are answered by their own text
each (text_hash tells them apart). Conflicting labels of one doc_id count as bad. Without labels of
both classes only the base rules decide. Whole texts are used; repeated rows are answered each.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import keyed, materialise, text_slices, texts
from loomgraph.llm.shingles import utf8, windows, word_hashes, word_spans

BUCKETS = 1 << 14
MAX_LABELLED = 50_000
#: Share of the labelled good documents that the threshold must keep.
KEEP_GOOD = 0.999
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_WHITE = " \t\n\v\f\r"

_MEASURED = "doc_id long, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, held_out double"


def repeated_words(h: np.ndarray) -> int:
    """Words inside 5-word windows that occur at least twice in the sequence."""
    if len(h) < 6:
        return 0
    w = windows(h, 5)
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    marks = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + 5, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(_WHITE):
            n += line in seen
            seen.add(line)
    return n


def ngram_buckets(h: np.ndarray) -> np.ndarray:
    grams = np.concatenate([h, windows(h, 2)]) if len(h) > 1 else h
    return (grams >> np.uint64(50)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: the n-gram counts of all its documents."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in text_slices(batch):
            for text in texts(part):
                data = utf8(text)
                total += np.bincount(ngram_buckets(word_hashes(data, *word_spans(data))), minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict({"n": pa.array([total.tolist()], pa.list_(pa.int64()))})


def _counted(base: DataFrame) -> np.ndarray:
    """The n-gram counts of all texts of base."""
    cells = base.mapInArrow(_count, "n array<long>").select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()
    return np.array([r.n for r in cells], float) if cells else np.zeros(BUCKETS)


def held_out_score(own: np.ndarray, raw: np.ndarray, target: np.ndarray) -> float | None:
    """The score of a document whose n-grams fall into the cells `own`, without them in the target; None if the target lacks some."""
    cells, n = np.unique(own, return_counts=True)
    if (target[cells] < n).any():
        return None
    p = np.log((target[cells] - n + 0.5) / (target.sum() - len(own) + 0.5 * BUCKETS)) - np.log((raw[cells] + 0.5) / (raw.sum() + 0.5 * BUCKETS))
    return float((p * n).sum() / len(own))


def _measure(raw: np.ndarray, target: np.ndarray):
    """The measures and scores of each text; `held_out` is given as if it were part of the target, wherever it can be."""
    weights = np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows, scores, without = [], [], []
                for text in texts(part):
                    data = utf8(text)
                    starts, ends = word_spans(data)
                    h = word_hashes(data, starts, ends)
                    own = ngram_buckets(h)
                    n_bytes = int((ends - starts).sum())
                    rows.append((len(h), n_bytes - int(_CONTINUES[data].sum()), int(_SYMBOL[data].sum()), duplicate_lines(text), repeated_words(h)))
                    scores.append(round(float(weights[own].mean()), 9) if len(h) else None)
                    held = held_out_score(own, raw, target) if len(h) else None
                    without.append(None if held is None else round(held, 9))
                m = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *(pa.array(m[:, k]) for k in range(5)), pa.array(scores, pa.float64()), pa.array(without, pa.float64())], [x.split()[0] for x in _MEASURED.split(", ")])

    return run


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good): every labelled doc_id once."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))


def labelled_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, good): at most `limit` labelled documents, by the hash of doc_id. For trials; `quality` takes all labels."""
    one = materialise(labelled(labels).withColumn("hash", F.xxhash64("doc_id")), "labels")
    n = one.count()
    # Only hashes below a bound can be among the least: it leaves 1.5 times the limit, so tasks send no more than that together.
    near = one.where(F.col("hash") < int(-(2**63) + 2**64 * 1.5 * limit / n)) if n > 2 * limit else one
    if near is not one and near.count() < limit:
        near = one
    return near.orderBy("hash", "doc_id").limit(limit).select("doc_id", "good")


def _threshold(scored: DataFrame) -> float | None:
    """The cut of greatest balanced accuracy among those that keep KEEP_GOOD of the good; None without both classes.

    Scores are counted in cells of 0.002; a cut lies halfway between the cells on its two sides.
    """
    rows = scored.where("llr is not null and good is not null").groupBy(F.floor(F.coalesce("held_out", "llr") * 500).alias("cell")).agg(F.sum(F.col("good").cast("int")).alias("good"), F.sum((~F.col("good")).cast("int")).alias("bad")).orderBy("cell").collect()
    good, bad = sum(r.good for r in rows), sum(r.bad for r in rows)
    if not good or not bad:
        return None
    best, cut, lost, caught, below = -1.0, None, 0, 0, rows[0].cell - 1
    for r in rows:  # cut below this cell
        if lost <= (1 - KEEP_GOOD) * good and caught / bad - lost / good > best:
            best, cut = caught / bad - lost / good, (below + 1 + r.cell) / 1000
        lost, caught, below = lost + r.good, caught + r.bad, r.cell
    return cut


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the base measures, base_failed, llr, held_out, text_hash and kept."""
    spark: SparkSession = docs.sparkSession
    base = keyed(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    known = materialise(labelled(labels), "labelled")
    # By shuffle at every size: disk then grows in proportion, and large labels are never broadcast.
    trusted = base.select("doc_id", "text").join(known.where("good").hint("merge"), "doc_id", "left_semi")
    raw, target = _counted(base.select("text")), _counted(trusted.select("text"))
    alone = base.mapInArrow(_measure(raw, target), _MEASURED)
    measured = materialise(alone.join(known, "doc_id", "left").withColumn("held_out", F.when(F.col("good"), F.col("held_out"))), "measured")
    cut = _threshold(measured)
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    passed = F.lit(True) if cut is None else F.coalesce(F.col("llr") >= cut, F.lit(False))
    return measured.drop("good").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passed)
