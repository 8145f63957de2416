"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. A decision holds for all rows of one doc_id and text; rows of one doc_id with
different texts are decided each by its own text, and rows without a doc_id are never removed. All but the
last stage return the columns of documents. Null and empty texts, texts of any length, ties, repeated rows
and empty tables are as in the operators: a null or empty text fails the base quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, near_dedup, pii, quality, sentencepiece_bpe
from loomgraph.llm.common import drop_written, materialise, table, written
from loomgraph.llm.queries import tokenizer_path


#: Percent of their shingles that near-duplicates share at least.
SIMILAR = 80


def _without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs but for the rows whose doc_id and text are removed."""
    gone = removed.where("doc_id is not null").select(removed["doc_id"].alias("removed_id"), removed["text_hash"].alias("removed_text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["removed_id"]) & (F.xxhash64(docs["text"]) == gone["removed_text"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    verdict = quality.quality(docs, table(spark, sf_dir, "labels"))
    return _without(docs, verdict.where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least doc_id."""
    return _without(docs, near_dedup.near_duplicates(docs, SIMILAR).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), by_text=True))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; n_chars follows."""
    return pii.masked(docs, size_col="n_chars")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each text."""
    return sentencepiece_bpe.encode(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: Signatures, Markov and ratio models can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what earlier stages wrote is deleted as soon as the next one is stored."""
    docs, since = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, since, 1)
    return docs
