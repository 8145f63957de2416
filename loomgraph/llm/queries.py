"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, html_text, pii, secrets, sentencepiece_bpe, token_counts
from loomgraph.llm.common import table
from loomgraph.llm.near_dedup import near_duplicates
from loomgraph.llm.quality import quality
from loomgraph.llm.sharding import kd_shards
from loomgraph.llm.url_filter import url_filter

#: Dated changes of the demonstration list: (name, kind, action, date).
URL_LIST = [
    ("spam-farm.example.org", "deny", "add", "2024-02-01"),
    ("spam-farm.example.org", "deny", "remove", "2024-06-15"),
    ("spam-farm.example.org", "deny", "add", "2024-09-01"),
    ("cheap-pills.example.com", "deny", "add", "2023-11-20"),
    ("example.net", "deny", "add", "2024-03-10"),
    ("example.net", "deny", "remove", "2024-05-10"),
    ("m.ththth.example.net", "allow", "add", "2024-03-20"),
    ("blog.ththan.example.net", "deny", "add", "2024-07-01"),
    ("blog.ththan.example.net", "allow", "add", "2024-08-01"),
    ("blog.ththan.example.net", "deny", "remove", "2024-08-01"),
    ("therha.example.com", "deny", "add", "2024-01-05"),
    ("therha.example.com", "deny", "remove", "2024-01-05"),
]


def url_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(URL_LIST, "name string, kind string, action string, day string").select("name", "kind", "action", F.col("day").cast("timestamp").alias("at"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch time; it is derived from page_id: noon of day (37 * page_id mod 366) of 2024."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.timestamp_seconds(F.lit(1704110400) + F.pmod(F.col("page_id") * 37, F.lit(366)) * 86400)
    out = url_filter(pages.withColumn("fetched", fetched), url_list(spark), "page_id", "url", "fetched")
    return out.withColumnRenamed("capture_id", "page_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`. Copies of a text agree in these dimensions, so they stay together unless they weigh too much."""
    docs = table(spark, sf_dir, "documents")
    size = F.log(F.octet_length(F.coalesce("text", F.lit(""))) + 8)
    language = F.crc32(F.coalesce("lang", F.lit("")).cast("binary"))
    out = kd_shards(docs, {"size": size, "language": language})
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    found = {k: f for k, f in globals().items() if re.match(r"op\d+_", k)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from loomgraph.llm.oracles import ORACLES

    return dict(ORACLES)
