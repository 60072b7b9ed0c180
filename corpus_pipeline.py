"""Documents to token ids: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Every stage takes any table with the columns of documents and carries all columns on, the last one excepted. An empty table
gives an empty one, texts of any length are worked on whole, and rows that repeat are rows each unless a stage says else.
"""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, lines, mixing, neardup, quality
from tideline.llm.common import durable, table
from tideline.llm.queries import RANKS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; null texts fail them."""
    return quality.quality_filter(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows the text. Null texts and rows without id
    stay as they are; rows of one id are one document."""
    return lines.line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five words, 0.8). Rows without id or without words stay; rows of
    one id stay or go together."""
    return neardup.keep_one(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks; copies are rows. A null source is one of its own."""
    return mixing.mix(docs, weights=[5, 2, 1], cap=3.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded_sha256): ids as little-endian unsigned 32-bit integers; a null text has none."""
    slim = docs.select("doc_id", "source", "text")
    x = bpe.round_trip_column(slim, RANKS, public_tokenizers.PATTERN)
    return x.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("quality rules", keep_quality), ("line dedup", drop_repeated_lines), ("near-dedup", keep_one_of_each), ("mixing", mix_sources), ("byte-level BPE", encode)]
#: SQL cannot express the last stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
