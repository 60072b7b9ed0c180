"""Overlapping chunks of a recording and what they bring back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_geometry(recordings: DataFrame, rate: int = 16_000, chunk_s: float = 120.0, overlap_s: float = 15.0, hop: int = 0) -> DataFrame:
    """(rec_id, chunk_ix, start, end, next_start) for recordings (rec_id, total samples).

    Seconds become samples by truncation. next_start is the next start, for the last one the total; it is set before
    chunks shorter than hop are left out, so it may name one of those. An empty recording has no chunk.
    """
    chunk, stride = int(chunk_s * rate), int(chunk_s * rate) - int(overlap_s * rate)
    if stride <= 0:
        raise ValueError("chunks must be longer than their overlap")
    r = recordings.where("total > 0")
    r = r.select("rec_id", "total", F.posexplode(F.expr(f"sequence(0L, cast(total as bigint) - 1, {stride}L)")).alias("chunk_ix", "start"))
    end = F.least(F.col("start") + chunk, F.col("total"))
    following = F.when(F.col("start") + stride < F.col("total"), F.col("start") + stride).otherwise(F.col("total"))
    return r.select("rec_id", "chunk_ix", "start", end.alias("end"), following.cast("long").alias("next_start")).where(F.col("end") - F.col("start") >= hop)


def remaining(chunks: DataFrame, skip_before: int) -> DataFrame:
    """Chunks that are not merged yet; the start decides."""
    return chunks.where(F.col("start") >= skip_before)


def n_chunks(total: int, rate: int = 16_000, chunk_s: float = 120.0, overlap_s: float = 15.0) -> int:
    stride = int(chunk_s * rate) - int(overlap_s * rate)
    return -(-total // stride)


def shift_tokens(tokens: DataFrame, rate: int = 16_000) -> DataFrame:
    """Tokens of chunks (chunk_start in samples, start in seconds of the chunk) in seconds of the recording."""
    return tokens.withColumn("start", F.col("start") + F.col("chunk_start") / F.lit(float(rate)))


def reported_seconds(chunks: DataFrame, rate: int = 16_000) -> DataFrame:
    """(rec_id, chunk_ix, done_s, total_s) after each chunk."""
    total = F.max("end").over(Window.partitionBy("rec_id"))
    return chunks.select("rec_id", "chunk_ix", (F.col("end") / rate).alias("done_s"), (total / rate).alias("total_s"))
