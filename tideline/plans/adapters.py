"""The driver's tables as timeline entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WEEK, TURN_SECONDS = 604_800, 172_800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts):
    """Seconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / F.lit(1e6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, i, t, event_id, event_type, value): a user's events in time order; i from 0."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return e.select(F.col("user_id").alias("rec_id"), (F.row_number().over(w) - 1).alias("i"), epoch("ts").alias("t"), "event_id", "event_type", "value")


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("rec_id", "i", F.col("value").cast("int").alias("score"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as turns that last two days or until the next one."""
    s = events(spark, sf_dir).where("event_type = 'signup'")
    end = F.least(F.col("t") + TURN_SECONDS, F.lead("t").over(Window.partitionBy("rec_id").orderBy("t", "event_id")))
    return s.select("rec_id", F.col("t").alias("start"), end.alias("end"), (F.col("event_id") % 3).cast("int").alias("speaker"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other events as tokens (rec_id, sent_ix, pos, t), a sentence a week."""
    e = events(spark, sf_dir).where("event_type <> 'signup'")
    return e.select("rec_id", F.floor(F.col("t") / WEEK).cast("int").alias("sent_ix"), F.col("i").alias("pos"), "t")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 pictures (rec_id, frame_ix, tiles array<int>)."""
    w = Window.partitionBy("label").orderBy("vec_id")
    level = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5).cast("int")))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("rec_id"), (F.row_number().over(w) - 1).alias("frame_ix"), F.transform("embedding", level).alias("tiles"))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as slides by number (rec_id, time, slide); an error is no view, -1."""
    types = F.array(*map(F.lit, ["click", "purchase", "signup", "view"]))
    slide = F.when(F.col("event_type") == "error", -1).otherwise(F.array_position(types, F.col("event_type")).cast("int"))
    return events(spark, sf_dir).select("rec_id", F.col("i").cast("double").alias("time"), slide.alias("slide"))
