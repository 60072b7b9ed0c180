"""Sentences from tokens, and the second engine's segments as sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sentences(tokens: DataFrame, pause_s: float | None = None) -> DataFrame:
    """(rec_id, sent_ix, start, end, text, tokens) from tokens (rec_id, pos, text, start, duration).

    A token that ends in . ! or ? closes a sentence; so does a pause of pause_s before the next one, which is off by
    default. The text is the tokens' texts as they are, one after the other; output tokens are (t, w).
    """
    w = Window.partitionBy("rec_id").orderBy("pos")
    end = F.col("start") + F.col("duration")
    closes = F.col("text").rlike(r"[.!?]\s*$")
    if pause_s is not None:
        closes = closes | (F.lead("start").over(w) - end >= pause_s)
    x = tokens.withColumn("closes", F.coalesce(closes, F.lit(False)).cast("int")).withColumn("end", end)
    x = x.withColumn("sent_ix", F.coalesce(F.sum("closes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    token = F.struct("pos", F.col("start").alias("t"), F.col("text").alias("w"))
    s = x.groupBy("rec_id", "sent_ix").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.array_sort(F.collect_list(token)).alias("all"))
    tokens_ = F.transform("all", lambda z: F.struct(z["t"].alias("t"), z["w"].alias("w")))
    return s.select("rec_id", "sent_ix", "start", "end", F.array_join(F.transform("all", lambda z: z["w"]), "").alias("text"), tokens_.alias("tokens"))


def sentences_of_segments(segments: Column) -> Column:
    """Segments (start, end, text, words (word, start, end)) as sentences: the text is stripped, words keep their space;
    missing segments or words give empty arrays."""
    words = lambda s: F.coalesce(F.transform(s["words"], lambda x: F.struct(x["start"].cast("double").alias("t"), x["word"].alias("w"))), F.array().cast("array<struct<t:double,w:string>>"))
    one = lambda s: F.struct(s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end"), F.btrim(s["text"], F.lit(" \t\n\r\x0b\x0c")).alias("text"), words(s).alias("tokens"))
    return F.coalesce(F.transform(segments, one), F.array().cast("array<struct<start:double,end:double,text:string,tokens:array<struct<t:double,w:string>>>>"))
