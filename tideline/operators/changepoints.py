"""Change points of an ordered sequence of slides, and totals over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_points(slides: DataFrame) -> DataFrame:
    """(rec_id, time, lower_bound, from_slide, to_slide, kind) where the slide (rec_id, time, slide) changes.

    Rows without time or slide are left out first. lower_bound is the time of the row before; -1 is no view, and a change
    to or from it a cut, any other a flip.
    """
    w = Window.partitionBy("rec_id").orderBy("time")
    x = slides.dropna(subset=["time", "slide"]).select("rec_id", "time", F.lag("time").over(w).alias("lower_bound"), F.lag("slide").over(w).alias("from_slide"), F.col("slide").alias("to_slide"))
    kind = F.when((F.col("from_slide") == -1) | (F.col("to_slide") == -1), "view_cut").otherwise("slide_flip")
    return x.where("from_slide <> to_slide").withColumn("kind", kind)


def recording_totals(slides: DataFrame) -> DataFrame:
    """(rec_id, sentences, duration, slides, changes) by recording; the duration is the last time."""
    c = change_points(slides).groupBy("rec_id").agg(F.count("*").alias("changes"))
    x = slides.dropna(subset=["time", "slide"]).groupBy("rec_id").agg(F.count("*").alias("sentences"), F.max("time").alias("duration"), F.count_distinct("slide").alias("slides"))
    return x.join(c, "rec_id", "left").na.fill(0, ["changes"])


def corpus_totals(slides: DataFrame) -> DataFrame:
    """(kind, recordings, changes, hours): by kind, the recordings that have such a change, and in the row `all` every
    recording, with its hours, also one that never changes."""
    x = slides.dropna(subset=["time", "slide"])
    last = x.groupBy("rec_id").agg(F.max("time").alias("duration"))
    per = last.join(change_points(slides).groupBy("rec_id", "kind").agg(F.count("*").alias("n")), "rec_id", "left")
    by_kind = per.where("kind is not null").groupBy("kind").agg(F.count("*").alias("recordings"), F.sum("n").alias("changes"), F.sum("duration").alias("s"))
    every = per.groupBy("rec_id", "duration").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).agg(F.lit("all").alias("kind"), F.count("*").alias("recordings"), F.coalesce(F.sum("n"), F.lit(0)).alias("changes"), F.sum("duration").alias("s"))
    return by_kind.unionByName(every).select("kind", "recordings", "changes", F.round(F.col("s") / 3600.0, 6).alias("hours"))
