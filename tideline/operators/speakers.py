"""Who speaks when: as-of lookup of turns, votes of tokens, and what the votes tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_S, around, best_overlap

def _neighbours(points: DataFrame, turns: DataFrame, block_s: float) -> DataFrame:
    """points (rec_id, t, ...) with prev and next: the turn with the greatest start up to t, and the first one after t; of
    equal starts by end and speaker."""
    return around(points, turns.select("rec_id", "start", "end", "speaker"), "start", block_s)


def speaker_at(points: DataFrame, turns: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """points with speaker: that of the last turn to start, if it has not ended (both ends belong to a turn), else null."""
    x = _neighbours(points, turns, block_s)
    return x.withColumn("speaker", F.when(F.col("t") <= F.col("prev.end"), F.col("prev.speaker"))).drop("prev", "next")


def nearest_speaker(points: DataFrame, turns: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """points with nearest: the closer of the turn before and the one after; the one before if they are as close."""
    x = _neighbours(points, turns, block_s)
    before = F.greatest(F.lit(0.0), F.col("t") - F.col("prev.end"))
    after = F.col("next.start") - F.col("t")
    near = F.when(F.col("next").isNull() | (before <= after), F.col("prev.speaker")).otherwise(F.col("next.speaker"))
    return x.withColumn("nearest", F.when(F.col("prev").isNull(), F.col("next.speaker")).otherwise(near)).drop("prev", "next")


def token_votes(tokens: DataFrame, turns: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """(rec_id, sent_ix, speaker, votes, first_pos): a vote for each token in a turn."""
    v = speaker_at(tokens, turns, block_s).where("speaker is not null")
    return v.groupBy("rec_id", "sent_ix", "speaker").agg(F.count("*").alias("votes"), F.min_by("t", "pos").alias("first_t"))


def label_sentences(tokens: DataFrame, turns: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """(rec_id, sent_ix, speaker): most votes; of equals whose first token comes first; without votes the turn nearest to
    the sentence's first token. tokens: (rec_id, sent_ix, pos, t). Without any turn it is an error."""
    require_turns(turns)
    w = Window.partitionBy("rec_id", "sent_ix").orderBy(F.desc("votes"), "first_t")
    won = token_votes(tokens, turns, block_s).withColumn("k", F.row_number().over(w)).where("k = 1").select("rec_id", "sent_ix", "speaker")
    start = tokens.groupBy("rec_id", "sent_ix").agg(F.min_by("t", "pos").alias("t"))
    x = nearest_speaker(start, turns, block_s).join(won, ["rec_id", "sent_ix"], "left")
    return x.select("rec_id", "sent_ix", F.coalesce("speaker", "nearest").alias("speaker"))


def vote_census(tokens: DataFrame, turns: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """(rec_id, sentences, unanimous, straddling, all_in_gap, gap_tokens)."""
    x = speaker_at(tokens, turns, block_s).groupBy("rec_id", "sent_ix").agg(F.count_distinct("speaker").alias("k"), F.count_if(F.col("speaker").isNull()).alias("gap"))
    return x.groupBy("rec_id").agg(
        F.count("*").alias("sentences"), F.count_if(F.col("k") == 1).alias("unanimous"), F.count_if(F.col("k") > 1).alias("straddling"), F.count_if(F.col("k") == 0).alias("all_in_gap"), F.sum("gap").alias("gap_tokens")
    )


def vote_margins(tokens: DataFrame, turns: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """(rec_id, straddling, least_margin, median_margin): (first - second) / all votes; the median is the upper one."""
    w = Window.partitionBy("rec_id", "sent_ix").orderBy(F.desc("votes"))
    v = token_votes(tokens, turns, block_s).withColumn("k", F.row_number().over(w))
    m = v.groupBy("rec_id", "sent_ix").agg(F.max(F.when(F.col("k") == 1, F.col("votes"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("votes"))).alias("b"), F.sum("votes").alias("n")).where("b is not null")
    m = m.select("rec_id", ((F.col("a") - F.col("b")) / F.col("n")).alias("margin"))
    s = m.groupBy("rec_id").agg(F.count("*").alias("straddling"), F.array_sort(F.collect_list("margin")).alias("all"))
    upper = F.element_at("all", (F.expr("size(all) div 2") + 1).cast("int"))
    return s.select("rec_id", "straddling", F.round(F.element_at("all", 1), 9).alias("least_margin"), F.round(upper, 9).alias("median_margin"))


def sentences_per_speaker(tokens: DataFrame, turns: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """(rec_id, speaker, sentences, words), a row also for speakers who win nothing."""
    size = tokens.groupBy("rec_id", "sent_ix").agg(F.count("*").alias("n"))
    won = label_sentences(tokens, turns, block_s).join(size, ["rec_id", "sent_ix"]).groupBy("rec_id", "speaker").agg(F.count("*").alias("sentences"), F.sum("n").alias("words"))
    every = turns.select("rec_id", "speaker").distinct()
    return every.join(won, ["rec_id", "speaker"], "left").na.fill(0, ["sentences", "words"])


def seconds_per_speaker(turns: DataFrame) -> DataFrame:
    return turns.groupBy("rec_id", "speaker").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"))


def speaker_runs(labels: DataFrame) -> DataFrame:
    """(rec_id, runs) of equal speakers along sentences; none for no rows."""
    before = F.lag("speaker").over(Window.partitionBy("rec_id").orderBy("sent_ix"))
    return labels.withColumn("new", ~F.col("speaker").eqNullSafe(before)).groupBy("rec_id").agg(F.greatest(F.lit(1), F.count_if("new")).cast("long").alias("runs"))


def encode_labels(labels: DataFrame) -> DataFrame:
    """(rec_id, label, ix): labels numbered by name within a recording, so numbers are stable across runs."""
    d = labels.select("rec_id", "label").distinct()
    return d.withColumn("ix", (F.row_number().over(Window.partitionBy("rec_id").orderBy("label")) - 1).cast("int"))


def overlap_labels(sentences: DataFrame, turns: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """(rec_id, sent_ix, speaker): the turn that overlaps a sentence most, of equals the first; without one the nearest.

    sentences: (rec_id, sent_ix, start, end). Turns and sentences may last for seconds or for weeks; block_s is best longer
    than most of them.
    """
    best = best_overlap(sentences, turns, "sent_ix", "speaker", block_s)
    near = nearest_speaker(sentences.select("rec_id", "sent_ix", F.col("start").alias("t")), turns, block_s)
    return near.join(best, ["rec_id", "sent_ix"], "left").select("rec_id", "sent_ix", F.coalesce("speaker", "nearest").alias("speaker"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rec_id, sent_ix, speaker, other) of two labellings (rec_id, sent_ix, speaker) of the same sentences; a sentence that
    only one of them has is an error when its row is made."""
    x = a.select("rec_id", "sent_ix", "speaker", F.lit(True).alias("in_a")).join(b.select("rec_id", "sent_ix", F.col("speaker").alias("other"), F.lit(True).alias("in_b")), ["rec_id", "sent_ix"], "full")
    lacks = F.raise_error(F.concat(F.lit("one labelling lacks sentence "), F.concat_ws("/", "rec_id", "sent_ix"))).cast("int")
    one = F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), lacks)
    return x.select("rec_id", "sent_ix", F.coalesce(one, F.col("speaker")).alias("speaker"), "other")


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rec_id, sentences, different) of two labellings; each sentence must be in both."""
    return paired(a, b).groupBy("rec_id").agg(F.count("*").alias("sentences"), F.count_if(~F.col("speaker").eqNullSafe(F.col("other"))).alias("different"))


def overlapping_turns(turns: DataFrame) -> DataFrame:
    """Turns that begin before the one before them has ended (rec_id, start, end, speaker)."""
    before = F.lag("end").over(Window.partitionBy("rec_id").orderBy("start", "end", "speaker"))
    return turns.withColumn("before", before).where("start < before").drop("before")


def require_turns(turns: DataFrame) -> DataFrame:
    if turns.isEmpty():
        raise ValueError("cannot label by an empty list of turns")
    return turns
