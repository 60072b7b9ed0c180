"""Evaluation against truth and against chance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .blocks import BLOCK_S, around
from .pairs import chosen, differing, successive

#: Tosses up to which a sign test adds whole numbers.
EXACT = 1_000


def segment_of(points: DataFrame, bounds: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """points (rec_id, t, ...) with segment and sample: the last bound (rec_id, b, sample) up to t, else the first one."""
    x = around(points, bounds.select("rec_id", "b", "sample"), "b", block_s).withColumn("prev", F.coalesce("prev", "next")).where("prev is not null")
    return x.select(*[F.col(f"`{c}`") for c in points.columns], F.col("prev.b").cast("double").alias("segment"), F.col("prev.sample").cast("double").alias("sample"))


def nearest_distance(points: DataFrame, targets: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """targets (rec_id, t) with distance to the nearest point (rec_id, t): the one before or the one after by one sort."""
    x = around(targets.select("rec_id", "t"), points.select("rec_id", F.col("t").alias("m")), "m", block_s)
    return x.select("rec_id", "t", F.least(F.col("t") - F.col("prev.m"), F.col("next.m") - F.col("t")).alias("distance")).where("distance is not null")


def interval_distance(marks: DataFrame, intervals: DataFrame, block_s: float = BLOCK_S) -> DataFrame:
    """intervals (rec_id, lo, hi) with distance: 0 if a mark (rec_id, t) lies in the closed interval, else to the nearer end.

    The mark nearest to an interval is inside, the last one before lo or the first one after hi; the last mark up to hi
    and the first one after it are enough.
    """
    x = around(intervals.select("rec_id", "lo", F.col("hi").alias("t")), marks.select("rec_id", F.col("t").alias("m")), "m", block_s)
    before = F.when(F.col("prev").isNotNull(), F.greatest(F.lit(0.0), F.col("lo") - F.col("prev.m")))
    return x.select("rec_id", "lo", F.col("t").alias("hi"), F.least(before, F.col("next.m") - F.col("t")).alias("distance")).where("distance is not null")


def hit_summary(distances: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(rec_id, n, mean_distance, hit_rate); a hit is within the tolerance or on it."""
    return distances.groupBy("rec_id").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"), F.round(F.avg((F.col("distance") <= tolerance).cast("int")), 6).alias("hit_rate"))


def _share(a: np.ndarray, b: np.ndarray, delta: int) -> np.ndarray:
    return np.count_nonzero(differing(a, b, delta), axis=1) / max(a.shape[1], 1)


def instability(frames: DataFrame, delta: int = 8) -> DataFrame:
    """(rec_id, second, instability): mean share of tiles that change from the frame before and to the one after; seconds
    without both are left out. Frames are compared once, and the shares, a number a pair, are put beside each other."""
    shares = successive(frames, lambda a, b: [pa.array(_share(a, b, delta))], "share double")
    following = F.lead("share").over(Window.partitionBy("rec_id").orderBy("i"))
    x = shares.withColumn("following", following).where("following is not null")
    return x.select("rec_id", (F.col("i") + 1).alias("second"), F.round((F.col("share") + F.col("following")) / 2, 9).alias("instability"))


def same_screen(frames: DataFrame, pairs: DataFrame, delta: int = 8) -> DataFrame:
    """pairs (rec_id, a, b, ...) with same: the share of tiles that agree within delta; indices beyond the last are the last.
    Equal pairs are compared once, and a frame is sent once to each block of pairs that name it."""
    n = frames.groupBy("rec_id").agg(F.max("frame_ix").alias("n"))
    p = pairs.join(n, "rec_id").withColumns({"fa": F.least(F.col("a").cast("int"), F.col("n")), "fb": F.least(F.col("b").cast("int"), F.col("n"))})
    met = chosen(frames, p.select("rec_id", F.col("fa").alias("a"), F.col("fb").alias("b")), lambda a, b: [pa.array(1 - _share(a, b, delta))], "same double")
    met = met.select("rec_id", F.col("a").alias("fa"), F.col("b").alias("fb"), "same")
    return p.join(met, ["rec_id", "fa", "fb"]).select(*[F.col(c) for c in pairs.columns], "same")


def coverage(frames: DataFrame, marks: DataFrame, delta: int = 8) -> DataFrame:
    """(rec_id, coverage): how much of each second's picture its segment's look already shows, on average over seconds 1
    to N - 2. marks: (rec_id, t, look); the bounds are t, the samples look, on purpose not the same."""
    n = F.max("frame_ix").over(Window.partitionBy("rec_id"))
    seconds = frames.withColumn("n", n).where((F.col("frame_ix") >= 1) & (F.col("frame_ix") <= F.col("n") - 1)).select("rec_id", F.col("frame_ix").cast("double").alias("t"))
    at = segment_of(seconds, marks.select("rec_id", F.col("t").alias("b"), F.col("look").alias("sample")))
    x = same_screen(frames, at.select("rec_id", F.col("sample").alias("a"), F.col("t").alias("b")), delta)
    return x.groupBy("rec_id").agg(F.round(F.avg("same"), 9).alias("coverage"))


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) from the md5 of its parts, the same in every run and engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def random_baseline(targets: DataFrame, spans: DataFrame, draws: int, budget: int, seed: int = 0) -> DataFrame:
    """(rec_id, mean_distance) of random marks to targets, over `draws` sets of `budget` uniform times in a recording's span.

    spans: (rec_id, duration). Parity with other generators is of distribution, not of numbers.
    """
    x = _random_distances(targets, spans, draws, budget, seed)
    return x.groupBy("rec_id").agg(F.round(F.avg("distance"), 4).alias("mean_distance"))


def _random_distances(targets: DataFrame, spans: DataFrame, draws: int, budget: int, seed: int) -> DataFrame:
    """(rec_id, draw, distance) of each target to the nearest of a draw's marks."""
    d = spans.select("rec_id", "duration", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    m = d.select("rec_id", "draw", "duration", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))).alias("slot"))
    m = m.select(F.struct("rec_id", "draw").alias("rec_id"), (uniform(seed, F.col("rec_id"), F.col("draw"), F.col("slot")) * F.col("duration")).alias("t"))
    t = targets.select("rec_id", "t", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select(F.struct("rec_id", "draw").alias("rec_id"), "t")
    return nearest_distance(m, t).select(F.col("rec_id.rec_id").alias("rec_id"), F.col("rec_id.draw").alias("draw"), "distance")


def per_minute_budget(duration_s: Column, per_minute: float) -> Column:
    """At least 2; halves go to the even number."""
    return F.greatest(F.lit(2), F.bround(duration_s / 60.0 * per_minute).cast("int"))


def sign_tail(n: int, wins: int) -> float:
    """Chance of so many wins or more in n fair tosses; by whole numbers up to EXACT tosses.

    Beyond, each number of wins is weighed against the middle one: a neighbour's weight follows by one product, and what lies
    20 roots of n or more from the middle weighs less than the least double. So the work grows with the root of n.
    """
    if n <= EXACT:
        return sum(math.comb(n, k) for k in range(wins, n + 1)) / 2**n if n else 1.0
    half = n // 2
    if wins <= half:
        return 1.0 - sign_tail(n, n - wins + 1)
    k = np.arange(half, min(n, half + 20 * math.isqrt(n)), dtype=float)
    weight = np.append(1.0, np.cumprod((n - k) / (k + 1)))
    both = 2 * weight[1:].sum() + (n % 2 == 0)
    return float(weight[wins - half :].sum() / both)


def paired_wins(pairs: DataFrame) -> DataFrame:
    """(n, wins, losses, ties, mean_ours, mean_theirs) of pairs (ours, theirs); less is better, ties are no wins."""
    return pairs.agg(
        F.count("*").alias("n"), F.count_if(F.col("ours") < F.col("theirs")).alias("wins"), F.count_if(F.col("ours") > F.col("theirs")).alias("losses"), F.count_if(F.col("ours") == F.col("theirs")).alias("ties"),
        F.round(F.avg("ours"), 6).alias("mean_ours"), F.round(F.avg("theirs"), 6).alias("mean_theirs"),
    )


def sign_test(pairs: DataFrame) -> tuple[int, int, float]:
    """(n, wins, p) over paired outcomes."""
    r = paired_wins(pairs).first()
    return r["n"], r["wins"], sign_tail(r["n"], r["wins"])


def sign_test_row(pairs: DataFrame) -> DataFrame:
    """paired_wins with p, the chance of so many wins or more by sign_tail, for the one row that is left."""
    x = paired_wins(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p=[round(sign_tail(int(n), int(w)), 9) for n, w in zip(pdf["n"], pdf["wins"], strict=True)])

    return x.mapInPandas(run, StructType([*x.schema.fields, StructField("p", DoubleType())]))


def unstable_share(marks: DataFrame, seconds: DataFrame, top: float = 0.05) -> DataFrame:
    """(rec_id, marks, unstable): marks in the top share of most unstable seconds (rec_id, second, instability). A mark
    before the first or after the last of these seconds counts as in the first or last."""
    limit = seconds.groupBy("rec_id").agg(F.round(F.percentile("instability", 1 - top), 9).alias("limit"), F.min("second").alias("lo"), F.max("second").alias("hi"))
    at = F.greatest("lo", F.least("hi", F.col("t").cast("int")))
    m = marks.select("rec_id", "t").join(limit, "rec_id").select("rec_id", "limit", at.cast("int").alias("second")).join(seconds, ["rec_id", "second"])
    return m.groupBy("rec_id").agg(F.count("*").alias("marks"), F.count_if(F.col("instability") >= F.col("limit")).alias("unstable"))


def random_screens(frames: DataFrame, marks: DataFrame, draws: int, delta: int = 8, seed: int = 0) -> DataFrame:
    """(rec_id, draw, instability, coverage) of random seconds in place of marks: for each draw as many different seconds
    from 1 to N - 2 as the recording has marks, or all; their mean instability and what they show of all seconds."""
    steady = instability(frames, delta)
    n = marks.groupBy("rec_id").agg(F.count("*").alias("n"))
    every = steady.join(n, "rec_id").select("rec_id", "second", "instability", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    k = F.row_number().over(Window.partitionBy("rec_id", "draw").orderBy(uniform(seed, F.col("rec_id"), F.col("draw"), F.col("second")), "second"))
    drawn = every.withColumn("k", k).where("k <= n")
    still = drawn.groupBy("rec_id", "draw").agg(F.round(F.avg("instability"), 9).alias("instability"))
    both = F.struct("rec_id", "draw").alias("rec_id")
    t = F.col("second").cast("double")
    points = every.select(both, t.alias("t"))
    at = segment_of(points, drawn.select(both, t.alias("b"), t.alias("sample")))
    pairs = at.select(F.col("rec_id.rec_id").alias("rec_id"), F.col("rec_id.draw").alias("draw"), F.col("sample").alias("a"), F.col("t").alias("b"))
    shown = same_screen(frames, pairs, delta).groupBy("rec_id", "draw").agg(F.round(F.avg("same"), 9).alias("coverage"))
    return still.join(shown, ["rec_id", "draw"])


def sigma_above_random(ours: DataFrame, random: DataFrame, value: str) -> DataFrame:
    """(rec_id, ours, random_mean, random_std, sigma): how many deviations (of the population) a recording's value lies
    above its draws; no sigma where draws do not differ."""
    r = random.groupBy("rec_id").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    x = ours.select("rec_id", F.col(value).alias("ours")).join(r, "rec_id")
    return x.select("rec_id", "ours", F.round("m", 6).alias("random_mean"), F.round("s", 6).alias("random_std"), F.round(F.when(F.col("s") > 0, (F.col("ours") - F.col("m")) / F.col("s")), 4).alias("sigma"))


def distance_p(targets: DataFrame, marks: DataFrame, spans: DataFrame, draws: int, budget: int, seed: int = 0) -> DataFrame:
    """(rec_id, ours, draws, closer, p): mean distance of targets to marks, and in how many draws random marks are as close
    or closer."""
    ours = nearest_distance(marks, targets).groupBy("rec_id").agg(F.round(F.avg("distance"), 6).alias("ours"))
    r = _random_distances(targets, spans, draws, budget, seed).groupBy("rec_id", "draw").agg(F.round(F.avg("distance"), 6).alias("mean"))
    x = ours.join(r, "rec_id").groupBy("rec_id", "ours").agg(F.count("*").alias("draws"), F.count_if(F.col("mean") <= F.col("ours")).alias("closer"))
    return x.withColumn("p", F.round(F.col("closer") / F.col("draws"), 6))


def usable_truth(truth: DataFrame, spans: DataFrame, least: int = 2, least_frames: int = 4) -> DataFrame:
    """truth (rec_id, t) within its recording (rec_id, duration, n_frames), of recordings of least_frames frames or more that
    keep `least` of them or more."""
    x = truth.join(spans.where(F.col("n_frames") >= least_frames).select("rec_id", "duration"), "rec_id").where(F.col("t") <= F.col("duration"))
    enough = x.groupBy("rec_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("rec_id")
    return x.select(*truth.columns).join(enough, "rec_id", "left_semi")


def usable_intervals(intervals: DataFrame, marks: DataFrame, least: int = 5) -> DataFrame:
    """Intervals of recordings that have `least` of them or more, and a mark."""
    enough = intervals.groupBy("rec_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("rec_id")
    return intervals.join(enough, "rec_id", "left_semi").join(marks.select("rec_id").distinct(), "rec_id", "left_semi")


def preceding_coverage(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points (rec_id, t) with the age of the last mark before or at them."""
    s = segment_of(points, marks.select("rec_id", F.col("t").alias("b"), F.col("t").alias("sample")))
    return s.select("rec_id", "t", F.when(F.col("segment") <= F.col("t"), F.col("t") - F.col("segment")).alias("age"))


def noise_floor(scores: DataFrame) -> DataFrame:
    return scores.groupBy("rec_id").agg(F.round(F.percentile("score", 0.5), 6).alias("median_score"))


def first_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that are not the same in both, by keys, each with its digests."""
    digest = lambda df, as_: df.select(*keys, F.sha2(F.col(value).cast("string"), 256).alias(as_))
    return digest(a, "left_sha256").join(digest(b, "right_sha256"), keys, "full").where(~F.col("left_sha256").eqNullSafe(F.col("right_sha256")))


def added_keys(before: DataFrame, after: DataFrame, document: str = "document") -> DataFrame:
    """(rec_id, added, removed): keys at the top of JSON documents (rec_id, document) that only the later or only the earlier
    one has; a change that adds and never takes away has nothing removed."""
    keys = lambda df, as_: df.select("rec_id", F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")).alias(as_))
    j = keys(before, "was").join(keys(after, "is"), "rec_id")
    return j.select("rec_id", F.array_sort(F.array_except("is", "was")).alias("added"), F.array_sort(F.array_except("was", "is")).alias("removed"))


def arm_totals(grades: DataFrame) -> DataFrame:
    """(arm, correct, hedge, fabricate) of graded answers (arm, grade)."""
    return grades.groupBy("arm").agg(*[F.count_if(F.col("grade") == g).alias(g) for g in ("correct", "hedge", "fabricate")])
