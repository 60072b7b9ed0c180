"""Change scores of successive frames and the moments that matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import differing, successive
from .runs import group_starts, whole_groups


def guard(fps: float = 1.0, budget: int = 0, min_gap_s: float = 0.0, delta: int = 0) -> None:
    if not fps > 0:
        raise ValueError("fps must be above zero")
    if budget < 0 or min_gap_s < 0 or delta < 0:
        raise ValueError("budget, min_gap_s and delta must not be negative")


def changed(a: Column, b: Column, delta: int) -> Column:
    """How many tiles differ by more than delta; tiles are integers wide enough to subtract."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y) > delta), lambda z: z))


def change_scores(frames: DataFrame, delta: int = 8) -> DataFrame:
    """(rec_id, i, score) for frames (rec_id, frame_ix, tiles array<int>): element i lies between frames i and i + 1."""
    guard(delta=delta)
    before = F.lag("tiles").over(Window.partitionBy("rec_id").orderBy("frame_ix"))
    return frames.withColumn("before", before).where("before is not null").select("rec_id", (F.col("frame_ix") - 1).alias("i"), changed(F.col("before"), F.col("tiles"), delta).alias("score"))


def change_scores_binary(frames: DataFrame, delta: int = 8) -> DataFrame:
    """The same for tiles as BINARY, a byte per tile: frames are compared where they are, and only those at the ends of batches
    are sent on."""
    guard(delta=delta)

    def count(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.count_nonzero(differing(a, b, delta), axis=1), pa.int32())]

    return successive(frames, count, "score int")


#: Steps of a block of scores.
BLOCK_STEPS = 4_096


def _reach(fps: float, min_gap_s: float) -> int:
    """The greatest distance in steps that is too near; a distance in seconds is steps times 1 / fps."""
    n = max(0, int(min_gap_s * fps) - 2)
    while (n + 1) * (1.0 / fps) < min_gap_s:
        n += 1
    return n


def _spaced(i: np.ndarray, s: np.ndarray, taken: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None, reach: int) -> np.ndarray:
    """1 for elements that the greedy choice takes, 2 for those that it leaves, 0 where that hangs on what lies outside of
    places lo to hi, which an element's group sees (None: nothing does). i ascends; `taken` are known to be.

    By falling score, equal ones by place: an element goes in unless one that is in, or may be, lies within reach.
    """
    out = np.zeros(len(i), np.int8)
    left, right = np.searchsorted(i, i - reach, "left").tolist(), np.searchsorted(i, i + reach, "right").tolist()
    near = bytearray(len(i))  # one that is in lies within reach
    doubt = np.zeros(len(i), bool)  # one that may be in does, or what lies outside
    if lo is not None:
        doubt |= i - reach < lo
    if hi is not None:
        doubt |= i + reach > hi
    doubt = bytearray(doubt.tobytes())
    for k in np.flatnonzero(taken).tolist():
        out[k] = 1
        near[left[k] : right[k]] = b"\1" * (right[k] - left[k])
    for k in np.lexsort((i, -s)).tolist():
        if near[k]:
            out[k] = out[k] or 2
        elif doubt[k]:
            doubt[left[k] : right[k]] = b"\1" * (right[k] - left[k])
        else:
            out[k] = 1
            near[left[k] : right[k]] = b"\1" * (right[k] - left[k])
    return out


def _laid(i: np.ndarray, new: np.ndarray, reach: int) -> np.ndarray:
    """How far to move each group's places, so that groups follow each other without meeting."""
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    length = i[last] - i[first] + 2 * reach + 2
    return (np.cumsum(length) - length - i[first])[np.cumsum(new) - 1]


def _peeled(scores: DataFrame, steps: int, reach: int, most: int | None, kind: str) -> DataFrame:
    """(rec_id, i, score, state) of positive scores, by blocks of `steps` that also see their neighbours' scores for some
    reaches beyond: 1 for those that are taken, of which the block's `most` greatest are enough; 2 for others that are taken
    but may be near an open one of another block; 0 for those that hang on what lies further away."""
    halo = 8 * reach
    width = max(steps, 4 * halo)
    block = F.expr(f"i div {width}L")
    at = F.col("i") - block * width
    near = F.array_compact(F.array(block, F.when(at < halo, block - 1), F.when(at >= width - halo, block + 1)))
    x = scores.where("score > 0").select("rec_id", F.col("i").cast("int"), F.col("score").cast("int")).select("rec_id", F.explode(near).alias("block"), "i", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            new = group_starts([table.column("rec_id"), table.column("block")])
            block, i, s = (table.column(c).to_numpy().astype(np.int64) for c in ("block", "i", "score"))
            shift = _laid(i, new, reach)
            lo = np.where(block > 0, block * width - halo, np.iinfo(np.int32).min) + shift
            out = _spaced(i + shift, s, np.zeros(len(i), bool), lo, (block + 1) * width + halo - 1 + shift, reach)
            own = np.flatnonzero((out < 2) & (i >= block * width) & (i < (block + 1) * width))
            state, at = out[own], i[own] - block[own] * width
            if most is not None:
                group = (np.cumsum(new) - 1)[own]
                order = np.lexsort((i[own], -s[own], state != 1, group))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order)) - np.searchsorted(group[order], group[order], "left")
                state[(state == 1) & (place >= most)] = 2
            stay = (state < 2) | (at < reach) | (at >= width - reach)
            rows = pa.array(own[stay])
            yield from pa.table([table.column("rec_id").take(rows), table.column("i").take(rows), table.column("score").take(rows), pa.array(state[stay], pa.int8())], ["rec_id", "i", "score", "state"]).to_batches()

    dealt = x.repartition("rec_id", "block").sortWithinPartitions("rec_id", "block", "i")
    return dealt.mapInArrow(run, f"rec_id {kind}, i int, score int, state tinyint")


def _finished(peeled: DataFrame, of: DataFrame, reach: int, fps: float, kind: str) -> DataFrame:
    """Marks from what blocks have left of each recording, and its row (rec_id, n, budget): open scores are decided, then the
    budget cuts by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1):
            new = group_starts([table.column("rec_id")])
            i, s, state = (table.column(c).to_numpy().astype(np.int64) for c in ("i", "score", "state"))
            group = np.cumsum(new) - 1
            n, budget = (np.zeros(group[-1] + 1, np.int64) for _ in range(2))
            row = np.flatnonzero(i < 0)
            n[group[row]], budget[group[row]] = (table.column(c).take(pa.array(row)).fill_null(0).to_numpy() for c in ("n", "budget"))
            if ((state == 0) & (i >= 0)).any():
                some = np.flatnonzero(i >= 0)
                moved = i[some] + _laid(i[some], np.append(True, group[some][1:] != group[some][:-1]), reach)
                out = _spaced(moved, s[some], state[some] > 0, None, None, reach)
                state[some[(state[some] == 0) & (out == 1)]] = 1
            taken = np.flatnonzero((state == 1) & (i >= 0))
            taken = taken[np.lexsort((i[taken], -s[taken], group[taken]))]
            place = np.arange(len(taken)) - np.searchsorted(group[taken], group[taken], "left")
            taken = np.sort(taken[place < budget[group[taken]]])  # rows come by recording and time
            t = (i[taken] + 1) / float(fps)
            end = n[group[taken]] / float(fps)
            same = group[taken][1:] == group[taken][:-1]
            end[:-1][same] = t[1:][same]
            yield pa.RecordBatch.from_arrays([table.column("rec_id").take(pa.array(taken)).combine_chunks(), pa.array(t), pa.array(s[taken], pa.int32()), pa.array((t + end) / 2)], ["rec_id", "t", "score", "look"])

    rows = peeled.withColumns({"n": F.lit(None).cast("long"), "budget": F.lit(None).cast("long")})
    heads = of.select("rec_id", F.lit(-1).alias("i"), F.lit(0).alias("score"), F.lit(0).cast("tinyint").alias("state"), F.col("n").cast("long"), F.col("budget").cast("long"))
    return rows.unionByName(heads).repartition("rec_id").sortWithinPartitions("rec_id", "i").mapInArrow(run, f"rec_id {kind}, t double, score int, look double")


def select_marks(scores: DataFrame, fps: float = 1.0, budget: int | Column = 40, min_gap_s: float = 5.0, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """(rec_id, t, score, look): the greatest scores that keep min_gap_s apart, in time order.

    scores: (rec_id, i, score). Scores are taken by falling value, equal ones by time, each if it is min_gap_s or more from
    all taken before (a distance is steps times 1 / fps). Zero scores are never taken, so budget is a ceiling; it may be a
    column that is constant within a recording. look lies midway to the next mark, after the last one to the end.

    What is greatest within its reach is taken wherever it is, so blocks of a recording decide side by side, with some of
    their neighbours' scores in view; taking one never hangs on lesser ones, so the budget cuts the choice by rank, in blocks
    and then in recordings. What comes together for a recording are a budget for each block and scores that hang on places
    further away than a block sees, as along a slope that rises through it.
    """
    guard(fps, budget if isinstance(budget, int) else 0, min_gap_s)
    limit = F.lit(budget) if isinstance(budget, int) else budget
    of = scores.groupBy("rec_id").agg(F.count("*").alias("n"), F.max(limit).cast("long").alias("budget"))
    reach, kind = _reach(fps, min_gap_s), scores.schema["rec_id"].dataType.simpleString()
    if reach:
        peeled = _peeled(scores, block_steps, reach, budget if isinstance(budget, int) else None, kind)
        return _finished(peeled, of, reach, fps, kind)
    # nothing is too near: the budget alone cuts
    best = [F.desc("score"), F.col("i")]
    some = scores.where("score > 0").withColumn("block", F.expr(f"i div {block_steps}"))
    if isinstance(budget, int):
        some = some.withColumn("k", F.row_number().over(Window.partitionBy("rec_id", "block").orderBy(*best))).where(F.col("k") <= budget)
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("rec_id").orderBy(*best))).join(of.drop("budget") if isinstance(budget, int) else of, "rec_id")
    some = some.where(F.col("k") <= (F.lit(budget) if isinstance(budget, int) else F.col("budget")))
    marks = some.select("rec_id", "n", ((F.col("i") + 1) / F.lit(float(fps))).alias("t"), F.col("score").cast("int").alias("score"))
    end = F.coalesce(F.lead("t").over(Window.partitionBy("rec_id").orderBy("t")), F.col("n") / F.lit(float(fps)))
    return marks.select("rec_id", "t", "score", ((F.col("t") + end) / 2).alias("look"))


def mark_gaps(marks: DataFrame) -> DataFrame:
    """(rec_id, n_gaps, median_gap, p90_gap, max_gap) of the distances between successive marks."""
    x = marks.withColumn("gap", F.lead("t").over(Window.partitionBy("rec_id").orderBy("t")) - F.col("t")).where("gap is not null")
    return x.groupBy("rec_id").agg(F.count("*").alias("n_gaps"), F.round(F.percentile("gap", 0.5), 6).alias("median_gap"), F.round(F.percentile("gap", 0.9), 6).alias("p90_gap"), F.max("gap").alias("max_gap"))


def marks_per_bucket(marks: DataFrame, seconds: float = 300.0) -> DataFrame:
    return marks.groupBy("rec_id", F.floor(F.col("t") / seconds).alias("bucket")).agg(F.count("*").alias("n_marks"))


def score_percentiles(scores: DataFrame) -> DataFrame:
    """(rec_id, median, p90, p99, highest, mean, std): std is the population's."""
    p = lambda q: F.round(F.percentile("score", q), 6)
    return scores.groupBy("rec_id").agg(
        p(0.5).alias("median"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("score").alias("highest"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std")
    )
