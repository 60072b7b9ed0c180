"""Looks before and after in time, and overlaps of intervals, with a recording cut into blocks.

A block's last and first rows are what other blocks need of it. They are scanned, one row a block, and given back to the
blocks, which finish on their own: a recording is as many groups as it has blocks, not one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import group_starts, whole_groups

#: Seconds of a block.
BLOCK_S = 3_600.0


def block_of(t: Column | str, block_s: float) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(float(block_s)))


def around(points: DataFrame, things: DataFrame, at: str, block_s: float = BLOCK_S) -> DataFrame:
    """points (rec_id, t, ...) with prev and next: the last thing (rec_id, `at`, ...) up to t, and the first one after t, as
    structs of all its columns but rec_id. Things of one time stand in the order of their other columns; a point comes after
    the things of its time.

    Points and things are united and sorted once by time within blocks; there is no range join, which would plan a nested
    loop. Null times and recordings match nothing.
    """
    fields = [at, *[c for c in things.columns if c not in ("rec_id", at)]]
    thing = F.struct(*[F.col(f"`{c}`") for c in fields])
    p = points.select("rec_id", F.col("t").cast("double").alias("at"), F.lit(1).alias("side"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("point"))
    q = things.where(F.col(at).isNotNull() & F.col("rec_id").isNotNull()).select("rec_id", F.col(at).cast("double").alias("at"), F.lit(0).alias("side"), thing.alias("thing"))
    u = p.unionByName(q, allowMissingColumns=True).withColumn("block", block_of("at", block_s)).repartition("rec_id", "block")  # once, for both
    over = Window.partitionBy("rec_id").orderBy("block")
    ends = u.groupBy("rec_id", "block").agg(F.max("thing").alias("last"), F.min("thing").alias("first"))
    ends = ends.select(
        "rec_id", "block", F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    w = Window.partitionBy("rec_id", "block").orderBy("at", "side", "thing")
    x = u.withColumns({"prev": F.last("thing", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.first("thing", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    # a block without any time meets none: its points keep what they have, which is nothing
    x = x.where("side = 1").join(ends, ["rec_id", "block"], "left")
    return x.select("point.*", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))


def best_overlap(left: DataFrame, right: DataFrame, key: str, value: str, block_s: float = BLOCK_S) -> DataFrame:
    """(rec_id, key, value): for each interval of left (rec_id, key, start, end) the value of the interval of right (rec_id,
    start, end, value) that shares most time with it; of equals the one that starts first, then ends first, then has the
    least value. Only pairs that share some time count. A key stands for one interval of its recording.

    A sweep in order of starts: two intervals that meet do so where the later of them starts, so a block needs its own
    starts and what is open where it begins, whatever the intervals' lengths; work is in proportion to pairs and to blocks
    that an interval is open in. Intervals that are open over many blocks are handed to those alone in which one of the
    other side starts.
    """
    some = lambda df, side, what: df.where("start < end").select("rec_id", F.col("start").cast("double"), F.col("end").cast("double"), F.lit(side).alias("side"), *what)
    kind_k, kind_v = (df.schema[c].dataType.simpleString() for df, c in ((left, key), (right, value)))
    a = some(left, 0, [F.col(key).alias("k"), F.lit(None).cast(kind_v).alias("v")])
    b = some(right, 1, [F.lit(None).cast(kind_k).alias("k"), F.col(value).alias("v")])
    u = a.unionByName(b).withColumn("block", block_of("start", block_s))
    # where something of a side starts: an interval of the other side that is open there is handed to the block
    starts = u.groupBy("rec_id", "side").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    wide = u.where(block_of("end", block_s) > F.col("block"))
    other = starts.select("rec_id", (1 - F.col("side")).alias("side"), "blocks")
    reach = F.filter("blocks", lambda x: (x > F.col("block")) & (x * float(block_s) < F.col("end")))
    handed = wide.join(other, ["rec_id", "side"]).withColumn("block", F.explode(reach))
    every = u.withColumn("own", F.lit(True)).unionByName(handed.drop("blocks").withColumn("own", F.lit(False)))
    schema = f"rec_id {left.schema['rec_id'].dataType.simpleString()}, k {kind_k}, v {kind_v}, shared double, ts double, te double"
    found = every.select("rec_id", "block", "side", "own", "start", "end", "k", "v").repartition("rec_id", "block").sortWithinPartitions("rec_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            yield from _sweep(table).to_batches()

    found = found.mapInArrow(run, schema)
    first = F.min_by(F.struct("v"), F.struct((-F.col("shared")).alias("s"), F.col("ts"), F.col("te"), F.col("v")))["v"]
    return found.groupBy("rec_id", "k").agg(first.alias(value)).withColumnRenamed("k", key)


def _count_before(group: np.ndarray, value: np.ndarray, of_group: np.ndarray, of_value: np.ndarray, equal: bool) -> np.ndarray:
    """For each (of_group, of_value) how many (group, value) lie before it, in the order of groups and values; with `equal`
    equal ones count."""
    n, m = len(group), len(of_group)
    last = np.concatenate([np.zeros(n, np.int8), np.full(m, 1 if equal else -1, np.int8)])
    order = np.lexsort((last, np.concatenate([value, of_value]), np.concatenate([group, of_group])))
    before = np.cumsum(order < n)
    out = np.empty(n + m, np.int64)
    out[order] = before
    return out[n:]


def _sweep(table: pa.Table) -> pa.Table:
    """The best pair for each left interval of each block. Pairs are runs of one side's starts within an interval of the other."""
    side, own, start, end = (table.column(c).to_numpy() for c in ("side", "own", "start", "end"))
    group = np.cumsum(group_starts([table.column("rec_id"), table.column("block")]))
    v = table.column("v")
    rank = np.empty(len(v), np.int64)  # the order of values, of whatever kind
    rank[pa.compute.sort_indices(v).to_numpy()] = np.arange(len(v))
    ordered = np.lexsort((start, group))
    lefts, rights = (ordered[side[ordered] == s] for s in (0, 1))
    best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # a right one that starts in a left one, ties to this, and a left one that starts after a right one did
    for outer, inner, equal in ((lefts, rights, False), (rights, lefts, True)):
        inner = inner[own[inner]]  # the later start is this block's own
        lo = _count_before(group[inner], start[inner], group[outer], start[outer], equal)
        hi = np.maximum(_count_before(group[inner], start[inner], group[outer], end[outer], False), lo)
        for i, j in _pairs(hi - lo, lo):
            x, y = (outer[i], inner[j]) if outer is lefts else (inner[j], outer[i])
            best.append(_first_of(x, y, start, end, rank))
    x, y, shared = (np.concatenate(c) for c in zip(*best, strict=True)) if best else (np.zeros(0, np.int64),) * 3
    if len(best) > 1:
        x, y, shared = _first_of(x, y, start, end, rank)
    return pa.table([table.column("rec_id").take(pa.array(x)), table.column("k").take(pa.array(x)), v.take(pa.array(y)), pa.array(shared, pa.float64()), pa.array(start[y]), pa.array(end[y])], ["rec_id", "k", "v", "shared", "ts", "te"])


def _pairs(n: np.ndarray, lo: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for j from lo[i] on, n[i] of them, in parts of about `most` pairs."""
    total = np.concatenate([[0], np.cumsum(n)])
    k = 0
    while k < len(n):
        m = max(k + 1, int(np.searchsorted(total, total[k] + most, "right")) - 1)
        some = n[k:m]
        i = np.repeat(np.arange(k, m), some)
        yield i, lo[i] + np.arange(len(i)) - np.repeat(total[k:m] - total[k], some)
        k = m


def _first_of(x: np.ndarray, y: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (x, y) the best for each x: most shared time, then the earliest start, end and value."""
    shared = np.minimum(end[x], end[y]) - np.maximum(start[x], start[y])
    order = np.lexsort((rank[y], end[y], start[y], -shared, x))
    new = np.ones(len(order), bool)
    new[1:] = x[order][1:] != x[order][:-1]
    one = order[new]
    return x[one], y[one], shared[one]
