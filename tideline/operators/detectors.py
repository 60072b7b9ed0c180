"""Detectors to compare with: picture hashes, masked regions, coarser grids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import differing, matrices, successive


def difference_hash(frames: DataFrame, width: int = 8) -> DataFrame:
    """(rec_id, frame_ix, h): a bit for each neighbour in a row, set where the left tile is brighter; the first pair is the
    highest bit. For a grid of 9 x 8 that is 64 bits; narrower grids fill the low bits."""
    pairs = F.filter(F.transform("tiles", lambda x, i: F.struct(x.alias("x"), F.get(F.col("tiles"), i + 1).alias("y"), i.alias("i"))), lambda p: p["i"] % width != width - 1)
    h = F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, p: F.shiftleft(acc, 1).bitwiseOR((p["x"] > p["y"]).cast("long")))
    return frames.select("rec_id", "frame_ix", h.alias("h"))


def hamming_steps(hashes: DataFrame) -> DataFrame:
    """(rec_id, frame_ix, distance) to the frame before."""
    before = F.lag("h").over(Window.partitionBy("rec_id").orderBy("frame_ix"))
    return hashes.select("rec_id", "frame_ix", F.bit_count(F.col("h").bitwiseXOR(before)).alias("distance")).where("distance is not null")


def hamming_summary(steps: DataFrame) -> DataFrame:
    p = lambda q: F.round(F.percentile("distance", q), 6)
    return steps.groupBy("rec_id").agg(
        F.round(F.avg("distance"), 6).alias("mean"), p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("distance").alias("highest"), F.count_if(F.col("distance") == 0).alias("identical")
    )


def keep_changed(hashes: DataFrame, threshold: int) -> DataFrame:
    """(rec_id, frame_ix, h) of frames further than threshold from the last one that was kept; the first is kept.

    A fold in frame order, which a lag cannot express: recordings are dealt to partitions, sorted, and stream by with the
    last kept hash carried on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, last = None, None
        for batch in batches:
            keep = []
            for r, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                far = last is None or r != rec or ((h ^ last) & 0xFFFFFFFFFFFFFFFF).bit_count() > threshold
                if far:
                    rec, last = r, h
                keep.append(far)
            yield batch.filter(pa.array(keep, pa.bool_()))

    x = hashes.select("rec_id", "frame_ix", "h")
    return x.repartition("rec_id").sortWithinPartitions("rec_id", "frame_ix").mapInArrow(run, x.schema)


def coarse(x: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Grids, a row each, as blocks of factor x factor tiles: means cut to whole numbers, what does not fill a block left out."""
    if factor == 1:
        return x
    n, height = len(x), x.shape[1] // width
    h, w = height // factor, width // factor
    blocks = x[:, : height * width].reshape(n, height, width)[:, : h * factor, : w * factor].reshape(n, h, factor, w, factor)
    return (blocks.sum(axis=(2, 4), dtype=np.int64) // (factor * factor)).astype(x.dtype).reshape(n, h * w)


@dataclass(frozen=True)
class Grids:
    """How the change flags of several (factor, delta) lie one after another in a row of bytes, a bit a tile."""

    width: int
    of: tuple[tuple[int, int], ...]

    def tiles(self, n_tiles: int) -> list[int]:
        return [n_tiles if f == 1 else (n_tiles // self.width // f) * (self.width // f) for f, _ in self.of]

    def widths(self) -> list[int]:
        return [self.width if f == 1 else self.width // f for f, _ in self.of]

    def unpacked(self, rows: np.ndarray, n_tiles: int) -> Iterator[np.ndarray]:
        """Flags (rows, tiles) of each, from rows of packed bytes."""
        at = 0
        for n in self.tiles(n_tiles):
            yield np.unpackbits(rows[:, at : at + (n + 7) // 8], axis=1, count=n)
            at += (n + 7) // 8


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix of bytes."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def changed_bits(frames: DataFrame, grids: Grids) -> DataFrame:
    """(rec_id, i, n_tiles, bits): which tiles change between frames i and i + 1, for all grids in one pass over the frames: an
    eighth of a frame's bytes for each, and less for coarser ones."""

    def flags(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
        by_factor = {f: (coarse(a, grids.width, f), coarse(b, grids.width, f)) for f, _ in grids.of}
        packed = [np.packbits(differing(*by_factor[f], delta), axis=1) for f, delta in grids.of]
        return [pa.array(np.full(len(a), a.shape[1], np.int32)), _binary(np.concatenate(packed, axis=1))]

    return successive(frames, flags, "n_tiles int, bits binary")


def _by_recording(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Where runs of one recording begin and end."""
    rec = batch.column(0)
    n = len(rec)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = ~np.asarray(pa.compute.fill_null(pa.compute.equal(rec.slice(1), rec.slice(0, n - 1)), False))
    begin = np.flatnonzero(new).tolist()
    yield from zip(begin, [*begin[1:], n], strict=True)


def change_counts(bits: DataFrame, grids: Grids) -> DataFrame:
    """(rec_id, pairs, n_tiles, counts): how often each tile of each grid changes. Vectors are added up where the rows are, and
    a recording's are merged: one row for a recording and batch is shuffled, not one a tile."""
    kind = bits.schema["rec_id"].dataType.simpleString()
    schema = f"rec_id {kind}, pairs long, n_tiles int, counts binary"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, tiles = matrices(batch.column(2)), np.asarray(batch.column(1))
            at, counts = [], []
            for a, b in _by_recording(batch):
                if len(rows) > 1:  # recordings of several sizes
                    if len(set(tiles[a:b].tolist())) > 1:
                        raise ValueError("frames of one recording differ in size")
                    some = np.concatenate(rows[a:b])
                else:
                    some = rows[0][a:b]
                total = [sum(x[k : k + 1024].sum(axis=0, dtype=np.int64) for k in range(0, len(x), 1024)) for x in grids.unpacked(some, int(tiles[a]))]
                at.append((a, b - a))
                counts.append(np.concatenate(total).tobytes())
            first = pa.array([a for a, _ in at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(first), pa.array([n for _, n in at], pa.int64()), batch.column(1).take(first), pa.array(counts, pa.binary())], ["rec_id", "pairs", "n_tiles", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        n_tiles = table.column("n_tiles")
        if len(set(n_tiles.to_pylist())) > 1:
            raise ValueError("frames of one recording differ in size")
        total = np.sum([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()], axis=0, dtype=np.int64)
        return pa.table([table.column("rec_id").slice(0, 1), pa.array([pa.compute.sum(table.column("pairs")).as_py()]), n_tiles.slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["rec_id", "pairs", "n_tiles", "counts"])

    return bits.select("rec_id", "n_tiles", "bits").mapInArrow(part, schema).groupBy("rec_id").applyInArrow(merge, schema)


def _activity(frames: DataFrame, delta: int) -> DataFrame:
    kind = frames.schema["rec_id"].dataType.simpleString()
    grids = Grids(1, ((1, delta),))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (n, counts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x = np.frombuffer(counts, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(x), k))), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x / n)], ["rec_id", "tile_ix", "activity"])

    return change_counts(changed_bits(frames, grids), grids).mapInArrow(rows, f"rec_id {kind}, tile_ix int, activity double")


def tile_activity(frames: DataFrame, delta: int = 8) -> DataFrame:
    """(rec_id, tile_ix, activity): the share of frame pairs in which a tile changes."""
    return _activity(frames, delta).withColumn("activity", F.round("activity", 9))


def row_activity(activity: DataFrame, width: int = 8) -> DataFrame:
    return activity.groupBy("rec_id", F.expr(f"tile_ix div {width}").cast("int").alias("row_ix")).agg(F.round(F.avg("activity"), 6).alias("activity"))


def noise_mask(activity: DataFrame, most: float, cap: float = 0.25) -> DataFrame:
    """(rec_id, noisy, masked): the share of tiles as busy as `most` or busier, and whether few enough are to be masked."""
    x = activity.groupBy("rec_id").agg(F.avg((F.col("activity") >= most).cast("int")).alias("noisy"))
    return x.withColumn("masked", F.col("noisy") <= cap).withColumn("noisy", F.round("noisy", 9))


def largest_regions(flags: np.ndarray) -> np.ndarray:
    """Cells of the largest 4-connected group of set cells of each grid (grids, height, width): runs of a row are joined with
    those below that they overlap, in all grids at a time, until no run has a lesser label near it."""
    n, height, width = flags.shape
    out = np.zeros(n, np.int32)
    if not flags.size:
        return out
    wide = np.zeros((n * height, width + 1), np.int8)  # a column that is clear parts rows
    wide[:, :width] = flags.reshape(n * height, width) != 0
    step = np.diff(np.concatenate([[0], wide.ravel(), [0]]))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    row = begin // (width + 1)
    above = np.flatnonzero(row % height != height - 1)
    lo = np.searchsorted(end, begin[above] + width + 1, "right")
    hi = np.maximum(np.searchsorted(begin, end[above] + width + 1, "left"), lo)
    a = np.repeat(above, hi - lo)
    b = np.arange(len(a)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    label = np.arange(len(begin))
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]
    size = np.bincount(label, weights=end - begin, minlength=len(begin)).astype(np.int32)
    np.maximum.at(out, row // height, size)
    return out


def largest_region(mask: np.ndarray) -> int:
    """Cells of the largest 4-connected group of set cells."""
    return int(largest_regions(np.asarray(mask)[None])[0])


def _masks(counts: DataFrame, grids: Grids, mosts: Sequence[float], cap: float) -> DataFrame:
    """(rec_id, mask): for each grid and each of `mosts` the tiles as busy as that or busier, packed one after another; none
    where they are more than `cap` of the tiles."""
    kind = counts.schema["rec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pairs, n_tiles, counted in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                x, at, packed = np.frombuffer(counted, np.int64) / pairs, 0, []
                for n in grids.tiles(n_tiles):
                    for most in mosts:
                        busy = x[at : at + n] >= most
                        packed.append(np.packbits(busy if n and busy.mean() <= cap else np.zeros(n, bool)))
                    at += n
                out.append(np.concatenate(packed).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rec_id", "mask"])

    return counts.mapInArrow(run, f"rec_id {kind}, mask binary")


def _regions(bits: DataFrame, grids: Grids, masks: DataFrame | None, per_grid: int, finish: Callable[[pa.Array, pa.Array, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """Runs finish(rec_id, i, sizes) for runs of one recording; sizes (rows, grids x masks of each) are the largest regions. A
    recording's mask is sent once and comes before its flags in the order of the partition."""
    kind = bits.schema["rec_id"].dataType.simpleString()
    names = [c.split()[0] for c in ("rec_id " + kind + ", " + schema).split(", ")]
    x, masked = bits, masks is not None
    if masks is not None:
        x = bits.unionByName(masks.select("rec_id", F.lit(-1).alias("i"), F.lit(0).alias("n_tiles"), F.col("mask").alias("bits"))).repartition("rec_id").sortWithinPartitions("rec_id", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, mask = None, b""
        for batch in batches:
            for a, b in _by_recording(batch):
                at, tiles = np.asarray(batch.column(1))[a:b], np.asarray(batch.column(2))[a:b]
                if batch.column(0)[a].as_py() != rec:
                    rec, mask = batch.column(0)[a].as_py(), b""
                if at[0] < 0:
                    mask = batch.column(3)[a].as_py()
                    a, tiles = a + 1, tiles[1:]
                for k in range(a, b, 512):
                    m = min(b, k + 512)
                    n_tiles = int(tiles[k - a])
                    rows = matrices(batch.column(3).slice(k, m - k))
                    if len(rows) != 1:
                        raise ValueError("frames of one recording differ in size")
                    sizes, at_mask = [], 0
                    for flags, n, wide in zip(grids.unpacked(rows[0], n_tiles), grids.tiles(n_tiles), grids.widths(), strict=True):
                        for _ in range(per_grid):
                            some = np.frombuffer(mask, np.uint8)[at_mask : at_mask + (n + 7) // 8] if masked else np.zeros(0, np.uint8)
                            out = np.unpackbits(np.concatenate([some, np.zeros((n + 7) // 8 - len(some), np.uint8)]), count=n)
                            at_mask += (n + 7) // 8
                            whole = n // wide * wide if wide else 0
                            sizes.append(largest_regions((flags & (1 - out))[:, :whole].reshape(len(flags), -1, max(wide, 1))))
                    yield pa.RecordBatch.from_arrays(finish(batch.column(0).slice(k, m - k), batch.column(1).slice(k, m - k), np.stack(sizes, axis=1)), names)

    return x.mapInArrow(run, f"rec_id {kind}, {schema}")


def component_sizes(frames: DataFrame, width: int = 8, delta: int = 8, masked: DataFrame | None = None) -> DataFrame:
    """(rec_id, i, size): the largest connected region of changed tiles between frames i and i + 1.

    masked: (rec_id, tiles array<int>) of tiles that are left out.
    """
    grids = Grids(width, ((1, delta),))
    masks = None
    if masked is not None:

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for tiles in batch.column(1).to_pylist():
                    x = np.zeros(max(tiles or [0]) + 1, bool)
                    x[tiles or []] = True
                    out.append(np.packbits(x).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rec_id", "mask"])

        masks = masked.select("rec_id", "tiles").mapInArrow(pack, f"rec_id {masked.schema['rec_id'].dataType.simpleString()}, mask binary")
    return _regions(changed_bits(frames, grids), grids, masks, 1, lambda rec, i, sizes: [rec, i, pa.array(sizes[:, 0], pa.int32())], "i int, size int")


def region_marks(frames: DataFrame, width: int = 8, delta: int = 8, most: float = 0.2, least: int = 3, cap: float = 0.25, sizes: bool = False) -> DataFrame:
    """(rec_id, frame_ix): frames after changes with a connected region of `least` tiles, busy tiles masked. A detector
    that is known to do badly, to compare with. With sizes, also the size of the region."""
    grids = Grids(width, ((1, delta),))
    bits = changed_bits(frames, grids)
    masks = _masks(change_counts(bits, grids), grids, [most], cap)
    found = _regions(bits, grids, masks, 1, lambda rec, i, size: [rec, i, pa.array(size[:, 0], pa.int32())], "i int, size int").where(F.col("size") >= least)
    return found.select("rec_id", (F.col("i") + 1).alias("frame_ix"), *(["size"] if sizes else []))


def coarsen(frames: DataFrame, width: int, factor: int) -> DataFrame:
    """Frames of blocks of factor x factor tiles: means cut to whole numbers, what does not fill a block left out. Each frame
    by itself, nothing is shuffled."""
    if factor < 1:
        raise ValueError("factor must be 1 or more")
    x = frames.select("rec_id", "frame_ix", "tiles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [coarse(rows, width, factor) for rows in matrices(batch.column(2))] if batch.num_rows else []
            if pa.types.is_binary(batch.schema.field(2).type):
                tiles = [_binary(np.ascontiguousarray(g)) for g in got]
            else:
                size = np.concatenate([[0], np.cumsum([g.shape[1] for g in got for _ in g])]).astype(np.int32)
                tiles = [pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([g.ravel() for g in got]), batch.schema.field(2).type.value_type))] if got else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.concat_arrays(tiles) if tiles else batch.column(2)], ["rec_id", "frame_ix", "tiles"])

    return x.mapInArrow(run, x.schema)


def sweep(frames: DataFrame, deltas: list[int], masks: list[float], sizes: list[int], width: int = 8, factors: Sequence[int] = (1,), cap: float = 0.25) -> DataFrame:
    """(config_ix, factor, delta, most, least, rec_id, n_marks) of region_marks for all combinations: grids coarsened by each
    factor, changes by delta, busy tiles masked from `most` on, regions of `least` tiles.

    Frames are read once: all grids and deltas become bits beside each other, all masks are drawn from their counts, and the
    largest regions answer every size. Numbers run in the order of the arguments; a recording without a mark has a row of 0.
    """
    grids = Grids(width, tuple((f, d) for f in factors for d in deltas))
    bits = changed_bits(frames, grids)
    drawn = _masks(change_counts(bits, grids), grids, masks, cap)
    n = len(grids.of) * len(masks) * len(sizes)

    def count(rec: pa.Array, i: pa.Array, found: np.ndarray) -> list[pa.Array]:
        marks = (found[:, :, None] >= np.array(sizes)).sum(axis=0).ravel()
        return [rec.take(pa.array(np.zeros(n, np.int64))), pa.array(np.arange(n), pa.int32()), pa.array(marks, pa.int64())]

    counted = _regions(bits, grids, drawn, len(masks), count, "config_ix int, n_marks bigint").groupBy("rec_id", "config_ix").agg(F.sum("n_marks").alias("n_marks"))
    rows = [(k, f, d, float(m), least) for k, ((f, d), m, least) in enumerate((g, m, least) for g in grids.of for m in masks for least in sizes)]
    config = F.inline(F.array(*[F.struct(*[F.lit(v).alias(name) for v, name in zip(row, ("config_ix", "factor", "delta", "most", "least"), strict=True)]) for row in rows]))
    every = frames.select("rec_id").distinct().select("rec_id", config)
    x = every.join(counted, ["rec_id", "config_ix"], "left")
    return x.select("config_ix", "factor", "delta", "most", "least", "rec_id", F.coalesce("n_marks", F.lit(0)).cast("long").alias("n_marks"))


def best_config(results: DataFrame, hit: str = "hit") -> DataFrame:
    """The configuration (config_ix, n_marks, ...) with the fewest marks among those that hit, of equals the first; no row
    if none hits."""
    return results.where(F.col(hit)).orderBy("n_marks", "config_ix").limit(1)
