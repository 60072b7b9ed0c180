"""Kernels over pairs of frames: successive ones where they are, and chosen ones block by block.

Tiles are BINARY, a byte each, or ARRAY<INT>; a kernel sees them as matrices with a row for each frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of frames that a kernel works on at a time.
SLICE = 1 << 21
#: What a row of a frame that waits for its neighbours stands for: the first of a run of successive frames, the last, or both.
_FIRST, _LAST, _BOTH = 1, 2, 3

#: From two matrices, of frames and of those that follow them, to a column for each field, a row for each pair.
Kernel = Callable[[np.ndarray, np.ndarray], list[pa.Array]]


def matrices(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of tiles as one matrix, without a copy, if all are as long as each other; else one by one."""
    if column.null_count:
        raise ValueError("a frame has no tiles")
    buffers = column.buffers()
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_list(column.type)
    at = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.values.to_numpy(zero_copy_only=False)
    else:
        flat = np.frombuffer(buffers[2] or b"", np.uint8)
    size = np.diff(at)
    if len(size) and (size == size[0]).all():
        return [flat[at[0] : at[-1]].reshape(len(size), -1)]
    return [flat[i:j].reshape(1, -1) for i, j in zip(at[:-1], at[1:], strict=True)]


def differing(a: np.ndarray, b: np.ndarray, delta: int) -> np.ndarray:
    """Which tiles differ by more than delta."""
    if a.dtype == np.uint8:
        return np.maximum(a, b) - np.minimum(a, b) > min(delta, 255)  # of bytes, without widening them
    return np.abs(a - b) > delta


def _run(x: np.ndarray, kernel: Kernel) -> Iterator[list[pa.Array]]:
    step = max(1, SLICE // max(1, x.shape[1] * x.itemsize))
    for k in range(0, len(x) - 1, step):
        a, b = x[k : k + step], x[k + 1 : k + step + 1]
        yield kernel(a[: len(b)], b)


def successive(frames: DataFrame, kernel: Kernel, fields: str) -> DataFrame:
    """(rec_id, i, fields...): the kernel's row for each frame and the one before it in its recording, where i is the later
    frame's index less one, as a score lies between frames i and i + 1.

    Frames (rec_id, frame_ix, tiles) are paired where they are: within each batch, as it comes from the source, runs of
    successive frames are settled, and only their first and last frames are sent on, to be paired across batches. So what is
    shuffled is some frames a batch where recordings come in order, and every frame once where they do not.
    """
    kind, tiles = (frames.schema[c].dataType.simpleString() for c in ("rec_id", "tiles"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rec, ix = batch.column(0), np.asarray(batch.column(1))
            rows = matrices(batch.column(2))
            same = np.zeros(n, bool)
            if n > 1 and len(rows) == 1:  # pictures of several sizes are each paired further on
                same[1:] = np.asarray(pa.compute.fill_null(pa.compute.equal(rec.slice(1), rec.slice(0, n - 1)), False)) & (ix[1:] == ix[:-1] + 1)
            begin = np.flatnonzero(~same).tolist()
            got = [part for a, b in zip(begin, [*begin[1:], n], strict=True) for part in _run(rows[0][a:b], kernel)] if len(rows) == 1 else []
            ends = np.append(~same[1:], True)
            edge, inner = np.flatnonzero(~same | ends), np.flatnonzero(same)
            role = np.where(~same, np.where(ends, _BOTH, _FIRST), _LAST)[edge].astype(np.int8)
            place = [rec.take(pa.array(np.concatenate([inner, edge]))), pa.array(np.concatenate([ix[inner] - 1, ix[edge]]), pa.int32()), pa.array(np.concatenate([np.zeros(len(inner), np.int8), role]))]
            values = [pa.concat_arrays([p[k] for p in got] + [pa.nulls(len(edge), t)]) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*place, pa.concat_arrays([pa.nulls(len(inner), batch.column(2).type), batch.column(2).take(pa.array(edge))]), *values], ["rec_id", "i", "role", "tiles", *names])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, last = None, None
        for batch in batches:
            role = np.asarray(batch.column(2))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(role == 0)) for k, c in enumerate(batch.columns) if k not in (2, 3)], ["rec_id", "i", *names])
            edge = np.flatnonzero(role)
            some = batch.take(pa.array(edge))
            pictures = matrices(some.column(3)) if len(edge) else []
            pictures = list(pictures[0][:, None]) if len(pictures) == 1 else pictures
            where, got = [], []
            for k, (r, x) in enumerate(zip(some.column(0).to_pylist(), pictures, strict=True)):
                if role[edge[k]] != _LAST and last is not None and r == rec:
                    if x.shape != last.shape:
                        raise ValueError("frames of one recording differ in size")
                    got.append(kernel(last, x))
                    where.append(k)
                rec, last = r, x.copy() if role[edge[k]] != _FIRST else (last if r == rec else None)
            if where:
                at = pa.array(where)
                before = pa.array(np.asarray(some.column(1))[where] - 1, pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), before, *(pa.concat_arrays([p[k] for p in got]) for k in range(len(names)))], ["rec_id", "i", *names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(fields))
    names, types = out.names, out.types
    slim = frames.select("rec_id", F.col("frame_ix").cast("int"), "tiles")
    edges = slim.mapInArrow(settle, f"rec_id {kind}, i int, role tinyint, tiles {tiles}, {fields}")
    return edges.repartition("rec_id").sortWithinPartitions("rec_id", "i").mapInArrow(pair, f"rec_id {kind}, i int, {fields}")


def chosen(frames: DataFrame, pairs: DataFrame, kernel: Kernel, fields: str, block: int = 256) -> DataFrame:
    """(rec_id, a, b, fields...): the kernel's row for each distinct pair (rec_id, a, b) of frames.

    Pairs are dealt to blocks of `block` frames by `block` frames, and each block is sent the frames that its pairs name, once
    each: a frame travels as often as there are blocks that name it, not as often as there are pairs.
    """
    kind = frames.schema["rec_id"].dataType.simpleString()
    p = pairs.select("rec_id", F.col("a").cast("int"), F.col("b").cast("int")).withColumns({"ka": F.expr(f"a div {block}").cast("int"), "kb": F.expr(f"b div {block}").cast("int")})
    need = p.select("rec_id", "ka", "kb", F.explode(F.array("a", "b")).alias("frame_ix")).distinct()
    sent = need.join(frames.select("rec_id", F.col("frame_ix").cast("int"), "tiles"), ["rec_id", "frame_ix"])
    sent = sent.select(*[F.col(c).alias(c) for c in ("rec_id", "ka", "kb", "frame_ix", "tiles")])  # columns of their own

    def run(pairs_: pa.Table, frames_: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t) for t in (pairs_.schema.field(0).type, pa.int32(), pa.int32(), *types)], ["rec_id", "a", "b", *names])
        if not pairs_.num_rows or not frames_.num_rows:
            return empty
        frames_ = frames_.combine_chunks()
        rows = matrices(frames_.column("tiles").chunk(0))
        if len(rows) > 1:
            raise ValueError("frames of one recording differ in size")
        ix = frames_.column("frame_ix").to_numpy()
        order = np.argsort(ix)
        a, b = (x.astype(np.int32) for x in np.divmod(np.unique(pairs_.column("a").to_numpy().astype(np.int64) << 32 | pairs_.column("b").to_numpy()), 1 << 32))
        at = [np.minimum(np.searchsorted(ix[order], x), len(ix) - 1) for x in (a, b)]
        have = np.flatnonzero((ix[order][at[0]] == a) & (ix[order][at[1]] == b))
        got = []
        step = max(1, SLICE // max(1, rows[0].shape[1] * rows[0].itemsize))
        for k in range(0, len(have), step):
            some = have[k : k + step]
            got.append(kernel(rows[0][order[at[0][some]]], rows[0][order[at[1][some]]]))
        if not got:
            return empty
        values = [pa.concat_arrays([g[k] for g in got]) for k in range(len(names))]
        return pa.table([pairs_.column("rec_id").take(pa.array(have)), pa.array(a[have]), pa.array(b[have]), *values], ["rec_id", "a", "b", *names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(fields))
    names, types = out.names, out.types
    by = lambda df: df.groupBy("rec_id", "ka", "kb")
    return by(p).cogroup(by(sent)).applyInArrow(run, f"rec_id {kind}, a int, b int, {fields}")
