"""Whole groups from the sorted rows of a partition, many in one table: small groups cost no call each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute


def group_starts(columns: list[pa.Array | pa.ChunkedArray]) -> np.ndarray:
    """Which rows differ from the row before in one of the columns; the first one does."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for c in columns:
            if pa.types.is_nested(c.type):
                values = c.to_pylist()
                new[1:] |= [a != b for a, b in zip(values[1:], values[:-1], strict=True)]
            else:
                new[1:] |= ~np.asarray(pa.compute.fill_null(pa.compute.equal(c.slice(1), c.slice(0, n - 1)), False))
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups by the first `keys` columns, which rows are sorted by; of some `rows` rows, or a longer group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(group_starts([table.column(k) for k in range(keys)]))[-1])
            if last:
                yield table.slice(0, last)
                held, n = table.slice(last).combine_chunks().to_batches(), table.num_rows - last
            rows = max(rows, 2 * n) if not last else rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
