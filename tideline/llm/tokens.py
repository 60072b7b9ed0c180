"""Words, lines and shingles of a batch of texts as numpy arrays, without a Python loop over words."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point.
STARTS = (np.arange(256) & 0xC0) != 0x80


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty. Nothing is copied unless there are nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


#: Hash values of a byte by its place in a span, for the first PLACES places; beyond, they are worked out.
PLACES = 64
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _at_place(code: np.ndarray) -> np.ndarray:
    """The value of 256 * place + byte, as if drawn for each place and byte anew: no pattern of bytes cancels out."""
    return mix64(mix64(code.astype(np.uint64) + _SALT) ^ np.uint64(0x9E3779B97F4A7C15))


_TABLE = _at_place(np.arange(PLACES * 256))


def span_hashes(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, step: int = 1 << 20, inside: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of flat[begin:end], for ascending spans that do not overlap; equal bytes have equal hashes.

    A span's hash is the mixed sum of what each byte is worth at its place. inside: which bytes lie in a span, if known.
    """
    out = np.empty(len(begin), np.uint64)
    size = end - begin
    k = 0
    while k < len(begin):  # in pieces, so that arrays stay small
        m = max(k + 1, int(np.searchsorted(end, int(begin[k]) + step, "right")))
        n = size[k:m]
        if m == k + 1 and n[0] > step:  # one long span
            sums = np.zeros(1, np.uint64)
            for a in range(0, int(n[0]), step):
                b = min(a + step, int(n[0]))
                sums += _at_place(np.arange(a, b) * 256 + flat[begin[k] + a : begin[k] + b]).sum(dtype=np.uint64)
        else:
            at = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(at, n)
            some = flat[np.repeat(begin[k:m], n) + place] if inside is None else flat[begin[k] : end[m - 1]][inside[begin[k] : end[m - 1]]]
            code = (place << 8) | some
            value = _TABLE.take(code, mode="clip")
            if len(n) and int(n.max()) > PLACES:
                far = np.flatnonzero(place >= PLACES)
                value[far] = _at_place(code[far])
            if len(n) and int(n.min()) > 0:
                sums = np.add.reduceat(value, at)
            else:
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
                sums = total[at + n] - total[at]
        out[k:m] = mix64(sums + n.astype(np.uint64) * _SALT)
        k = m
    return out


class Words:
    """The words of a batch of texts: begin, end (bytes in flat), doc (index of text), hash; first: each text's first word."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True):
        self.raw, self.offsets = buffer_of(texts)
        self.flat = LOWER[self.raw] if lower else self.raw
        n = len(self.flat)
        inside = np.empty(n + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(SPACES[self.flat], out=inside[1:-1])
        starts = inside[1:-1] & ~inside[:-2]
        edge = self.offsets[1:-1]
        edge = edge[edge < n]
        starts[edge] = inside[1:-1][edge]  # a word ends with its text
        self.begin = np.flatnonzero(starts)
        ends = inside[1:-1] & ~inside[2:]
        last = edge[edge > 0] - 1
        ends[last] = inside[1:-1][last]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), self.count)
        self.hash = span_hashes(self.flat, self.begin, self.end, inside=inside[1:-1]) if hashes else None


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of the distinct k-word shingles, sorted by doc and hash; a text of fewer words is one shingle."""
    h, n = words.hash, len(words.hash)
    run = np.zeros(n, np.uint64)
    for j in range(k):  # run[i] covers words i to i + k - 1
        run[: n - j] = mix64(run[: n - j] + h[j:] + np.uint64(j + 1))
    left = words.first[1:][words.doc] - np.arange(n)
    whole = left >= k
    doc, out = words.doc[whole], run[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        few = np.empty(len(short), np.uint64)
        few[:] = words.count[short]
        for j in range(k - 1):
            has = words.count[short] > j
            few[has] = mix64(few[has] + h[words.first[short[has]] + j] + np.uint64(77))
        doc, out = np.concatenate([doc, short]), np.concatenate([out, few])
    order = np.argsort(out)
    by_doc = doc[order]
    order = order[np.argsort(by_doc.astype(np.uint16) if len(words.count) <= 1 << 16 else by_doc, kind="stable")]
    doc, out = doc[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    return out[new], doc[new]


def give_back() -> None:
    """Returns memory that is free but held to the system: workers outlive a task, and executors have several."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def tidy(run):
    """A map over batches that gives memory back when its task ends."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def tidy_group(run):
    """The same for a function of a group's table."""

    def tidied(table):
        out = run(table)
        give_back()
        return out

    return tidied


def tidy_groups(run):
    """The same for a function of the tables of two groups."""

    def tidied(left, right):
        out = run(left, right)
        give_back()
        return out

    return tidied


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """The batch in slices of about `most` bytes of text, whole rows always, so that arrays of a slice stay small."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    k = 0
    while k < len(col):
        m = max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1)
        yield batch.slice(k, m - k)
        k = m

