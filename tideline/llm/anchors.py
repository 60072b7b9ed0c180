"""Windows of a fixed length and the anchors that own them, for texts laid end to end in one byte array."""

from __future__ import annotations

import numpy as np

from .tokens import mix64, span_hashes

_rng = np.random.Generator(np.random.PCG64(20_240_501))
#: A random 64-bit value for each byte, and the odd base of the polynomial hash with its inverse modulo 2**64.
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


class Powers:
    """Powers of the base and of its inverse, grown as needed and kept by the worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            n = int(n * 1.2) + 1024
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))


def gram_sums(flat: np.ndarray, value: np.ndarray = _BYTE) -> np.ndarray:
    """Prefix sums of the polynomial hash of a piece; (sums[e] - sums[b]) times the inverse power of b hashes flat[b:e]."""
    n = len(flat)
    Powers.to(n + 1)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(value[flat] * Powers.up[:n], out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[begin]) * Powers.down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Spans of this many bytes or more are hashed byte by byte: a polynomial modulo 2**64 has pairs that no table of values parts
#: (runs of two bytes in the order of Thue and Morse), from 1,024 bytes on.
LONG = 512


def whole_hash(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Hashes of flat[begin:end] in which each byte counts by its place; spans may overlap and are laid out in pieces."""
    out = np.empty(len(begin), np.uint64)
    total = np.concatenate([[0], np.cumsum(end - begin)])
    k = 0
    while k < len(begin):
        m = max(k + 1, int(np.searchsorted(total, total[k] + step, "right")) - 1)
        at = total[k : m + 1] - total[k]
        laid = flat[np.repeat(begin[k:m] - at[:-1], np.diff(at)) + np.arange(at[-1])]
        out[k:m] = span_hashes(laid, at[:-1], at[1:])
        k = m
    return out


def anchored_runs(flat: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, key, context, doc) of runs of windows that one anchor owns.

    A window of `length` bytes is owned by its least gram of `gram` bytes (by hash; of equal ones the leftmost), so equal
    windows have equal anchors at equal distances. first and last are the starts of a run's first and last window; key
    hashes the anchor's gram and context the run's bytes, flat[first:last + length].
    """
    n = len(flat)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    sums = gram_sums(flat)
    g = n - gram + 1
    h = mix64((sums[gram:] - sums[:g]) * Powers.down[:g])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(g, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:  # least of the next 2, 4, 8, ...
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by window start; n - length + 1 of them
    inside = np.zeros(len(anchor) + 1, np.int8)
    size = np.diff(offsets)
    fits = size >= length
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, offsets[1:][fits] - length + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    new = np.empty(len(anchor), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    # a window that ends with its text and the next text's first one may follow each other with no gap between
    starts = offsets[:-1][fits]
    new[starts[starts < len(new)]] = True
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    doc = np.searchsorted(offsets, first, "right") - 1
    context = span_hash(sums, first, stop + length) if length < LONG else whole_hash(flat, first, stop + length)
    return first, stop, h[anchor[first]], context, doc
