"""Merging of Burrows-Wheeler transforms of string collections by iterative interleave refinement.

Each shard has the transform of its own strings. The interleave says for each place of the merged transform which row of
which shard stands there; it is right for one symbol at first, and each pass refines it: rows are taken in the order of what
follows their first h symbols, and dealt out stably to the intervals of rows that share those h symbols. How far on that is
in a row's text, the transforms tell (the last-to-first mapping, h times). A pass adds as many symbols as the intervals that
it deals to, so passes grow as the logarithm of the depth. The intervals of all strides give the
common prefix of two neighbours, so common prefixes and intervals of repeats come with the merge, and no suffix is sorted again.
"""

from __future__ import annotations

import numpy as np


def transform(flat: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, transform) of strings flat[bounds[i]:bounds[i + 1]], each with an end mark of its own, smaller than all
    bytes and ordered by string. Suffixes are ordered by their first `depth` symbols at least. Symbol 0 stands for any end
    mark, byte b for b + 1. Place p of string i is suffix p + i of the shard's text with marks."""
    m, n = len(bounds) - 1, len(flat) + len(bounds) - 1
    text = np.zeros(n, np.int64)
    ends = bounds[1:] + np.arange(m)
    inner = np.ones(n, bool)
    inner[ends] = False
    text[inner] = flat.astype(np.int64) + m
    text[ends] = np.arange(m)  # the marks, all different
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    k = text[order]
    new = np.append(True, k[1:] != k[:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.diff(np.append(np.flatnonzero(new), n))
    tied, h = order[np.repeat(size, size) > 1], 1
    while len(tied) and h < depth:  # tied suffixes have h symbols without a mark in common, so tied + h is in the text
        group = rank[tied]
        k = group * (n + 1) + rank[tied + h]
        o = np.argsort(k)
        tied, k, group = tied[o], k[o], group[o]
        at = np.arange(len(tied))
        begin = np.append(True, group[1:] != group[:-1])
        place = group + at - np.maximum.accumulate(np.where(begin, at, 0))
        new = np.append(True, k[1:] != k[:-1])
        order[place] = tied
        rank[tied] = place[np.maximum.accumulate(np.where(new, at, 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
        h *= 2
    before = np.where(order > 0, text[order - 1], 0)
    symbol = np.where(before < m, 0, before - m + 1).astype(np.uint8)
    symbol[order == 0] = 0
    return order, symbol


def _stable(key: np.ndarray) -> np.ndarray:
    """A stable order of numbers below 2**32, by two passes over 16 bits each."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((key >> 16).astype(np.uint16)[order], kind="stable")]


def _refine(stride: tuple[np.ndarray, np.ndarray], order: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, block) right for more symbols: stride has the intervals of the first h symbols of each row and the row that
    lies h symbols on; order and block are what is known of rows at those places. block is the first place of a row's interval."""
    interval, ahead = stride
    n = len(order)
    behind = np.empty(n, np.int64)
    behind[ahead] = np.arange(n)
    rows = behind[order]  # by what follows their first h symbols
    rows = rows[_stable(interval[rows])]
    first, then = interval[rows], block[ahead[rows]]
    new = np.ones(n, bool)
    new[1:] = (first[1:] != first[:-1]) | (then[1:] != then[:-1])
    out = np.empty(n, np.int64)
    out[rows] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return rows, out


def merge(symbols: list[np.ndarray], marks: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common) of shards' transforms: the shard of each place of the merged one, and its longest common prefix
    with the place before, as far as it is below depth (depth stands for that much or more). marks: strings per shard; the
    end marks are all different, by shard and string. Rows are counted one shard after the other."""
    sizes = [len(s) for s in symbols]
    n = sum(sizes)
    starts = np.cumsum([0, *sizes[:-1]])
    # the row that lies one symbol on: rows in order of their first symbols are the transform's symbols, sorted stably
    ahead = np.concatenate([np.argsort(s, kind="stable") + at for s, at in zip(symbols, starts, strict=True)])
    first = np.concatenate([np.sort(s) for s in symbols])
    order = np.argsort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = first[order][1:] != first[order][:-1]
    new[: sum(marks)] = True
    block = np.empty(n, np.int64)
    block[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    done, left, strides = None, depth, []
    while True:
        strides.append((block, ahead))
        if left & 1:
            done = (order, block) if done is None else _refine((block, ahead), *done)
        left >>= 1
        if not left:
            break
        order, block = _refine((block, ahead), order, block)
        ahead = ahead[ahead]
    order, block = done
    common = np.full(n, depth, np.int64)
    common[0] = 0
    at = 1 + np.flatnonzero(block[order[1:]] != block[order[:-1]])
    x, y = order[at - 1], order[at]
    common[at] = 0
    for t in range(len(strides) - 1, -1, -1):  # neighbours that part: how far they go together, by strides
        interval, ahead = strides[t]
        same = np.flatnonzero(interval[x] == interval[y])
        common[at[same]] += 1 << t
        x[same], y[same] = ahead[x[same]], ahead[y[same]]
    return np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[order], common


def least_holders(strings: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """For each shard (flat, bounds, owner) and each place in it, the least owner of a string that holds the `length` bytes
    from there; the greatest integer where fewer are left."""
    made = [transform(flat, bounds, length) for flat, bounds, _ in strings]
    z, common = merge([s for _, s in made], [len(b) - 1 for _, b, _ in strings], length)
    places, starts, n = [], [], 0
    for order, _ in made:
        places.append(order + n)
        starts.append(n)
        n += len(order)
    suffix = np.empty(n, np.int64)
    suffix[np.argsort(z, kind="stable")] = np.concatenate(places)
    holder, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for (_, bounds, owner), at in zip(strings, starts, strict=True):
        size = np.diff(bounds) + 1
        holder[at : at + size.sum()] = np.repeat(owner, size)
        left[at : at + size.sum()] = np.repeat(np.cumsum(size), size) - 1 - np.arange(size.sum())
    whole = left[suffix] >= length
    top = np.iinfo(np.int64).max
    own = np.where(whole, holder[suffix], top)
    interval = np.flatnonzero(common < length)
    least = np.empty(n, np.int64)
    least[suffix] = np.repeat(np.minimum.reduceat(own, interval), np.diff(np.append(interval, n)))
    out = []
    for (flat, bounds, _), at in zip(strings, starts, strict=True):
        mine = least[at : at + len(flat) + len(bounds) - 1]
        keep = np.ones(len(mine), bool)
        keep[bounds[1:] + np.arange(len(bounds) - 1)] = False
        out.append(mine[keep])
    return out
