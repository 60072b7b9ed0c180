"""Quality rules on repetition by suffix arrays.

A suffix array of words per document, with its longest common prefixes, gives at each place the longest substring that
is repeated from there; the spans of all maximal repeats are united, and the covered fraction and the longest repeat are
limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import STARTS, Words, mix64, pieces, span_hashes

#: A repeat counts from LEAST words on; a document fails if such repeats cover more than COVERED of 100 words, or if one
#: repeat is longer than LONGEST words.
LEAST, COVERED, LONGEST = 12, 30, 100
MIN_WORDS, REPEATED = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def suffix_array(first: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, levels) over the items of all documents at once; first has each document's first item, and the end.

    Prefix doubling that sorts only what is still tied. levels[t][i] == levels[t][j] just if the 2**t items from i and
    from j are the same and lie in one document each; documents have no items in common, as key holds the document.
    """
    n = len(key)
    end = np.repeat(first[1:], np.diff(first))
    order = np.argsort(key)
    k = key[order]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    at = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = at
    levels, h = [rank[:n].astype(np.int32)], 1
    size = np.diff(np.append(np.flatnonzero(new), n))
    tied = order[np.repeat(size, size) > 1]
    while len(tied):
        group = rank[tied]
        there = tied + h
        second = np.where(there < end[tied], rank[np.minimum(there, n)] + 1, 0)
        k = group * (n + 2) + second
        o = np.argsort(k)
        tied, k, group = tied[o], k[o], group[o]
        m = np.arange(len(tied))
        start = np.ones(len(tied), bool)
        start[1:] = group[1:] != group[:-1]
        place = group + m - np.maximum.accumulate(np.where(start, m, 0))  # in the suffix array
        new = np.ones(len(tied), bool)
        new[1:] = k[1:] != k[:-1]
        order[place] = tied
        rank[tied] = place[np.maximum.accumulate(np.where(new, m, 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
        h *= 2
        levels.append(rank[:n].astype(np.int32))
    return order, levels


def longest_repeats(first: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each item the length of the longest repeated substring of its document that begins there."""
    n = len(key)
    out = np.zeros(n + 1, np.int64)
    if n < 2:
        return out[:n]
    order, levels = suffix_array(first, key)
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[pair].astype(np.int64), order[pair + 1].astype(np.int64)
    lcp = np.zeros(len(pair), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < n) & (y < n)
        same = inside & (levels[t][np.minimum(x, n - 1)] == levels[t][np.minimum(y, n - 1)])
        lcp += same * (1 << t)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out[:n]


def covered(first: np.ndarray, longest: np.ndarray, least: int, only: int | None = None) -> np.ndarray:
    """How many items of each document lie in repeats of `least` items or more; only: in windows of that many items."""
    n = len(longest)
    step = np.zeros(n + 1, np.int64)
    i = np.flatnonzero(longest >= least)
    np.add.at(step, i, 1)
    np.add.at(step, i + (longest[i] if only is None else only), -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(step[:n]) > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def repeated_lines(words: Words, texts: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document, per document."""
    flat, offsets = words.raw, words.offsets
    breaks = np.flatnonzero(flat == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    # with a text's end before the next one's first line, both lists pair up in order
    doc = np.searchsorted(offsets, begin, "right") - 1
    some = np.searchsorted(words.begin, end) > np.searchsorted(words.begin, begin)
    begin, end, doc = begin[some], end[some], doc[some]
    k = mix64(span_hashes(flat, begin, end) ^ mix64(doc.astype(np.uint64)))
    u, at = np.unique(k, return_index=True)
    return np.bincount(doc, minlength=texts) - np.bincount(doc[at], minlength=texts)


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """All that the rules look at, by document."""
    w = Words(texts)
    n = len(w.offsets) - 1
    key = mix64(w.hash ^ mix64(w.doc.astype(np.uint64) + np.uint64(1)))
    longest = longest_repeats(w.first, key)
    sums = lambda per_byte: np.concatenate([[0], np.cumsum(per_byte)])
    chars, symbols = sums(STARTS[w.raw]), sums(_SYMBOL[w.raw])
    in_words = sums(chars[w.end] - chars[w.begin])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, w.doc, longest)
    return {
        "n_words": w.count.astype(np.int64), "word_chars": in_words[w.first[1:]] - in_words[w.first[:-1]], "n_symbols": symbols[w.offsets[1:]] - symbols[w.offsets[:-1]],
        "n_dup_lines": repeated_lines(w, n), "n_repeat_words": covered(w.first, longest, 3, 3), "n_covered": covered(w.first, longest, LEAST), "longest_repeat": top,
    }


_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]


def _judge(m: dict[str, np.ndarray], covered_percent: int, longest_words: int) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEATED * m["n_words"])
    return failed, ~failed & (100 * m["n_covered"] <= covered_percent * m["n_words"]) & (m["longest_repeat"] <= longest_words)


def quality_report(docs: DataFrame, doc: str = "doc_id", text: str = "text", covered_percent: int = COVERED, longest_words: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_covered, longest_repeat).

    Nulls count as empty texts, which fail; repeated rows are judged each, so there are no ties; texts of any length are judged
    whole; an empty table gives an empty one; other columns take no part, whatever their names. doc is an integer column.
    """
    names = ["doc_id", *_LONGS[:5], "base_failed", "kept", *_LONGS[5:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                m = measures(part.column(1))
                m["base_failed"], m["kept"] = _judge(m, covered_percent, longest_words)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(m[c]) for c in names[1:]]], names)

    kinds = ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in names)
    return docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, kinds)


def quality_filter(docs: DataFrame, text: str = "text", covered_percent: int = COVERED, longest_words: int = LONGEST) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names. Null and empty texts fail; rows are
    judged each, so repeated ones share their fate, and there are no ties; texts of any length are judged whole; an empty
    table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                kept = _judge(measures(part.column(part.schema.get_field_index(text))), covered_percent, longest_words)[1]
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def oracle() -> str:
    """DuckDB SQL for quality_report without n_covered and longest_repeat's exact lengths (see windows below).

    A repeat of LEAST words or more is covered by its windows of LEAST words, and one longer than LONGEST words holds a
    window of LONGEST + 1 words that is found twice; so windows express both limits.
    """
    def windows(k: int) -> str:
        return f"""s{k} as (select doc_id, i, w[i:i + {k - 1}] as s from d, lateral (select unnest(generate_series(1, len(w) - {k - 1})) as i) where len(w) >= {k}),
r{k} as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as c from s{k}) where c > 1),
c{k} as (select doc_id, count(distinct i + j)::bigint as n from r{k}, (select unnest(generate_series(0, {k - 1})) as j) group by doc_id)"""

    return rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
q as (select doc_id, (count(*) - count(distinct line))::bigint as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
{windows(3)}, {windows(LEAST)}, {windows(LONGEST + 1)},
m as (select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(q.n, 0)::bigint as n_dup_lines,
  coalesce(c3.n, 0)::bigint as n_repeat_words, coalesce(c{LEAST}.n, 0)::bigint as n_covered, c{LONGEST + 1}.n is not null as long_repeat
  from d left join q using (doc_id) left join c3 using (doc_id) left join c{LEAST} using (doc_id) left join c{LONGEST + 1} using (doc_id)),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEATED} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * n_covered <= {COVERED} * n_words and not long_repeat as kept, n_covered from f"""
