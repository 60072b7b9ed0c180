"""Dedup of repeated word windows across and within documents, by Rabin-Karp hashes.

Every window of a fixed number of words has polynomial hashes. The distinct ones of a chunk of documents meet those of all
other chunks in buckets of the hash space; as chunks are ranges in the order of ids, the first chunk that holds a window
keeps it. Windows that start earlier elsewhere merge into maximal intervals of words to remove.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks_for
from .tokens import Words, mix64, pieces, tidy_group, tidy_groups

WINDOW = 20
#: Estimated bytes of a chunk of documents.
CHUNK = 32 << 20
#: The prime and base of the first hash, and the odd base of the second, which is modulo 2**64.
PRIME, BASE, BASE64 = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1), 0x9E3779B97F4A7C15
#: Bits of the first and of the second hash that travel, beside those that the bucket stands for.
LOW, MORE = 40, 32

_MESSAGE = "target int, sender int, kind int, a binary, b binary"
_NAMES = ["target", "sender", "kind", "a", "b"]
KEYS, EARLIER = range(2)


def _reduced(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(PRIME)) + (x >> np.uint64(61))


def _times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo PRIME, up to a multiple of it, for x and c below 2**61 + 8: products of halves, of 32 bits and less."""
    a, b = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    ch, cl = np.uint64(c >> 32), np.uint64(c & 0xFFFFFFFF)
    mid = a * cl + b * ch
    low = b * cl
    return _reduced(((a * ch) << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << np.uint64(32)) + _reduced(low))


def rabin_karp(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of k words, given the words' 64-bit hashes: the polynomials sum(word[i + j] * base**(k - 1 - j))
    modulo 2**61 - 1, spread by a bijection, and modulo 2**64. Windows double in length, so the cost grows with log k."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    mixed = mix64(words)
    x, y = _reduced(words), mixed
    first: np.ndarray | None = None
    second = y
    size, have, rest = 1, 0, k
    while True:
        if rest & 1:
            if first is None:
                first, second = x, y
            else:
                m = n - (have + size) + 1
                first = _reduced(_times(first[:m], pow(BASE, size, PRIME)) + x[have : have + m])
                second = second[:m] * np.uint64(pow(BASE64, size, 1 << 64)) + y[have : have + m]
            have += size
        rest >>= 1
        if not rest:
            break
        m = n - 2 * size + 1
        x = _reduced(_times(x[:m], pow(BASE, size, PRIME)) + x[size : size + m])
        y = y[:m] * np.uint64(pow(BASE64, size, 1 << 64)) + y[size : size + m]
        size *= 2
    first = np.where(first >= np.uint64(PRIME), first - np.uint64(PRIME), first)
    return mix64(first), second


def _sorted(table: pa.Table) -> pa.Table:
    """A chunk's rows by id, those without id first, and by text where ids are equal."""
    order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("body", "ascending")], null_placement="at_start")
    return table.take(order)


def _texts(table: pa.Table):
    """(ids, Words) of a sorted chunk, in pieces."""
    for batch in table.to_batches():
        for part in pieces(batch, "text", 1 << 18):
            yield part.column(1), part.column(3)


def _hashes(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of all windows of a sorted chunk, in order."""
    got = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for _, texts in _texts(table):
        words = Words(texts)
        a, b = rabin_karp(words.hash, k)
        whole = _starts(words, k)[: len(a)]
        got.append((a[whole], b[whole]))
    first, second = (np.concatenate(x) for x in zip(*got, strict=True))
    return first, second


def _starts(words: Words, k: int) -> np.ndarray:
    """Which words start a window of their text."""
    return words.first[1:][words.doc] - np.arange(len(words.begin)) >= k


def _by_key(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): by both hashes and then by place, and where another window begins in that order."""
    order = np.argsort(first)
    f = first[order]
    new = np.ones(len(f), bool)
    new[1:] = f[1:] != f[:-1]
    tied = ~new
    tied[:-1] |= tied[1:].copy()
    place = np.cumsum(new)[tied] * len(f) + order[tied]  # equal ones by place
    place.sort()
    order[tied] = place % len(f)
    s = second[order]
    if (s[1:] != s[:-1])[~new[1:]].any():  # one first hash, several second ones
        order = np.lexsort((np.arange(len(first)), second, first))
        f, s = first[order], second[order]
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    return order, new


def _bucket(first: np.ndarray, buckets: int) -> np.ndarray:
    return (first >> np.uint64(LOW)) % np.uint64(buckets)


def _messages(target: list[int], sender: int, kind: int, a: list[bytes], b: list[bytes] | None = None) -> pa.Table:
    n = len(target)
    return pa.table([pa.array(target, pa.int32()), pa.array([sender] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(a, pa.binary()), pa.array(b or [b""] * n, pa.binary())], _NAMES)


def _read(table: pa.Table, kind: int) -> list[tuple[int, bytes, bytes]]:
    """(sender, a, b) of the messages of a kind, by sender."""
    some = table.filter(pc.equal(table.column("kind"), kind))
    return sorted(zip(*(some.column(x).to_pylist() for x in ("sender", "a", "b")), strict=True), key=lambda x: x[0])


def _number_of(table: pa.Table) -> int:
    return table.column(0)[0].as_py()


def _own(first: np.ndarray, second: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(later, own, cut): the windows that the chunk itself holds before, the first ones of all others in the order in which
    they are sent, by bucket and then by key, and where each bucket begins among these."""
    order, new = _by_key(first, second)
    own = order[new]
    bucket = _bucket(first[own], n)
    bucket = bucket.astype(np.uint16) if n <= 1 << 16 else bucket
    own = own[np.argsort(bucket, kind="stable")]
    cut = np.concatenate([[0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=n))]).tolist()
    return order[~new], own, cut


def repeated_windows(docs: DataFrame, n: int, finish, schema: str, k: int) -> DataFrame:
    """Runs finish(ids, words, gone) for the texts of each chunk, piece by piece; it gives a table of `schema`.

    docs: (target, id, body, text as binary), target being the chunk, below n: a range of (id, body). gone says of each word
    whether it lies in a window that also starts earlier. Texts are dealt to chunks once; from chunk to bucket go 9 bytes for
    each distinct window, and back comes a bit, which says whether a chunk before holds it too. A window that a third of all
    documents hold is one entry a chunk. There are never more messages than windows, and no more than chunks times chunks.
    """

    def keys(table: pa.Table) -> pa.Table:  # chunk: its distinct windows
        me = _number_of(table)
        first, second = _hashes(_sorted(table), k)
        _, own, cut = _own(first, second, n)
        five = np.ascontiguousarray(first[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW // 8])
        four = second[own].astype(np.uint32)
        full = [b for b in range(n) if cut[b + 1] > cut[b]]
        return _messages(full, me, KEYS, *([x[cut[b] : cut[b + 1]].tobytes() for b in full] for x in (five, four)))

    def earlier(table: pa.Table) -> pa.Table:  # bucket: which of them a chunk before holds
        got = _read(table, KEYS)
        wide = np.zeros((sum(len(b) for _, _, b in got) // 4, 8), np.uint8)
        wide[:, : LOW // 8] = np.frombuffer(b"".join(a for _, a, _ in got), np.uint8).reshape(-1, LOW // 8)
        more = np.frombuffer(b"".join(b for _, _, b in got), np.uint32)
        low = wide.view("<u8").ravel()
        order, new = _by_key((low << np.uint64(24)) | (more >> np.uint32(8)), more)  # senders come in order
        flag = np.empty(len(low), bool)
        flag[order] = ~new
        cut = np.cumsum([0, *(len(b) // 4 for _, _, b in got)])
        return _messages([s for s, *_ in got], _number_of(table), EARLIER, [np.packbits(flag[x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)])

    def cover(table: pa.Table, replies: pa.Table) -> pa.Table:  # chunk: what goes
        if not table.num_rows:
            return _nothing(schema)
        table = _sorted(table)
        first, second = _hashes(table, k)
        later, own, cut = _own(first, second, n)
        again = np.zeros(len(first), bool)
        del first, second
        again[later] = True
        for bucket, flags, _ in _read(replies, EARLIER):
            some = own[cut[bucket] : cut[bucket + 1]]
            again[some] = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(some))
        del later, own
        out, at = [], 0
        for ids, texts in _texts(table):
            words = Words(texts, hashes=False)
            start = np.flatnonzero(_starts(words, k))
            start, at = start[again[at : at + len(start)]], at + len(start)
            step = np.zeros(len(words.begin) + 1, np.int32)
            step[start] += 1
            step[start + k] -= 1
            out.append(finish(ids, words, np.cumsum(step[:-1]) > 0))
        return pa.concat_tables(out)

    by = lambda df: df.groupBy("target")
    replies = by(by(docs).applyInArrow(tidy_group(keys), _MESSAGE)).applyInArrow(tidy_group(earlier), _MESSAGE)
    return by(docs).cogroup(by(replies)).applyInArrow(tidy_groups(cover), schema)


def _nothing(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def chunked(docs: DataFrame, doc: str, text: str, chunk_bytes: int = CHUNK) -> tuple[DataFrame, int]:
    """(target, id, body, text as binary) and the number of targets: a target counts the chunks before, which are ranges of (id, body) of about as many
    rows each. body hashes the text, so that rows of one id, or without any, need not be in one chunk. The ranges' ends, one
    a chunk, pass through the driver, and are looked up in two steps of a root of their number each."""
    key = F.struct(F.col(f"`{doc}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("body"))
    slim = docs.select(key.alias("key"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    n = chunks_for(slim, chunk_bytes)
    ends = slim.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("key"))
    ends = [r[0] for r in sorted(ends.select(F.to_json("key", {"ignoreNullFields": "false"}), "key").collect(), key=lambda r: (r[1]["id"] is not None, r[1]["id"], r[1]["body"]))][:-1]
    out = slim.select(_place(F.col("key"), ends, docs.schema[doc].dataType.simpleString()).alias("target"), "key.id", "key.body", "text")
    return out, len(ends) + 1


def _place(key: Column, ends: list[str], kind: str) -> Column:
    """How many of the ends are below a key."""
    if not ends:
        return F.lit(0)
    step = math.isqrt(len(ends)) + 1
    some = lambda xs: F.from_json(F.lit(f"[{','.join(xs)}]"), f"array<struct<id:{kind},body:bigint>>")  # noqa: E731  one constant
    below = lambda xs: F.size(F.filter(xs, lambda x: x < key))
    coarse = below(some(ends[step - 1 :: step])) * step
    return (coarse + below(F.slice(some(ends), coarse + 1, step))).cast("int")


def _check(k: int) -> None:
    if k < 1:
        raise ValueError("a window has at least one word")


def window_report(docs: DataFrame, k: int = WINDOW, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest columns of the contract: doc_id, n_words, n_removed, kept_sha256. Odd rows are as in window_dedup."""
    _check(k)

    def digest(ids: pa.Array, words: Words, gone: np.ndarray) -> pa.Table:
        flat, offsets = kept_bytes(words, gone)
        view = memoryview(flat)
        sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        sums = np.concatenate([[0], np.cumsum(gone)])
        return pa.table([ids, pa.array(words.count.astype(np.int64)), pa.array((sums[words.first[1:]] - sums[words.first[:-1]]).astype(np.int64)), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[doc].dataType.simpleString()
    return repeated_windows(*chunked(docs, doc, text), digest, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string", k)


def window_dedup(docs: DataFrame, k: int = WINDOW, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kept, spans): the words that are left, joined by one space, and the maximal runs of removed words as [begin, end).

    A window of k words (at least 1) that also starts earlier goes: in a document of smaller id, or earlier in the same one.
    So there are no ties. Rows without id come before all others; rows of one id are documents of their own, in the order
    of a hash of their text, and of equal rows one keeps what the others lose. A null text has no words, and texts of fewer
    words than a window lose none. Texts of any length are read whole. An empty table gives an empty one. Ids may have any
    type that can be ordered and written as JSON. Other columns take no part, whatever their names. Equal windows are told by 125
    bits of hash within a chunk, across chunks by 72 and those that the number of buckets adds.
    """
    _check(k)

    def kept(ids: pa.Array, words: Words, gone: np.ndarray) -> pa.Table:
        flat, offsets = kept_bytes(words, gone)
        rows = [flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        spans = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            spans.append(np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))).reshape(-1, 2).tolist())
        return pa.table([ids, pa.array(rows, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["id", "kept", "spans"])

    kind = docs.schema[doc].dataType.simpleString()
    return repeated_windows(*chunked(docs, doc, text), kept, f"id {kind}, kept string, spans array<array<bigint>>", k)


def kept_bytes(words: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each text's words that stay, one space between them."""
    stay = np.flatnonzero(~gone)
    last = np.ones(len(stay), bool)  # of its text
    last[:-1] = words.doc[stay[1:]] != words.doc[stay[:-1]]
    begin, end = words.begin[stay], words.end[stay]
    step = np.zeros(len(words.flat) + 2, np.int32)
    step[begin] += 1
    step[end] -= 1
    take = np.cumsum(step[:-2]) > 0
    flat = words.flat.copy()
    between = end[~last]  # a byte of space, as another word of the text follows
    take[between] = True
    flat[between] = 32
    sums = np.concatenate([[0], np.cumsum(take)])
    return np.ascontiguousarray(flat[take]), sums[words.offsets]


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
u as (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20),
h as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as key from u),
s as (select doc_id, i, row_number() over (partition by key order by doc_id, i) > 1 as again from h),
x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
c as (select x.*, coalesce(max(s.again::int) over (partition by x.doc_id order by x.i rows between 19 preceding and current row), 0) as gone
  from x left join s on x.doc_id = s.doc_id and x.i = s.i),
g as (select doc_id, sum(gone)::bigint as n_removed, string_agg(word, ' ' order by i) filter (where gone = 0) as kept from c group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join g on d.doc_id = g.doc_id"""
