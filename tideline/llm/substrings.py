"""Exact substring dedup: bytes under a window that also starts in an earlier document go.

Windows are owned by anchors (the least gram in them), so equal windows have equal anchors. Anchors that meet in two
documents are found first; the stretches of windows that they own are compared whole; and where the stretches of an anchor
differ, as at the edges of copied passages, each different one is sent once to the anchor's bucket, where shards of them
have Burrows-Wheeler transforms that are merged by interleave refinement. Intervals with a common prefix of a window's
length tell which windows an earlier document holds.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _BYTE, LONG, anchored_runs, gram_sums, span_hash, whole_hash
from .bwt import least_holders
from .common import chunks_for
from .tokens import buffer_of, mix64, pieces

LENGTH, GRAM = 50, 24
#: An anchor with more stretches than HOT is dealt out by single windows, so that no bucket gathers it.
HOT = 20_000
#: Bytes of stretches whose transforms are merged at a time, and shards that they come in.
COLLECTION, SHARDS = 1 << 17, 8
_OTHER = mix64(_BYTE)


@dataclass
class Runs:
    """The stretches of a chunk: piece and place, key (hash of the anchor), context (hash of the bytes), document id; and
    for each the index of its (key, context) among the chunk's distinct ones."""

    piece: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    entry: np.ndarray | None = None

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, context, least doc) of the distinct entries by key and context; sets entry."""
        order = by_key(self.key, self.context, self.doc)
        k, c = self.key[order], self.context[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        self.entry = np.empty(len(k), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        return k[new], c[new], self.doc[order][new]


def by_key(key: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The order by key and then by `more`: a fast sort by key alone, and one by all of what has equal keys."""
    order = np.argsort(key)
    k = key[order]
    tied = np.zeros(len(k), bool)
    tied[1:] = k[1:] == k[:-1]
    tied[:-1] |= tied[1:]
    some = order[tied]
    order[tied] = some[np.lexsort((*(m[some] for m in reversed(more)), key[some]))]
    return order


def _texts(table: pa.Table):
    """(ids, bytes, offsets) of a chunk in pieces."""
    for batch in table.to_batches():
        for part in pieces(batch, "text", 1 << 18):
            flat, offsets = buffer_of(part.column(2))
            yield np.asarray(part.column(1)).astype(np.int64), flat, offsets


def _runs(table: pa.Table, length: int, hot: np.ndarray | None = None) -> Runs:
    """hot: sorted keys of anchors whose windows are taken one by one."""
    got: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 2, *[np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64))]
    for p, (ids, flat, offsets) in enumerate(_texts(table)):
        first, last, key, context, doc = anchored_runs(flat, offsets, length, min(GRAM, length))
        if hot is not None and len(hot) and len(first):
            is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
            if is_hot.any():
                n = (last - first + 1)[is_hot]
                start = np.repeat(first[is_hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if length < LONG:
                    k, c = (span_hash(gram_sums(flat, x), start, start + length) for x in (_BYTE, _OTHER))
                else:
                    k = whole_hash(flat, start, start + length)
                    c = mix64(whole_hash(flat, start + 1, start + length) + flat[start])
                first, last = np.concatenate([first[~is_hot], start]), np.concatenate([last[~is_hot], start])
                key, context, doc = np.concatenate([key[~is_hot], k]), np.concatenate([context[~is_hot], c]), np.concatenate([doc[~is_hot], np.repeat(doc[is_hot], n)])
        got.append((np.full(len(first), p, np.int32), first, last, key, context, ids[doc]))
    return Runs(*(np.concatenate(x) for x in zip(*got, strict=True)))


def _by_bucket(key: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """Blobs of columns for each bucket of the keys; within a bucket rows keep their order."""
    bucket = (key >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()
    full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
    return full, [[c[order[cut[b] : cut[b + 1]]].tobytes() for b in full] for c in columns]


_MESSAGE = "target int, sender int, kind int, a binary, b binary, c binary"
_NAMES = ["target", "sender", "kind", "a", "b", "c"]


def _messages(target: list[int], sender: int | list[int], kind: int, *blobs: list[bytes]) -> pa.Table:
    n = len(target)
    blobs = [*blobs, *[[b""] * n] * (3 - len(blobs))]
    senders = sender if isinstance(sender, list) else [sender] * n
    return pa.table([pa.array(target, pa.int32()), pa.array(senders, pa.int32()), pa.array([kind] * n, pa.int32()), *[pa.array(b, pa.binary()) for b in blobs]], _NAMES)


def _read(table: pa.Table, kind: int):
    """(sender, blob a, blob b, blob c) of the messages of a kind."""
    rows = zip(*(table.column(x).to_pylist() for x in range(1, 6)), strict=True)
    return [(s, a, b, c) for s, k, a, b, c in rows if k == kind]


KEYS, LIVE, ENTRIES, HOTS, FOUND, STRETCHES, MASKS = range(7)


def _flags(key: np.ndarray, table: pa.Table, buckets: int) -> np.ndarray:
    """What the buckets say of a chunk's distinct keys: 1 if it meets in more chunks, 2 if it is hot."""
    bucket = (key >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    out = np.zeros(len(key), np.uint8)
    for b, a, _, _ in _read(table, LIVE):
        out[order[cut[b] : cut[b + 1]]] = np.frombuffer(a, np.uint8)
    return out


def substring_spans(docs: DataFrame, finish, schema: str, length: int = LENGTH) -> DataFrame:
    """Runs finish(ids, bytes, offsets, covered) for the texts of each chunk, piece by piece; it gives a table of `schema`.

    docs: (id, text as binary), distinct ids. covered says of each byte whether it lies under a window of `length` bytes
    that also starts in a document of smaller id. Equal anchors and equal stretches are told by 64-bit hashes, both together
    by 128 bits; what differs under an anchor is told by the merged transforms. All is one plan, in which the texts are dealt to chunks once; messages
    between chunks and buckets are arrays in binary columns.
    """
    windows = length - min(GRAM, length) + 1  # that an anchor owns at most
    width = -(-windows // 64)
    n = chunks_for(docs)
    texts = docs.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("target"), "id", "text")

    def chunk_of(table: pa.Table) -> int:
        return table.column(0)[0].as_py()

    def keys(table: pa.Table) -> pa.Table:  # chunk: its distinct anchors, 40 bits each beside the bucket, and their stretches
        r = _runs(table, length)
        key, _, _ = r.index()
        u, count = np.unique(key, return_counts=True)
        five = u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        full, blobs = _by_bucket(u, n, np.ascontiguousarray(five), np.minimum(count, 65_535).astype(np.uint16))
        return _messages(full, chunk_of(table), KEYS, *blobs)

    def live(table: pa.Table) -> pa.Table:  # bucket: anchors of several chunks
        got = _read(table, KEYS)
        k = np.concatenate([np.frombuffer(a, np.uint8).reshape(-1, 5) for _, a, _, _ in got])
        wide = np.zeros((len(k), 8), np.uint8)
        wide[:, :5] = k
        _, inverse, chunks = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        stretches = np.bincount(inverse, weights=np.concatenate([np.frombuffer(b, np.uint16) for _, _, b, _ in got]))
        flag = ((chunks > 1) + 2 * (stretches > HOT)).astype(np.uint8)[inverse]
        cut = np.cumsum([0, *(len(b) // 2 for _, _, b, _ in got)])
        bucket = chunk_of(table)
        return _messages([s for s, *_ in got], bucket, LIVE, [flag[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)])

    def entries(table: pa.Table, replies: pa.Table) -> pa.Table:  # chunk: the stretches of anchors that meet
        r = _runs(table, length)
        key, _, _ = r.index()
        u = np.unique(key)
        flag = _flags(u, replies, n)
        hot = u[flag & 2 > 0]
        if len(hot):
            r = _runs(table, length, hot)
        key, context, doc = r.index()
        # an anchor of this chunk alone is live too if it meets in two of its documents
        group = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)]) - 1
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        per_run = group[r.entry] if len(key) else group
        top = np.full(len(begin), np.iinfo(np.int64).min)
        np.maximum.at(top, per_run, r.doc)
        low = np.minimum.reduceat(doc, begin) if len(begin) else doc
        at = np.minimum(np.searchsorted(u, key), max(len(u) - 1, 0))
        met = (flag[at] & 1 > 0) & (u[at] == key) if len(u) else np.zeros(0, bool)
        if len(hot):  # single windows are compared everywhere
            met |= ~np.isin(key, u)
        met |= (top > low)[group] if len(begin) else False
        index = np.flatnonzero(met).astype(np.uint32)
        packed = np.empty(len(index), [("key", "<u8"), ("context", "<u8"), ("doc", "<i8")])
        packed["key"], packed["context"], packed["doc"] = key[met], context[met], doc[met]
        me = chunk_of(table)
        full, blobs = _by_bucket(key[met], n, packed, index)
        return pa.concat_tables([_messages(full, me, ENTRIES, *blobs), *([_messages([me % n], me, HOTS, [hot.tobytes()])] if len(hot) else [])])

    def resolve(table: pa.Table) -> pa.Table:  # bucket: the least document of each stretch, and anchors with several
        hots = [(s, a) for s, a, _, _ in _read(table, HOTS)]
        got = _read(table, ENTRIES)
        out = [_messages([s for s, _ in hots], chunk_of(table), HOTS, [a for _, a in hots])]
        if got:
            kind = [("key", "<u8"), ("context", "<u8"), ("doc", "<i8")]
            e = np.concatenate([np.frombuffer(a, kind) for _, a, _, _ in got])
            order = by_key(*(np.ascontiguousarray(e[x]) for x in ("key", "context", "doc")))
            s = e[order]
            new_key = np.append(True, s["key"][1:] != s["key"][:-1])
            new = new_key.copy()
            new[1:] |= s["context"][1:] != s["context"][:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            several = np.bincount(np.cumsum(new_key) - 1, weights=new)[np.cumsum(new_key) - 1] > 1
            reply = np.empty(len(e), [("doc", "<i8"), ("send", "u1")])
            reply["doc"][order] = s["doc"][start]
            reply["send"][order] = several & new  # the first of its kind, of the least document
            cut = np.cumsum([0, *(len(b) // 4 for _, _, b, _ in got)])
            out.append(_messages([s for s, *_ in got], chunk_of(table), FOUND, [reply[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], [b for _, _, b, _ in got]))
        return pa.concat_tables(out)

    def found(r: Runs, entries_: int, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        least, send = np.full(entries_, np.iinfo(np.int64).max), np.zeros(entries_, bool)
        for _, a, b, _ in _read(replies, FOUND):
            x, i = np.frombuffer(a, [("doc", "<i8"), ("send", "u1")]), np.frombuffer(b, np.uint32)
            least[i], send[i] = x["doc"], x["send"] > 0
        return least, send

    def hot_of(replies: pa.Table) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(a, np.uint64) for _, a, _, _ in _read(replies, HOTS))]))

    def stretches(table: pa.Table, replies: pa.Table) -> pa.Table:  # chunk: the bytes of stretches that differ under an anchor
        r = _runs(table, length, hot_of(replies))
        key, _, doc = r.index()
        _, send = found(r, len(key), replies)
        own = np.flatnonzero(send[r.entry] & (r.doc == doc[r.entry])) if len(key) else np.zeros(0, np.int64)
        _, one = np.unique(r.entry[own], return_index=True) if len(own) else (None, np.zeros(0, np.int64))
        own = own[one]
        own = own[np.argsort(r.piece[own], kind="stable")]
        sent: list[np.ndarray] = []
        cut = np.searchsorted(r.piece[own], np.arange(int(r.piece[-1]) + 2 if len(r.piece) else 1))
        for p, (_, flat, _) in enumerate(_texts(table)):
            if p + 1 < len(cut):
                sent += [flat[a : b + length] for a, b in zip(r.first[own[cut[p] : cut[p + 1]]].tolist(), r.last[own[cut[p] : cut[p + 1]]].tolist(), strict=True)]
        bucket = ((key[r.entry[own]] >> np.uint64(40)) % np.uint64(n)).astype(np.int64) if len(own) else own
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(n + 1)).tolist()
        head = np.empty(len(own), [("key", "<u8"), ("doc", "<i8"), ("index", "<u4"), ("size", "<u4")])
        if len(own):
            head["key"], head["doc"], head["index"], head["size"] = key[r.entry[own]], r.doc[own], r.entry[own], [len(x) for x in sent]
        full = [b for b in range(n) if edge[b + 1] > edge[b]]
        part = [order[edge[b] : edge[b + 1]] for b in full]
        return _messages(full, chunk_of(table), STRETCHES, [head[x].tobytes() for x in part], [b"".join(sent[i].tobytes() for i in x.tolist()) for x in part])

    def merge(table: pa.Table) -> pa.Table:  # bucket: which windows of the stretches an earlier document holds
        got = _read(table, STRETCHES)
        head = np.concatenate([np.frombuffer(a, [("key", "<u8"), ("doc", "<i8"), ("index", "<u4"), ("size", "<u4")]) for _, a, _, _ in got])
        sender = np.concatenate([np.full(len(a) // 24, s, np.int64) for s, a, _, _ in got])
        flat = np.frombuffer(b"".join(b for _, _, b, _ in got), np.uint8)
        begin = np.cumsum(head["size"].astype(np.int64)) - head["size"]
        order = np.argsort(head["key"], kind="stable")
        mask = np.zeros((len(head), width), np.uint64)  # a bit for each window of a stretch
        size = head["size"].astype(np.int64)[order]
        key = head["key"][order]
        total = np.cumsum(size)
        # collections end with an anchor
        last_of_key = np.append(key[1:] != key[:-1], True)
        k = 0
        while k < len(order):
            m = int(np.searchsorted(total, (total[k - 1] if k else 0) + COLLECTION, "right"))
            m = max(m, k + 1)
            m += int(np.argmax(last_of_key[m - 1 :]))
            rows = order[k:m]
            shard = sender[rows] % SHARDS
            rows = rows[np.argsort(shard, kind="stable")]
            groups = [rows[sender[rows] % SHARDS == s] for s in range(SHARDS)]
            groups = [g for g in groups if len(g)]
            strings = []
            for g in groups:
                n_bytes = head["size"][g].astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(n_bytes)])
                strings.append((flat[np.repeat(begin[g] - bounds[:-1], n_bytes) + np.arange(bounds[-1])], bounds, head["doc"][g]))
            for g, (_, bounds, owner), least in zip(groups, strings, least_holders(strings, length), strict=True):
                i = np.repeat(np.arange(len(g)), np.diff(bounds))
                at = np.arange(len(i)) - bounds[:-1][i]
                gone = least < owner[i]
                np.bitwise_or.at(mask, (g[i[gone]], at[gone] >> 6), np.uint64(1) << (at[gone] & 63).astype(np.uint64))
            k = m
        some = mask.any(1)
        out: dict[int, np.ndarray] = {int(s): np.flatnonzero(some & (sender == s)) for s in np.unique(sender[some])}
        return _messages(list(out), chunk_of(table), MASKS, [mask[i].tobytes() for i in out.values()], [np.ascontiguousarray(head["index"][i]).tobytes() for i in out.values()])

    def cover(table: pa.Table, replies: pa.Table) -> pa.Table:  # chunk: what goes
        r = _runs(table, length, hot_of(replies))
        key, _, doc = r.index()
        least, _ = found(r, len(key), replies)
        mask = np.zeros((len(key), width), np.uint64)
        for _, a, b, _ in _read(replies, MASKS):
            mask[np.frombuffer(b, np.uint32)] |= np.frombuffer(a, np.uint64).reshape(-1, width)
        out = []
        gone = r.doc > least[r.entry] if len(key) else np.zeros(0, bool)
        part = mask.any(1)[r.entry] & ~gone if len(key) else gone
        piece_cut = np.searchsorted(r.piece, np.arange(int(r.piece[-1]) + 2 if len(r.piece) else 1))
        for p, (ids, flat, offsets) in enumerate(_texts(table)):
            step = np.zeros(len(flat) + 1, np.int32)
            if p + 1 < len(piece_cut):
                mine = np.arange(piece_cut[p], piece_cut[p + 1])
                whole = mine[gone[mine]]
                np.add.at(step, r.first[whole], 1)
                np.add.at(step, r.last[whole] + length, -1)
                some = mine[part[mine]]
                bits = mask[r.entry[some]] if len(some) else np.zeros((0, width), np.uint64)
                for j in range(windows):
                    hit = (bits[:, j >> 6] >> np.uint64(j & 63)) & np.uint64(1) > 0
                    if not hit.any():
                        continue
                    np.add.at(step, r.first[some[hit]] + j, 1)
                    np.add.at(step, r.first[some[hit]] + j + length, -1)
            out.append(finish(ids, flat, offsets, np.cumsum(step[:-1]) > 0))
        return pa.concat_tables(out)

    by = lambda df: df.groupBy("target")
    live_ = by(by(texts).applyInArrow(keys, _MESSAGE)).applyInArrow(live, _MESSAGE)
    found_ = by(by(texts).cogroup(by(live_)).applyInArrow(_given(entries), _MESSAGE)).applyInArrow(resolve, _MESSAGE)
    masks = by(by(texts).cogroup(by(found_)).applyInArrow(_given(stretches), _MESSAGE)).applyInArrow(merge, _MESSAGE)
    return by(texts).cogroup(by(found_.unionByName(masks))).applyInArrow(_given(cover, _empty(schema)), schema)


def _empty(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind).empty_table()


def _given(f, empty: pa.Table | None = None):
    """f for chunks that have texts; a chunk of messages alone gives nothing."""
    nothing = empty if empty is not None else _messages([], 0, 0, [])
    return lambda texts, replies: f(texts, replies) if texts.num_rows else nothing


def _spans(covered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, runs) covered in each text."""
    sums = np.concatenate([[0], np.cumsum(covered)])
    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    at = offsets[:-1][offsets[:-1] < len(covered)]
    begins[at] = covered[at]
    runs = np.concatenate([[0], np.cumsum(begins)])
    return sums[offsets[1:]] - sums[offsets[:-1]], runs[offsets[1:]] - runs[offsets[:-1]]


def _ready(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.where(F.col(f"`{doc}`").isNotNull()).select(F.col(f"`{doc}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))


def substring_report(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest columns of the contract: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. Rows without id are left out. Rows of one id are one document in this: none of them loses what
    another of them holds, and each gives a row. Texts shorter than a window stay whole.
    """

    def digest(ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray, covered: np.ndarray) -> pa.Table:
        gone, runs = _spans(covered, offsets)
        keep = [flat[a:b][~covered[a:b]].tobytes() if g else flat[a:b].tobytes() for a, b, g in zip(offsets[:-1].tolist(), offsets[1:].tolist(), gone.tolist(), strict=True)]
        return pa.table([pa.array(ids), pa.array(np.diff(offsets)), pa.array(gone.astype(np.int64)), pa.array(runs.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in keep])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return substring_spans(_ready(docs, doc, text), digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def substring_dedup(docs: DataFrame, length: int = LENGTH, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kept, spans): the remaining bytes (which may cut a code point) and the removed ranges of bytes, by document.

    length is at least 1. A null text is empty, an empty one stays; rows without id are left out; rows of one id are one
    document, so none of them loses what another of them holds, and each gives a row; of equal windows the smallest id
    keeps, so there are no ties; texts of any length are read whole; an empty table gives an empty one; other columns take
    no part, whatever their names.
    """

    def kept(ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray, covered: np.ndarray) -> pa.Table:
        rows, spans = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            rows.append(flat[a:b][~covered[a:b]].tobytes())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]])))
            spans.append(edge.astype(np.int64).reshape(-1, 2).tolist())
        return pa.table([pa.array(ids), pa.array(rows, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["id", "kept", "spans"])

    return substring_spans(_ready(docs, doc, text), kept, "id long, kept binary, spans array<array<bigint>>", length)
