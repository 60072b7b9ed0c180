"""MinHash near-dedup by tensored banding.

A document has C small collections of minhashes instead of one set per table; the key of a table is a pair of
collections, so C collections give C (C - 1) / 2 tables for the minhashes of about its square root. Documents that share
a key are candidates, and each candidate link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, partitions, release
from .components import components
from .tokens import Words, mix64, pieces, shingles, tidy, tidy_group, tidy_groups

#: COLLECTIONS collections of WIDTH minhashes: 20 and 3 make 190 tables of 6 minhashes out of 60. At a similarity of 0.8 a
#: pair shares none with a probability of 1.3e-5, at 0.85 of 2e-7; at 0.05 it shares one with 3e-6.
COLLECTIONS, WIDTH = 20, 3
_rng = np.random.Generator(np.random.PCG64(7_919))
_MULT = _rng.integers(0, 2**63, COLLECTIONS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, COLLECTIONS * WIDTH, dtype=np.uint64)
#: Size of the bitmaps by which keys and documents are sorted out where they are read.
BITS = 1 << 25
PAIRS = [(i, j) for i in range(COLLECTIONS) for j in range(i + 1, COLLECTIONS)]
#: The tables of the first round: each collection once. Most of a group's links come from these.
FIRST = [(i, i + 1) for i in range(0, COLLECTIONS, 2)]
#: Words of 64 bits in a parity signature at most.
SIGNATURE = 32
#: Shingles that meet in a cell of the last round, about; a document weighs LIGHTEST at least.
CELL, LIGHTEST = 1 << 20, 256
_COLUMNS = np.arange(COLLECTIONS)
_FIRST_OF, _SECOND_OF = (np.array([p[x] for p in PAIRS]) for x in (0, 1))


def collections_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(documents, COLLECTIONS) keys of 64 bits; hashes hold the documents' sets one after the other."""
    out = np.empty((len(starts), COLLECTIONS), np.uint64)
    for c in range(COLLECTIONS):
        key = np.zeros(len(starts), np.uint64)
        for w in range(WIDTH):
            k = c * WIDTH + w
            x = (hashes ^ _FLIP[k]) * _MULT[k]
            key = mix64(key * np.uint64(3) + np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts))
        out[:, c] = key
    return out


def signature_words(n: np.ndarray) -> np.ndarray:
    """Words in the signature of a set of n: a power of two, for 4 bits a shingle or more, up to SIGNATURE."""
    return np.minimum(1 << np.ceil(np.log2(np.maximum(n, 16) / 16)).astype(np.int64), SIGNATURE)


def signatures(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): for each of the sets of sizes n that lie one after the other the parity of its hashes by bit.

    Bits that differ between two sets are no more than hashes that only one of them has, so a pair with more such bits than
    a likeness allows has no such likeness. The halves of a signature give the one of half its length by exclusive or.
    """
    words = signature_words(n)
    at = np.concatenate([[0], np.cumsum(words)])
    doc = np.repeat(np.arange(len(n)), n)
    bit = (mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)) & (words[doc] * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at[doc] * 64 + bit, minlength=int(at[-1]) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64), at


def sketch(docs: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """(id, n, print, keys, sign) per row of docs: set size, a 128-bit digest of the set, the collections (the low halves
    of all before the high ones) and the signature. Texts without words have n = 0 and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                words = Words(part.column(1), lower=True)
                h, d = shingles(words, k)
                n = np.bincount(d, minlength=part.num_rows)
                have = np.flatnonzero(n)
                prints: list[bytes | None] = [None] * part.num_rows
                keys, signs = list(prints), list(prints)
                if len(have):
                    size = n[have]
                    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
                    key = collections_of(h, starts).view(np.uint32).reshape(-1, COLLECTIONS, 2).transpose(0, 2, 1)
                    p = np.stack([mix64(np.add.reduceat(mix64(h + np.uint64(s)), starts) + size.astype(np.uint64)) for s in (11, 12)], 1)
                    sign, at = signatures(h, size)
                    for x, i in enumerate(have.tolist()):
                        keys[i], prints[i], signs[i] = key[x].tobytes(), p[x].tobytes(), sign[at[x] : at[x + 1]].tobytes()
                binary = [pa.array(x, pa.binary()) for x in (prints, keys, signs)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *binary], ["id", "n", "print", "keys", "sign"])

    return _texts(docs, doc, text).mapInArrow(tidy(run), f"id {docs.schema[doc].dataType.simpleString()}, n long, print binary, keys binary, sign binary")


def _texts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("text"))


def sets_of(docs: DataFrame, bitmap: np.ndarray, doc: str, text: str, k: int) -> DataFrame:
    """(id, n, sets) of the rows with words whose id the bitmap may hold: the sorted set of shingle hashes, 8 bytes each. Sets
    are made from the texts when they are asked for, as only documents with a candidate need them."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(_in_bitmap(sent.value, np.asarray(batch.column(0)).astype(np.int64))))
            for part in pieces(batch, "text", 1 << 18):
                h, d = shingles(Words(part.column(1), lower=True), k)
                n = np.bincount(d, minlength=part.num_rows)
                have = np.flatnonzero(n)
                at = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(have)), pa.array(n[have].astype(np.int64)), pa.array([h[at[i] : at[i + 1]].tobytes() for i in have.tolist()], pa.binary())], ["id", "n", "sets"])

    return _texts(docs, doc, text).mapInArrow(tidy(run), "id long, n long, sets binary")


def _bit(k: np.ndarray) -> np.ndarray:
    """The bit of a fixed-size bitmap for each 64-bit value; bit_column is the same for a column."""
    k = k.view(np.uint64)
    return (k ^ (k >> np.uint64(23)) ^ (k >> np.uint64(41))) & np.uint64(BITS - 1)


def bitmap_of(values: DataFrame) -> np.ndarray:
    """Which bits the long column `k` of values sets: BITS / 8 bytes whatever the number of rows, so it may be sent to all."""
    bit = F.col("k").bitwiseXOR(F.shiftrightunsigned("k", 23)).bitwiseXOR(F.shiftrightunsigned("k", 41)).bitwiseAND(F.lit(BITS - 1))
    x = values.select(bit.alias("b")).select(F.expr("b div 32768").alias("part"), (F.col("b") % 32768).alias("at"))
    out = np.zeros(BITS, bool)
    for r in x.groupBy("part").agg(F.expr("bitmap_construct_agg(at)").alias("m")).collect():  # BITS / 32768 rows at most
        out[r["part"] * 32768 : (r["part"] + 1) * 32768] = np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little")
    return np.packbits(out)


def _in_bitmap(bitmap: np.ndarray, k: np.ndarray) -> np.ndarray:
    b = _bit(k)
    return (bitmap[(b >> np.uint64(3)).astype(np.int64)] >> (7 - (b & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _runs(key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of a row's run of equal keys), rows sorted by key and then by `more`."""
    order = np.lexsort((*reversed(more), key))
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))


def _stars(key: np.ndarray, ids: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, key, first): under each key the least id with the least of each other component; first: rows of the least ids."""
    order, start = _runs(key, comp, ids)
    k, i, c = key[order], ids[order], comp[order]
    at = np.arange(len(k))
    lead = np.ones(len(k), bool)
    lead[1:] = (c[1:] != c[:-1]) | (start[1:] == at[1:])
    lead &= start != at
    a, b = i[start[lead]], i[lead]
    return np.minimum(a, b), np.maximum(a, b), k[lead], order[start == at]


_PAIR = "a long, b long, key long"


def _pair_batch(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(key.view(np.int64))], ["a", "b", "key"])


def _smaller(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """At most so many documents at a time, as each has as many keys as there are tables."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _collections(keys: pa.Array) -> np.ndarray:
    half = np.frombuffer(b"".join(keys.to_pylist()), np.uint32).reshape(-1, 2, COLLECTIONS).astype(np.uint64)
    return half[:, 0] | half[:, 1] << np.uint64(32)


def _table_keys(c: np.ndarray, tables: list[tuple[int, int]]) -> np.ndarray:
    """The keys of all documents (rows of c) in one table after the other."""
    return np.concatenate([mix64(c[:, i] * np.uint64(5) + c[:, j] + np.uint64(i * COLLECTIONS + j)) for i, j in tables])


def _blobs(key: np.ndarray, ids: np.ndarray, comp: np.ndarray, buckets: int, extra: tuple) -> pa.RecordBatch:
    """A row of three blobs per bucket; extra: a first row of bucket -1, links that were found already."""
    bucket = (key >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    key, ids, comp = key[order], ids[order], comp[order]
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()
    full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
    rows = [[x.tobytes() for x in extra]] * bool(extra and len(extra[0])) + [[x[cut[b] : cut[b + 1]].tobytes() for x in (key, ids, comp)] for b in full]
    names = ([-1] if len(rows) > len(full) else []) + full
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *[pa.array([r[x] for r in rows], pa.binary()) for x in range(3)]], ["bucket", "key", "id", "comp"])


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for b, k, i, c in zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True):
        yield b, np.frombuffer(k, np.uint64), np.frombuffer(i, np.int64), np.frombuffer(c, np.int64)


def star_links(label: DataFrame, tables: list[tuple[int, int]]) -> DataFrame:
    """Candidate links (a, b, key): under each key the least document with the least one of each other component.

    A batch settles its own documents under a key first and sends one of them on, so a key that many documents share
    weighs no more than the number of batches.
    """
    parts = partitions(label.sparkSession)
    buckets = 4 * parts

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _smaller(batches):
            if batch.num_rows:
                key = _table_keys(_collections(batch.column(2)), tables)
                ids, comp = (np.tile(np.asarray(batch.column(x)).astype(np.int64), len(tables)) for x in (0, 1))
                a, b, k, first = _stars(key, ids, comp)
                yield _blobs(key[first], ids[first], comp[first], buckets, (k, a, b))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for b, k, i, c in _arrays(batch):
                if b < 0:
                    yield _pair_batch(i, c, k)
                else:
                    got.append((k, i, c))
        if got:
            yield _pair_batch(*_stars(*(np.concatenate(x) for x in zip(*got, strict=True)))[:3])

    sent = label.select(F.col("id").cast("long"), F.col("comp").cast("long"), "keys").mapInArrow(tidy(spread), "bucket int, key binary, id binary, comp binary")
    # links found already go anywhere; a partition's blobs are read together, and their size does not grow with the input
    # as long as the number of shuffle partitions does
    deal = F.when(F.col("bucket") < 0, F.hash("id")).otherwise(F.col("bucket"))
    return sent.withColumn("deal", deal).repartition(parts, "deal").select("bucket", "key", "id", "comp").mapInArrow(tidy(meet), _PAIR)


def repeated_keys(label: DataFrame, rows: int) -> DataFrame:
    """(key, id, comp, tab) of the keys, of all tables, that more than one document has. label: (id, comp, keys) of so many rows.

    Documents are dealt to chunks; a chunk sends the low 40 bits of each of its distinct keys to the key's bucket, in order,
    and gets a bit for each: whether another chunk has it too. Only repeated keys leave as rows. Chunks and buckets grow
    with the rows.
    """
    chunks = max(partitions(label.sparkSession), rows // 50_000 + 1)
    dealt = label.select(F.pmod(F.xxhash64("id", F.lit("chunk")), F.lit(chunks)).cast("int").alias("chunk"), F.col("id").cast("long"), F.col("comp").cast("long"), "keys")

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """(all keys, distinct keys by bucket, their counts, where each bucket begins)."""
        key = _table_keys(_collections(table.column(3)), PAIRS)
        u, count = np.unique(key, return_counts=True)
        bucket = _key_bucket(u, chunks)
        order = np.argsort(bucket, kind="stable")
        return key, u[order], count[order], np.searchsorted(bucket[order], np.arange(chunks + 1)).tolist()

    def ask(table: pa.Table) -> pa.Table:
        _, u, _, cut = keys_of(table)
        low = np.ascontiguousarray(u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        full = [b for b in range(chunks) if cut[b + 1] > cut[b]]
        me = table.column(0)[0].as_py()
        return pa.table([pa.array(full, pa.int32()), pa.array([me] * len(full), pa.int32()), pa.array([low[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())], ["bucket", "chunk", "body"])

    def answer(table: pa.Table) -> pa.Table:
        got = table.column(2).to_pylist()
        wide = np.zeros((sum(map(len, got)) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(got), np.uint8).reshape(-1, 5)
        key = wide.view("<u8").ravel()
        order = np.argsort(key, kind="stable")
        k = key[order]
        again = np.zeros(len(k), bool)
        again[1:] = k[1:] == k[:-1]
        again[:-1] |= again[1:]
        flag = np.empty(len(k), bool)
        flag[order] = again
        cut = np.cumsum([0, *(len(x) // 5 for x in got)]).tolist()
        return pa.table([table.column(1), table.column(0), pa.array([np.packbits(flag[x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["chunk", "bucket", "body"])

    def tell(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.int32())], ["key", "id", "comp", "tab"])
        key, u, count, cut = keys_of(table)
        again = count > 1
        for b, body in zip(answers.column(1).to_pylist(), answers.column(2).to_pylist(), strict=True):
            again[cut[b] : cut[b + 1]] |= np.unpackbits(np.frombuffer(body, np.uint8), count=cut[b + 1] - cut[b]) > 0
        live = np.sort(u[again])
        if not len(live):
            return tell(table.slice(0, 0), answers)
        at = np.flatnonzero(live[np.minimum(np.searchsorted(live, key), len(live) - 1)] == key)
        ids, comp = (np.asarray(table.column(x)) for x in (1, 2))
        row = at % table.num_rows
        return pa.table([pa.array(key[at].view(np.int64)), pa.array(ids[row]), pa.array(comp[row]), pa.array((at // table.num_rows).astype(np.int32))], ["key", "id", "comp", "tab"])

    asked = dealt.groupBy("chunk").applyInArrow(tidy_group(ask), "bucket int, chunk int, body binary")
    answers = asked.groupBy("bucket").applyInArrow(tidy_group(answer), "chunk int, bucket int, body binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy_groups(tell), "key long, id long, comp long, tab int")


def _key_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def entry_stars(entries: DataFrame) -> DataFrame:
    """star_links over entries (key, id, comp): the least id with the least of each other component."""
    lead = entries.groupBy("key", "comp").agg(F.min("id").alias("id"))
    least = lead.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("comps")).where("comps > 1")
    return lead.join(least, "key").where("id <> a").select("a", F.col("id").alias("b"), "key")


def cells(live: DataFrame, label: DataFrame, capacity: int) -> DataFrame:
    """(cell, side, id, comp, tab): where the documents under each live key meet. live: (key, id, tab); label: (id, comp, n).

    A key is one cell as long as its sets have no more than `capacity` shingles together. A larger one is dealt to parts by
    a second hash, and each two parts meet in a cell: side 1 only with side 2, the cells of one part (side 0) within it.
    Keys of a single component have no cell.
    """
    of_id = label.groupBy("id").agg(F.max("comp").alias("comp"), F.max("n").alias("n"))  # an id may have several texts
    rows = durable(live.join(of_id, "id"))
    weight = F.greatest("n", F.lit(LIGHTEST))
    keys = rows.groupBy("key").agg(F.ceil(F.sum(weight) / capacity).cast("int").alias("parts"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    own = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int")
    meet = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.xxhash64("key", F.least("own", o), F.greatest("own", o)).alias("cell"), F.when(F.col("own") == o, 0).when(F.col("own") < o, 1).otherwise(2).alias("side")),
    )
    x = rows.join(keys.select("key", "parts"), "key").withColumn("own", own)
    return x.select(F.explode(meet).alias("m"), "id", "comp", "tab").select("m.cell", "m.side", "id", "comp", "tab")


def _whole_cells(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column in tables of about `most` bytes; a cell is never cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            table = pa.Table.from_batches(held)
            key = np.asarray(table.column(0))
            cut = int(np.argmax(key == key[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _candidates(cell: np.ndarray, side: np.ndarray, comp: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows that share a cell, are not of one component nor of one side, and whose sizes allow the likeness. Rows
    are sorted by cell and size; the d-th round pairs each row with the d-th after it, as long as sizes allow."""
    end = np.searchsorted(cell, cell, "right")
    i, d = np.arange(len(cell)), 1
    while len(i):
        i = i[i + d < end[i]]
        i = i[100 * n[i] >= percent * n[i + d]]
        for k in range(0, len(i), 1 << 16):
            a = i[k : k + (1 << 16)]
            b = a + d
            ok = (comp[a] != comp[b]) & ((side[a] == 0) | (side[a] != side[b]))
            if ok.any():
                yield a[ok], b[ok]
        d += 1


def _first_shared(a: np.ndarray, b: np.ndarray, own: np.ndarray, tab: np.ndarray) -> np.ndarray:
    """Whether the table is the first that both share, by their collections: so a pair is looked at in one table alone."""
    same = own[a] == own[b]
    first, second = _FIRST_OF[tab[a]], _SECOND_OF[tab[a]]
    return ((same & (_COLUMNS < second[:, None])).sum(1) == 1) & same[np.arange(len(a)), first]


def _may_be_alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, sign: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """What the signatures allow; n[a] <= n[b]."""
    out = np.zeros(len(a), bool)
    words = np.diff(at)
    kind = words[a] * 65_536 + words[b]
    for u in np.unique(kind).tolist():
        these = np.flatnonzero(kind == u)
        few, many = u // 65_536, u % 65_536
        for k in range(0, len(these), 1 << 13):
            s = these[k : k + (1 << 13)]
            x, y = sign[at[a[s]][:, None] + np.arange(few)], sign[at[b[s]][:, None] + np.arange(many)]
            while y.shape[1] > few:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            out[s] = differ * (100 + percent) <= (n[a[s]] + n[b[s]]) * (100 - percent)
    return out


_AT_CELL = "cell long, side int, id long, comp long"


def open_cells(met: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(cell, side, id, comp): what has a partner in the cell that sizes, first shared table and signature all allow; a row
    for each document and cell, none for a pair. met: cells(); label: (id, n, keys, sign)."""
    parts = partitions(met.sparkSession)
    own = label.select("id", "n", F.substring("keys", 1, 4 * COLLECTIONS).alias("own"), "sign")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches, 4 << 20):
            cell, side, ids, comp, tab, n = (np.asarray(table.column(x)) for x in range(6))
            order = np.lexsort((n, cell))
            cell, side, ids, comp, tab, n = (x[order] for x in (cell, side, ids, comp, tab, n))
            own = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint32).reshape(-1, COLLECTIONS)[order]
            signs = table.column(7).to_pylist()
            at = np.concatenate([[0], np.cumsum([len(signs[i]) // 8 for i in order.tolist()])])
            sign = np.frombuffer(b"".join(signs[i] for i in order.tolist()), np.uint64)
            open_ = np.zeros(len(cell), bool)
            for a, b in _candidates(cell, side, comp, n, percent):
                ok = _first_shared(a, b, own, tab)
                a, b = a[ok], b[ok]
                ok = _may_be_alike(a, b, n, sign, at, percent)
                open_[a[ok]] = open_[b[ok]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[open_]) for x in (cell, side, ids, comp)], ["cell", "side", "id", "comp"])

    x = met.join(own, "id").select("cell", "side", "id", "comp", "tab", "n", "own", "sign")
    return x.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(tidy(run), _AT_CELL)


def cell_links(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the open cells, confirmed on full sets: each set goes to its cell once, and a cell gives no link
    between what its links join already, so fewer links than documents."""
    parts = partitions(opened.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches, 8 << 20):
            cell, side, ids, comp, n = (np.asarray(table.column(x)) for x in range(5))
            order = np.lexsort((n, cell))
            blobs = table.column(5).to_pylist()
            sets = [np.frombuffer(blobs[i], np.uint64) for i in order.tolist()]
            cell, side, ids, comp, n = (x[order] for x in (cell, side, ids, comp, n))
            sign, at = signatures(np.concatenate(sets), n)
            up: dict[tuple[int, int], tuple[int, int]] = {}

            def root(x: tuple[int, int]) -> tuple[int, int]:
                while (y := up.get(x, x)) != x:
                    x = y
                return x

            out: list[tuple[int, int]] = []
            for a, b in _candidates(cell, side, comp, n, percent):
                ok = _may_be_alike(a, b, n, sign, at, percent)
                for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                    x, y = root((cell[i], comp[i])), root((cell[j], comp[j]))
                    if x != y and _alike(sets[i], sets[j], percent):
                        up[max(x, y)] = min(x, y)
                        out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            yield pa.RecordBatch.from_arrays([pa.array([p[x] for p in out], pa.int64()) for x in (0, 1)], ["a", "b"])

    x = opened.join(sets, "id").select("cell", "side", "id", "comp", "n", "sets")
    return x.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(tidy(run), "a long, b long").distinct()


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of sorted sets, whether 100 * |both| >= percent * |either|; sizes alone mostly tell."""
    few, many = sorted((len(x), len(y)))
    if 100 * few < percent * many:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inner = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inner >= percent * (len(x) + len(y) - inner)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * |A and B| >= percent * |A or B|. sets: (id, sets), of the documents in pairs at least."""
    p = pairs.join(sets.select(F.col("id").alias("a"), F.col("sets").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sets").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _smaller([batch], 400):
                keep = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return p.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long").distinct()


def _of_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per row of docs with an id; component_id is the least id reachable by links.

    doc is an integer column. Rows of one id are one document with several texts: each has the links of all of them and
    shows its own text's set size. Rows without id are left out. Texts are lower-cased in A-Z; null texts and texts
    without words have no shingles and no links; a text of fewer than k words is one shingle; an empty table gives an empty
    one; very long texts are read whole, and sets travel only for documents with a candidate. Other columns take no part,
    whatever their names. docs is read up to four times: give a table, not a costly plan.

    Texts with equal sets form one class before any key is made, so copies cost nothing further. Then stars under the keys
    of a few tables, confirmed and merged, stars of what is still apart under all keys that documents share, and at last,
    under each key that still joins different components, all its documents in cells, so that no link that shares a key
    is lost.
    """
    docs = docs.where(F.col(f"`{doc}`").isNotNull()).withColumn(doc, F.col(f"`{doc}`").cast("long"))
    rows = durable(sketch(docs, doc, text, k))
    some = rows.where("n > 0")
    classes = durable(some.groupBy("print").agg(F.min("id").alias("rep")))
    reps = durable(some.join(classes.withColumnRenamed("rep", "id"), ["print", "id"], "left_semi").select("id", "n", "keys", "sign"))
    sets = lambda ids: sets_of(docs, bitmap_of(ids), doc, text, k)
    pairs = durable(star_links(reps.select("id", F.col("id").alias("comp"), "keys"), FIRST).select("a", "b").distinct())
    first = durable(confirm(pairs, sets(_of_ends(pairs)), percent))
    comps = components(first)
    entries = durable(repeated_keys(_labelled(reps, comps), reps.count()))
    found = durable(entry_stars(entries))
    release(comps)
    more = durable(found.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    links = durable(first.unionByName(confirm(more, sets(_of_ends(more)), percent)))
    comps = components(links)
    apart = durable(_joined(found, comps).where("ca <> cb").select("key").distinct())
    release(pairs, first, more, found)
    label = _labelled(reps, comps)
    opened = durable(open_cells(cells(entries.join(apart, "key", "left_semi").select("key", "id", "tab"), label, CELL), label, percent))
    release(entries, apart, comps)
    last = durable(links.unionByName(cell_links(opened, sets(opened.select(F.col("id").alias("k"))), percent)))
    comps = components(last)
    release(links, opened, last, reps)
    out = rows.select("id", "print", F.col("n").alias("n_shingles")).join(classes, "print", "left")
    out = out.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    return out.select("id", "n_shingles", F.coalesce("comp", "rep", "id").alias("component_id"))


def _labelled(reps: DataFrame, comps: DataFrame) -> DataFrame:
    return reps.join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), "n", "keys", "sign")


def _joined(found: DataFrame, comps: DataFrame) -> DataFrame:
    """Links with the components (ca, cb) of their ends."""
    a, b = (comps.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    j = found.join(a, "a", "left").join(b, "b", "left")
    return j.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that have a near duplicate of smaller id, with all their columns, whatever their names. Rows without
    id stay, and so do those without words; rows of one id are one document and stay or go together; an empty table gives
    an empty one."""
    (gone,) = fresh(docs, "gone")
    drop = near_duplicates(docs, k, percent, doc, text).where("component_id <> id").select(F.col("id").alias(gone))
    return docs.join(drop, F.col(f"`{doc}`") == F.col(gone), "left_anti")


def neardup_report(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """The digest columns of the contract: doc_id, n_shingles, component_id, kept. Odd rows and tables are as in near_duplicates."""
    x = near_duplicates(docs, k, percent)
    return x.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def oracle(k: int = 2, percent: int = 80) -> str:
    """DuckDB SQL for neardup_report: all pairs that share a shingle, then reachability."""
    return rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')]
  else list_distinct(list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) end as s from d),
n as (select doc_id, len(s)::bigint as n_shingles from g),
t as (select doc_id, unnest(s) as t from g),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from t x join t y on x.t = y.t and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from p join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * c >= {percent} * (na.n_shingles + nb.n_shingles - c)),
u as (select a, b from e union all select b, a from e),
r(doc_id, x) as (select doc_id, doc_id from n union select r.doc_id, u.b from r join u on r.x = u.a)
select doc_id, n_shingles, c as component_id, c = doc_id as kept from (select doc_id, min(x) as c from r group by doc_id) join n using (doc_id)"""
