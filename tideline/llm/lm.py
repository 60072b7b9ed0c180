"""Language-model scoring: corpus counts for a unigram base, and a gated recurrent model trained over the whole corpus.

Documents are dealt to chunks by id. A chunk asks the counts of its distinct words, as arrays of hashes, from buckets of
the hash space; a bucket adds what all chunks counted and answers each. The recurrent model is trained where the texts are,
from common parameters, over one part of the corpus after the other, and averaged after each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .anchors import LONG, gram_sums, span_hash, whole_hash
from .common import chunks_for, durable, partitions
from .tokens import Words, pieces, tidy, tidy_group, tidy_groups

#: Least number of words in the recurrent model's vocabulary; beyond, it grows with the training tokens.
VOCABULARY = 2_046
#: Shares of the training documents between two averagings, in sixteenths, with the learning rate of each part.
PARTS = [(1, 0.01), (3, 0.01), (5, 0.006), (7, 0.003)]
#: Symbols that the recurrent model works on at a time, 4 bytes each.
TOGETHER = 4_000_000
END_HASH = np.uint64(0x1234567890ABCDEF)
_ENTRY = "bucket int, chunk int, hash binary, n binary"


def vocabulary_size(tokens: int, least: int | None = None) -> int:
    """Words that the recurrent model tells apart, the most frequent; the others share a symbol."""
    return max(VOCABULARY if least is None else least, int(np.sqrt(tokens)))


def _chunk_words(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, token hashes with an end after each document, bounds)."""
    w = Words(texts, lower=True, hashes=False)
    h = span_hash(gram_sums(w.flat), w.begin, w.end)
    long = np.flatnonzero(w.end - w.begin >= LONG)
    h[long] = whole_hash(w.flat, w.begin[long], w.end[long])
    n = len(w.offsets) - 1
    bounds = w.first + np.arange(n + 1)
    tokens = np.empty(len(h) + n, np.uint64)
    tokens[bounds[1:] - 1] = END_HASH
    tokens[np.arange(len(h)) + w.doc] = h
    return w, tokens, bounds


def counts(docs: DataFrame) -> DataFrame:
    """(chunk, hash, n): counts in training of the words that a chunk holds, as blobs; chunk -1: all words of
    a bucket that training holds; chunk -2: a bucket's sums. docs: (chunk, id, held, text)."""
    buckets = partitions(docs.sparkSession)

    def ask(table: pa.Table) -> pa.Table:
        seen: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        for part in table.to_batches():
            for piece in pieces(part, "text"):
                _, tokens, bounds = _chunk_words(piece.column(3))
                learnt = np.repeat(~np.asarray(piece.column(2)), np.diff(bounds))
                inverse, h = pd.factorize(tokens)  # a table, where np.unique sorts
                seen.append(h)
                sums.append(np.bincount(inverse, weights=learnt, minlength=len(h)).astype(np.int64))
        h, n = _sum(np.concatenate(seen), np.concatenate(sums))
        bucket = (h >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()
        h, n = h[order], n[order]
        full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        blob = lambda x: pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())
        chunk = table.column(0)[0].as_py()
        return pa.table([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int32()), blob(h), blob(n)], ["bucket", "chunk", "hash", "n"])

    def answer(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(x, np.uint64) for x in table.column(2).to_pylist()]
        h, n = _sum(np.concatenate(asked), np.concatenate([np.frombuffer(x, np.int64) for x in table.column(3).to_pylist()]))
        got = [n[np.searchsorted(h, x)].tobytes() for x in asked]
        held = n > 0
        chunk = [*table.column(1).to_pylist(), -1, -2]
        hashes = [*(x.tobytes() for x in asked), h[held].tobytes(), b""]
        return pa.table([pa.array(chunk, pa.int32()), pa.array(hashes, pa.binary()), pa.array([*got, n[held].tobytes(), np.array([n.sum(), held.sum()]).tobytes()], pa.binary())], ["chunk", "hash", "n"])

    asked = docs.groupBy("chunk").applyInArrow(tidy_group(ask), _ENTRY)
    return asked.groupBy("bucket").applyInArrow(tidy_group(answer), "chunk int, hash binary, n binary")


def _sum(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(h, return_inverse=True)
    return u, np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64)


def vocabulary(counted: DataFrame, least: int | None = None) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(training tokens, distinct ones, hashes of the vocabulary, their counts); as many words as vocabulary_size says."""
    unpack = lambda want, most=0: lambda batches: (_rows(b, want, most) for b in batches if b.num_rows)

    def _rows(batch: pa.RecordBatch, want: str, most: int) -> pa.RecordBatch:
        h = np.concatenate([np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()] or [np.zeros(0, np.int64)])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()])
        if want == "sums":
            return pa.RecordBatch.from_arrays([pa.array(n[::2]), pa.array(n[1::2])], ["hash", "n"])
        top = np.lexsort((h, -n))[: most + 1]
        return pa.RecordBatch.from_arrays([pa.array(h[top]), pa.array(n[top])], ["hash", "n"])

    sums = counted.where("chunk = -2").mapInArrow(unpack("sums"), "hash long, n long").agg(F.sum("hash"), F.sum("n")).first()
    size = vocabulary_size(int(sums[0] or 0), least)
    top = counted.where("chunk = -1").mapInArrow(unpack("top", size), "hash long, n long").orderBy(F.desc("n"), "hash").limit(size + 1).collect()
    h = np.array([r["hash"] for r in top], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], np.int64)
    words = h != END_HASH
    return int(sums[0] or 0), int(sums[1] or 0), h[words][:size], n[words][:size]


class Coder:
    """Hashes to symbols: 0 for other words, 1 for the end, then the vocabulary by rank.

    A slot of a table, some sixteen to thirty-two for each word, holds the one word whose hash begins with its number; words that share a slot
    are searched for. Each worker makes the table for itself.
    """

    def __init__(self, hashes: np.ndarray):
        known = np.concatenate([hashes, [END_HASH]]).astype(np.uint64)
        ids = np.concatenate([np.arange(len(hashes)) + 2, [gru.END]]).astype(np.int32)
        order = np.argsort(known)
        self.known, self.ids, self.table = known[order], ids[order], None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def _slots(self) -> tuple[np.uint64, np.ndarray, np.ndarray]:
        bits = max(10, (16 * len(self.known)).bit_length())
        shift = np.uint64(64 - bits)
        slot = self.known >> shift
        words, symbols = np.zeros(1 << bits, np.uint64), np.full(1 << bits, gru.UNK, np.int32)
        words[slot], symbols[slot] = self.known, self.ids
        symbols[slot[1:][slot[1:] == slot[:-1]]] = -1
        return shift, words, symbols

    def __call__(self, h: np.ndarray) -> np.ndarray:
        self.table = self.table or self._slots()
        shift, words, symbols = self.table
        slot = (h >> shift).astype(np.intp)
        out = symbols[slot]
        asked = np.flatnonzero(out < 0)
        out[words[slot] != h] = gru.UNK
        if len(asked):
            at = np.minimum(np.searchsorted(self.known, h[asked]), len(self.known) - 1)
            out[asked] = np.where(self.known[at] == h[asked], self.ids[at], gru.UNK)
        return out


def _gathered(coded: Iterator[tuple[np.ndarray, np.ndarray]], most: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, bounds) of pieces put together up to `most` symbols: streams that end far apart leave few side by side."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for tokens, bounds in coded:
        if held and sum(len(t) for t, _ in held) + len(tokens) > most:
            yield _joined(held)
            held = []
        held.append((tokens, bounds))
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(t) for t, _ in held)])
    return np.concatenate([t for t, _ in held]), np.concatenate([[0], *(b[1:] + s for (_, b), s in zip(held, starts[:-1], strict=True))])


def fit(docs: DataFrame, hashes: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Parameters after one pass over the training documents. docs: (id, held, text).

    Each task starts a part from the common parameters, and what comes out is averaged by its number of tokens, in a few
    tasks first and then in one, so the driver receives one vector however many tasks there are.
    """
    sc = docs.sparkSession.sparkContext
    shape = gru.Shape.of(len(frequency), frequency)
    flat = gru.start(shape, np.maximum(frequency, 1).astype(float))
    coder = sc.broadcast(Coder(hashes))
    slot = F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text")), F.lit("part")), F.lit(16))
    lo = 0
    for width, rate in PARTS:
        now = sc.broadcast(flat)

        def learn(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            mine, seen = now.value.copy(), 0
            adam = gru.Adam(len(mine), rate)
            coded = ((coder.value(tokens), bounds) for batch in batches for piece in pieces(batch, "text") for _, tokens, bounds in [_chunk_words(piece.column(0))])
            for tokens, bounds in _gathered(coded):
                gru.train(mine, shape, tokens, bounds, adam)
                seen += len(tokens)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([mine.tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["mean", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for batch in batches:
                for x, m in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    v = np.frombuffer(x.as_py(), np.float32) * np.float64(m)
                    total = v if total is None else total + v
                    n += m
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], ["mean", "n"])

        part = docs.where(~F.col("held") & (slot >= lo) & (slot < lo + width)).select("text")
        mean = part.mapInArrow(tidy(learn), "mean binary, n long")
        for tasks in (16, 1):
            mean = mean.repartition(tasks).mapInArrow(tidy(add), "mean binary, n long")
        for r in mean.collect():  # one row, none without training documents
            flat = np.frombuffer(r["mean"], np.float32).copy()
        lo += width
    return flat


def lm_report(docs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary_words: int | None = None) -> DataFrame:
    """The digest columns of the contract: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score is the log10 probability of the document under the recurrent model; a word outside its vocabulary has the
    probability of the shared symbol times (c + 1) / (M + U + 1), where c is its training count and M and U are tokens and
    distinct words outside the vocabulary. Null texts are empty (one end); rows without id are trained on and scored like
    others; repeated rows count as often as they stand; without training rows all counts are zero; an empty table gives an
    empty one; texts of any length are scored whole, state carried throughout; other columns take no part. The recurrent
    vocabulary has vocabulary_words words (VOCABULARY if None) or more, see vocabulary_size. What a task learns before averaging depends on how
    the rows are dealt to tasks (doc is an integer column), so scores agree between runs only over the same files and settings.
    """
    spark = docs.sparkSession
    chunks = chunks_for(docs)
    held = F.coalesce(F.crc32(F.col(f"`{doc}`").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    slim = docs.select(F.col(f"`{doc}`").cast("long").alias("id"), held.alias("held"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    dealt = slim.select(F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(chunks)).cast("int").alias("chunk"), "id", "held", "text")
    counted = durable(counts(dealt))
    n, distinct, hashes, frequency = vocabulary(counted, vocabulary_words)
    ends = int(slim.where(~F.col("held")).count())
    inside = int(frequency.sum())
    other_n, other_v = n - ends - inside, distinct - len(hashes) - bool(ends)
    frequency = np.concatenate([[max(other_n, 1), max(ends, 1)], frequency])
    flat = fit(slim, hashes, frequency)
    sc = spark.sparkContext
    model = sc.broadcast((Coder(hashes), flat, gru.Shape.of(len(frequency), frequency)))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        coder, flat, shape = model.value
        out = []
        if answers.num_rows:
            h = np.concatenate([np.frombuffer(x, np.uint64) for x in answers.column(1).to_pylist()])
            c = np.concatenate([np.frombuffer(x, np.int64) for x in answers.column(2).to_pylist()])
            order = np.argsort(h)
            h, c = h[order], c[order]
        coded: list[tuple[np.ndarray, np.ndarray]] = []
        rests: list[np.ndarray] = []
        for batch in texts.to_batches():
            for piece in pieces(batch, "text"):
                _, tokens, bounds = _chunk_words(piece.column(3))
                which, words = pd.factorize(tokens)  # all that is known of a word is looked up once
                count, ids = c[np.searchsorted(h, words)], coder(words)
                total = lambda v: np.add.reduceat(v[which], bounds[:-1])
                base = total(np.log10((count + 1.0) / (n + 1.0 * (distinct + 1))))
                rests.append(total(np.where(ids == gru.UNK, np.log10((count + 1.0) / (other_n + other_v + 1.0)), 0.0)))
                coded.append((ids[which], bounds))
                rows = len(bounds) - 1
                out.append(pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), pa.array(np.diff(bounds)), pa.array(total((count > 0).astype(np.int64))), pa.array(np.full(rows, n, np.int64)), pa.array(base)], names[:-1]))
        mine = [gru.log_likelihood(flat, shape, *x) for x in _gathered(iter(coded))]
        if not out:
            return schema.empty_table()
        table = pa.Table.from_batches(out)
        return table.append_column("score", pa.array(np.concatenate(mine) / np.log(10) + np.concatenate(rests))).cast(schema)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(x, pa.int64()) for x in names[2:5]], *[(x, pa.float64()) for x in names[5:]]])
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(counted.where("chunk >= 0").groupBy("chunk")).applyInArrow(tidy_groups(score), kinds)
