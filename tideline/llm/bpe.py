"""Byte-level BPE encoding and decoding in linear time.

Token bytes are mapped to Latin-1 characters for an Aho-Corasick automaton, which gives the longest token that begins at
each place. The encoder takes longest matches and backtracks to shorter ones wherever two neighbours could not stand side
by side in the result of the merges; that adjacency is memoised. What it finds is what applying the merges by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from .tokens import pieces, tidy

#: Matches of the split pattern whose ids a worker keeps beyond a batch, bytes of those it keeps at all, and pairs whose
#: adjacency it keeps (a power of two). A full store goes on with what the last batch used, so stores stay bounded.
KEEP, KEEP_LETTERS, KEEP_PAIRS = 180_000, 64, 1 << 18
#: Bytes that are encoded side by side; with FEW pieces left or fewer, each is encoded by itself.
TOGETHER, FEW = 1 << 18, 48
NEVER = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _adjacent(left: int, right: int, joined: dict[int, int], halves: dict[int, tuple[int, int]], before: int) -> bool:
    """Whether left and right are still neighbours once every merge that ranks below `before` is done.

    Walk the border back through the merges that made both sides, the latest first: if at any time the two that then met
    there would have merged sooner than the next of those merges, the border would have vanished.
    """
    while True:
        if joined.get(left << 32 | right, before) < before:
            return False
        inner_left, inner_right = halves[left][1], halves[right][0]
        if inner_left == left and inner_right == right:
            return True
        # of equal ranks the left one is made first
        if inner_right == right or (inner_left != left and left > right):
            before, left = left, inner_left
        else:
            before, right = right + 1, inner_right


class Bpe:
    """Encoder and decoder for a rank table: among neighbours the pair whose bytes have the lowest rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} bytes have no rank of their own")
        self.bytes_of = {r: t for t, r in ranks.items()}
        text_of = {r: t.decode("latin-1") for t, r in ranks.items()}
        self.rank_of = {t: r for r, t in text_of.items()}
        joined: dict[int, int] = {}  # what two tokens make: rank by both, of all ways to cut a token in two
        for text, rank in self.rank_of.items():
            for n in range(1, len(text)):
                if (a := self.rank_of.get(text[:n])) is not None and (b := self.rank_of.get(text[n:])) is not None:
                    joined[a << 32 | b] = rank
        top = max(text_of) + 1
        self.left, self.right = np.arange(top), np.arange(top)  # the halves whose merge made a token, itself if none did
        halves: dict[int, tuple[int, int]] = {}
        for rank, text in sorted(text_of.items()):
            cuts = ((self.rank_of.get(text[:n], rank), self.rank_of.get(text[n:], rank)) for n in range(1, len(text)))
            halves[rank] = next(((a, b) for a, b in cuts if a < rank and b < rank and _adjacent(a, b, joined, halves, rank)), (rank, rank))
            self.left[rank], self.right[rank] = halves[rank]
        # a token that no merge makes stands for a whole piece alone, so none of it is looked for inside of pieces
        made = {t: r for t, r in self.rank_of.items() if len(t) == 1 or halves[r][0] != r}
        self.matcher = ahocorasick.Automaton()
        self.byte = np.array([self.rank_of[chr(b)] for b in range(256)])  # what begins where no longer token does
        for text, rank in made.items():
            if len(text) > 1:
                self.matcher.add_word(text, rank)
        if not len(self.matcher):
            self.matcher.add_word("\u0100", 0)  # never met: an empty automaton cannot be asked
        self.matcher.make_automaton()
        self.length, self.shorter = np.zeros(top, np.int64), np.full(top, -1)
        for t, r in made.items():
            self.length[r] = len(t)
            self.shorter[r] = next((made[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in made), -1)
        in_longer = {c for t in made if len(t) > 1 for c in t}
        #: Characters of one byte that only their own token holds: no match goes across one that stands between two pieces.
        self.marks = [chr(b) for b in range(128) if chr(b) not in in_longer]
        codes = np.array(sorted(joined), np.int64)
        self.codes, self.ranks_of_codes = np.append(codes, -1), np.array([joined[c] for c in codes.tolist()] + [NEVER])
        self.memo, self.fits = np.full(KEEP_PAIRS, -1), np.zeros(KEEP_PAIRS, bool)

    def adjacent(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_adjacent of all pairs at a time, of finished tokens."""
        out, todo, before = np.zeros(len(left), bool), np.arange(len(left)), np.full(len(left), NEVER)
        while len(todo):
            code = left << 32 | right
            at = np.searchsorted(self.codes[:-1], code)
            go = np.where(self.codes[at] == code, self.ranks_of_codes[at], NEVER) >= before
            todo, left, right, before = todo[go], left[go], right[go], before[go]
            inner_left, inner_right = self.right[left], self.left[right]
            whole_left, whole_right = inner_left == left, inner_right == right
            out[todo[whole_left & whole_right]] = True
            go_left = whole_right | (~whole_left & (left > right))
            before = np.where(go_left, left, right + 1)
            left, right = np.where(go_left, inner_left, left), np.where(go_left, right, inner_right)
            go = ~(whole_left & whole_right)
            todo, left, right, before = todo[go], left[go], right[go], before[go]
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """adjacent, memoised: a place of the store holds the last pair that fell on it."""
        code = left << 32 | right
        place = ((code * 0x9E3779B1) >> 20) & (KEEP_PAIRS - 1)
        out, miss = self.fits[place], np.flatnonzero(self.memo[place] != code)
        if len(miss):
            new, which = np.unique(code[miss], return_inverse=True)
            fits = self.adjacent(new >> 32, new & 0xFFFFFFFF)
            out[miss] = fits[which]
            place = ((new * 0x9E3779B1) >> 20) & (KEEP_PAIRS - 1)
            self.memo[place], self.fits[place] = new, fits
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        text = piece.decode("latin-1")
        if (whole := self.rank_of.get(text)) is not None:
            return [whole]
        longest = [*self.byte[np.frombuffer(piece, np.uint8)].tolist(), -1]
        for end, rank in self.matcher.iter(text):
            longest[end - self.length.item(rank) + 1] = rank  # later ends are longer
        dead = bytearray(len(text) + 1)  # places from which no way led on
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            while token >= 0 and (dead[at + self.length.item(token)] or out and not self._fits(out[-1], token)):
                token = self.shorter.item(token)
            if token >= 0:
                out.append(token)
                at += self.length.item(token)
                token = longest[at]
            else:
                dead[at] = 1
                last = out.pop()
                at -= self.length.item(last)
                token = self.shorter.item(last)
        return out

    def _fits(self, left: int, right: int) -> bool:
        code = left << 32 | right
        place = ((code * 0x9E3779B1) >> 20) & (KEEP_PAIRS - 1)
        if self.memo.item(place) != code:
            self.memo[place], self.fits[place] = code, self.adjacent(np.array([left]), np.array([right]))[0]
        return self.fits.item(place)

    def encode_all(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece. Those that are no token are encoded side by side, some at a time."""
        coded: list[bytes | None] = [None] * len(pieces)
        rest: list[int] = []
        raw = [p.encode("utf-8") for p in pieces]
        size = 0
        for i, x in enumerate(raw):
            if (whole := self.rank_of.get(x.decode("latin-1"))) is not None:
                coded[i] = whole.to_bytes(4, "little")
                continue
            rest.append(i)
            size += len(x)
            if size > TOGETHER:
                self._side_by_side(raw, rest, coded)
                rest, size = [], 0
        self._side_by_side(raw, rest, coded)
        return coded

    def _side_by_side(self, raw: list[bytes], these: list[int], coded: list[bytes | None]) -> None:
        """encode, for many pieces in step: each round tries one token for each piece that is not done."""
        x = b"".join(raw[i] for i in these)
        mark = next((m for m in self.marks if m.encode() not in x), None)
        left_over = these
        if mark is not None and len(these) > FEW:
            text = mark.encode().join([raw[i] for i in these]).decode("latin-1")
            found = np.fromiter(chain.from_iterable(self.matcher.iter(text)), np.int64).reshape(-1, 2)
            longest = np.append(self.byte[np.frombuffer(text.encode("latin-1"), np.uint8)], -1)
            longest[found[:, 0] - self.length[found[:, 1]] + 1] = found[:, 1]  # of one place the last stays, which is the longest
            size = np.array([len(raw[i]) for i in these])
            start = np.cumsum(size + 1) - size - 1
            stop, at = start + size, start.copy()
            chosen, back, dead = np.full(len(text) + 1, -1), np.full(len(text) + 1, -1), np.zeros(len(text) + 1, bool)
            token, todo = longest[at], np.arange(len(these))
            while len(todo) > FEW:
                none = token[todo] < 0
                if none.any():  # no way on from here: a shorter token before
                    i = todo[none]
                    dead[at[i]] = True
                    at[i] = back[at[i]]
                    token[i] = self.shorter[chosen[at[i]]]
                i = todo[~none]
                t, here = token[i], at[i]
                end = here + self.length[t]
                ok = ~dead[end]
                second = np.flatnonzero(ok & (here > start[i]))
                ok[second] = self.compatible(chosen[back[here[second]]], t[second])
                yes, no = i[ok], i[~ok]
                chosen[here[ok]], back[end[ok]] = t[ok], here[ok]
                at[yes] = end[ok]
                token[yes], token[no] = longest[at[yes]], self.shorter[t[~ok]]
                todo = todo[at[todo] < stop[todo]]
            done = np.ones(len(these), bool)
            done[todo] = False
            ends = np.zeros(len(text) + 1, bool)
            i, here = start[done], stop[done]
            while len(here):
                here = back[here]
                ends[here] = True
                on = here > i
                i, here = i[on], here[on]
            before = np.concatenate([[0], np.cumsum(ends)])
            packed = chosen[ends].astype("<u4").tobytes() if len(text) else b""
            for k, a, b in zip(np.flatnonzero(done).tolist(), before[start[done]].tolist(), before[stop[done]].tolist(), strict=True):
                coded[these[k]] = packed[4 * a : 4 * b]
            left_over = [these[k] for k in todo.tolist()]
        for i in left_over:
            coded[i] = np.array(self.encode(raw[i]), "<u4").tobytes()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextBpe:
    """Whole texts: each match of the pattern by itself; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe, self.findall, self.known = Bpe(ranks), regex.compile(pattern).findall, {}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; pieces that several texts have, or that the store has, are encoded once."""
        split = [self.findall(t) for t in texts]
        pieces = set().union(*split)
        new = list(pieces.difference(self.known))
        self.known.update(zip(new, self.bpe.encode_all(new), strict=True))
        out = [b"".join(map(self.known.__getitem__, s)) for s in split]
        if len(self.known) > KEEP:
            self.known = {p: self.known[p] for p in pieces}
        for p in new:
            if len(p) > KEEP_LETTERS:  # hardly comes again
                del self.known[p]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return self.bpe.decode(np.frombuffer(packed, "<u4").tolist())


_workers: dict[tuple[str, str], TextBpe] = {}


def text_bpe(path: str, pattern: str) -> TextBpe:
    """One per worker process and table; only its own file is read, on whichever executor it runs."""
    if (path, pattern) not in _workers:
        _workers[path, pattern] = TextBpe(load_ranks(path), pattern)
    return _workers[path, pattern]


def _with_columns(df: DataFrame, source: str, names: list[tuple[str, DataType]], coder: tuple[str, str], make: Callable[[TextBpe, list], list[pa.Array]]) -> DataFrame:
    """df with what make(coder, values of the column `source`) gives, as new columns; columns of those names are replaced."""
    if source.lower() in (n.lower() for n, _ in names):
        raise ValueError(f"the column {source} is read, so it cannot be replaced")
    df = df.drop(*(n for n, _ in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = text_bpe(*coder)
        for batch in batches:
            for part in pieces(batch, source, 2 << 20):
                made = make(own, part.column(part.schema.get_field_index(source)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *(n for n, _ in names)])

    return df.mapInArrow(tidy(run), StructType([*df.schema.fields, *(StructField(n, kind) for n, kind in names)]))


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of ids; a column of that name is replaced. A null text has no ids, like an empty one; rows
    are encoded each, whatever repeats; texts of any length are encoded whole; an empty table gives an empty one."""
    return _with_columns(docs, text, [(ids, BinaryType())], (path, pattern), lambda c, x: [pa.array(c.encode_batch([v or "" for v in x]), pa.binary())])


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the binary column `ids` decoded to bytes; a column of the name `out` is replaced. Null ids give null."""
    return _with_columns(df, ids, [(out, BinaryType())], (path, pattern), lambda c, x: [pa.array([None if v is None else c.decode(v) for v in x], pa.binary())])


def round_trip_column(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", digest: str = "decoded_sha256") -> DataFrame:
    """encode_column, and the sha256 of what the ids decode to, both in one worker, so only one holds the tables."""

    def make(coder: TextBpe, texts: list) -> list[pa.Array]:
        packed = coder.encode_batch([v or "" for v in texts])
        return [pa.array(packed, pa.binary()), pa.array([hashlib.sha256(coder.decode(p)).hexdigest() for p in packed], pa.string())]

    return _with_columns(docs, text, [(ids, BinaryType()), (digest, StringType())], (path, pattern), make)


def bpe_report(docs: DataFrame, path: str, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest columns of the contract: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Each text is encoded, the ids are decoded again, and only digests leave the worker. Nulls count as empty, repeated
    rows are encoded each, an empty table gives an empty one. Texts of any length are encoded whole, in linear time. doc is an
    integer column; other columns take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_bpe(path, pattern)
        sha: Callable[[bytes], str] = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                packed = coder.encode_batch([x or "" for x in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([sha(p) for p in packed], pa.string()), pa.array([sha(coder.decode(p)) for p in packed], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
