"""Stitching of overlapping token lists: seams between neighbouring chunks, in parallel, chained by a prefix scan.

What one chunk adds to those before it depends on where the lists match in their overlap, so a seam needs two neighbours
alone as long as it does not reach past a chunk. Recordings in which one does are folded chunk by chunk.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Token = tuple[int, str, float, float, float]


class NoCommonRun(RuntimeError):
    """The two lists share no contiguous run of tokens."""


def _cut(a: Sequence[Token], b: Sequence[Token], overlap: float) -> tuple[list[Token], list[Token], int]:
    """The end of a and the beginning of b that may say the same, and where the end of a begins."""
    from_, to = b[0][2] - overlap / 2, a[-1][2] + a[-1][3] + overlap / 2
    k = next((i for i, t in enumerate(a) if t[2] >= from_), len(a))
    return list(a[k:]), [t for t in b if t[2] <= to], k


Timed = Sequence[tuple[int, float]]


def _matches(tail: Timed, head: Timed, tolerance: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of tokens (id, start) that are the same, in the order of i and j: equal ids that start within tolerance."""
    at: dict[int, list[tuple[float, int]]] = {}
    for j, (name, start) in enumerate(head):
        at.setdefault(name, []).append((start, j))
    for some in at.values():
        some.sort()
    for i, (name, start) in enumerate(tail):
        some = at.get(name, [])
        near = []
        for k in range(bisect.bisect_left(some, (start - tolerance - 1e-6, -1)), len(some)):
            if some[k][0] - start > tolerance + 1e-6:
                break
            if abs(start - some[k][0]) <= tolerance:
                near.append(some[k][1])
        yield from ((i, j) for j in sorted(near))


def contiguous_seam(tail: Timed, head: Timed, tolerance: float) -> tuple[int, int] | None:
    """Where to leave the tail and enter the head: in the middle of the longest run that both have, the first such."""
    best, run = (0, 0, 0), {}
    for i, j in _matches(tail, head, tolerance):
        n = run[i, j] = run.get((i - 1, j - 1), 0) + 1
        best = max(best, (n, -i, -j))
    n, i, j = best[0], -best[1] + 1, -best[2] + 1
    return (i - n // 2, j - n // 2) if n else None


def subsequence_seam(tail: Timed, head: Timed, tolerance: float) -> tuple[int, int] | None:
    """Where to leave the tail and enter the head: at the middle pair of a longest common subsequence."""
    n, m = len(tail), len(head)
    same = set(_matches(tail, head, tolerance))
    if not same:
        return None
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if (i, j) in same else max(best[i + 1][j], best[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if (i, j) in same and best[i][j] == best[i + 1][j + 1] + 1:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs[len(pairs) // 2]


def seam(tail: Timed, head: Timed, tolerance: float) -> tuple[int, int] | None:
    """A contiguous match first, a subsequence where that fails; None where no two tokens are the same."""
    return contiguous_seam(tail, head, tolerance) or subsequence_seam(tail, head, tolerance)


def _timed(tokens: Sequence[Token]) -> list[tuple[int, float]]:
    return [(t[0], t[2]) for t in tokens]


def join_contiguous(a: list[Token], b: list[Token], overlap: float, tolerance: float) -> list[Token]:
    """a up to the middle of the longest run that both have, then b; NoCommonRun if no two tokens are the same."""
    tail, head, k = _cut(a, b, overlap)
    at = contiguous_seam(_timed(tail), _timed(head), tolerance)
    if at is None:
        raise NoCommonRun
    return a[: k + at[0]] + b[at[1] :]


def join(a: list[Token], b: list[Token], overlap: float, tolerance: float) -> tuple[int, list[Token]]:
    """How many tokens of a stay, and which of b follow: those after the seam, or from where a ends if there is none."""
    tail, head, k = _cut(a, b, overlap)
    at = seam(_timed(tail), _timed(head), tolerance)
    if at is None:
        end = a[-1][2] + a[-1][3]
        return len(a), [t for t in b if t[2] >= end]
    return k + at[0], b[at[1] :]


def stitch_lists(lists: list[list[Token]], overlap: float, tolerance: float = 0.25) -> list[Token]:
    """Left fold in chunk order: contiguous match first, subsequence where that fails; empty lists change nothing."""
    out: list[Token] = []
    for new in lists:
        if not out or not new:
            out = out or list(new)
            continue
        n, more = join(out, new, overlap, tolerance)
        out = out[:n] + more
    return out


_COLUMNS = ["id", "text", "start", "duration", "confidence"]
_TYPES = {"id": "int", "text": "string", "start": "double", "duration": "double", "confidence": "double"}


def stitch_fold(tokens: DataFrame, overlap_s: float = 15.0, tolerance: float = 0.25) -> DataFrame:
    """What `stitch` gives, by a fold over all chunks of a recording in one group."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["chunk_ix", "pos"], kind="stable")
        lists = [list(g[_COLUMNS].itertuples(index=False, name=None)) for _, g in df.groupby("chunk_ix", sort=True)]
        out = pd.DataFrame(stitch_lists(lists, overlap_s, tolerance), columns=_COLUMNS)
        out.insert(0, "pos", range(len(out)))
        out.insert(0, "rec_id", df["rec_id"].iloc[0])
        return out

    kind = tokens.schema["rec_id"].dataType.simpleString()
    return tokens.groupBy("rec_id").applyInPandas(run, f"rec_id {kind}, pos int, id int, text string, start double, duration double, confidence double")


def chunk_lists(tokens: DataFrame) -> DataFrame:
    """(rec_id, chunk_ix, tokens): a chunk's tokens in order, as structs of pos, id, text, start, duration and confidence."""
    one = F.struct("pos", *[F.col(c).cast(t).alias(c) for c, t in _TYPES.items()])
    return tokens.groupBy("rec_id", "chunk_ix").agg(F.array_sort(F.collect_list(one)).alias("tokens"))


def _first(tokens: str, true) -> F.Column:
    """Index of the first token for which `true` holds, or how many there are."""
    at = F.array_position(F.transform(tokens, true), True)
    return F.when(at > 0, at - 1).otherwise(F.size(tokens)).cast("int")


def chunk_chain(chunks: DataFrame, overlap_s: float, tolerance: float) -> DataFrame:
    """(rec_id, chunk_ix, enter, leave, offset, whole) for chunks (rec_id, chunk_ix, tokens): tokens from `enter` up to `leave`
    stay and are numbered from `offset` on, if `whole` holds, that is if no seam of the recording reaches past a chunk.

    A row without tokens stands for a chunk wherever order matters; of tokens only the ends that overlap are joined.
    """
    half = F.lit(overlap_s / 2)
    start, end = lambda t: t["start"], F.element_at("tokens", -1)["start"] + F.element_at("tokens", -1)["duration"]
    w = Window.partitionBy("rec_id").orderBy("chunk_ix")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    slim = chunks.select("rec_id", "chunk_ix", F.size("tokens").alias("n"), F.element_at("tokens", 1)["start"].alias("begins"), end.alias("ends"), F.array_max(F.transform("tokens", start)).alias("latest"))
    slim = slim.withColumns({"following": F.lead("chunk_ix").over(w), "from": F.lead("begins").over(w) - half, "ended": F.lag("ends").over(w), "latest": F.max("latest").over(before)})
    x = chunks.join(slim, ["rec_id", "chunk_ix"])
    timed = lambda tokens: F.transform(tokens, lambda t: F.struct(t["id"].alias("id"), t["start"].alias("start")))
    back = _first("tokens", lambda t: t["start"] >= F.col("from"))
    tails = x.where("following is not null").withColumn("back", back).select("rec_id", F.col("following").alias("chunk_ix"), "n", "back", timed(F.slice("tokens", F.col("back") + 1, F.greatest(F.col("n"), F.lit(1)))).alias("tail"))
    after = _first("tokens", lambda t: t["start"] >= F.col("ended"))
    n_after = F.size(F.filter("tokens", lambda t: t["start"] >= F.col("ended")))
    heads = x.where("ended is not null").withColumn("after", after).select("rec_id", "chunk_ix", "after", (n_after == F.col("n") - F.col("after")).alias("in_order"), timed(F.filter("tokens", lambda t: t["start"] <= F.col("ended") + half)).alias("head"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for n, back_, tail, after_, in_order, head in zip(df["n"], df["back"], df["tail"], df["after"], df["in_order"], df["head"], strict=True):
                at = seam([(t["id"], t["start"]) for t in tail], [(t["id"], t["start"]) for t in head], tolerance)
                rows.append((int(back_), int(back_ + at[0]), int(at[1]), True) if at else (int(back_), int(n), int(after_), bool(in_order)))
            yield pd.concat([df[["rec_id", "chunk_ix"]].reset_index(drop=True), pd.DataFrame(rows, columns=["back", "left", "enter", "sound"])], axis=1)

    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("rec_id", "chunk_ix"))
    seams = tails.join(heads, ["rec_id", "chunk_ix"]).mapInPandas(run, f"{kinds}, back int, left int, enter int, sound boolean")
    chain = slim.join(seams, ["rec_id", "chunk_ix"], "left").withColumns({"leave": F.coalesce(F.lead("left").over(w), F.col("n")), "reach": F.lead("back").over(w), "enter": F.coalesce("enter", F.lit(0))})
    inside = F.col("following").isNull() | ((F.col("reach") >= F.col("enter")) & (F.col("enter") < F.col("n")) & F.coalesce(F.col("latest") < F.col("from"), F.lit(True)))
    ok = F.coalesce("sound", F.lit(True)) & inside
    offset = F.coalesce(F.sum(F.col("leave") - F.col("enter")).over(before), F.lit(0)).cast("int")
    return chain.select("rec_id", "chunk_ix", "enter", "leave", offset.alias("offset"), F.bool_and(ok).over(Window.partitionBy("rec_id")).alias("whole"))


def stitch(tokens: DataFrame, overlap_s: float = 15.0, tolerance: float = 0.25) -> DataFrame:
    """(rec_id, pos, id, text, start, duration, confidence) from tokens with chunk_ix and pos, shifted to recording time.

    The matching is this engine's own: equal ids that start within tolerance. Seams are found side by side, wherever their
    chunks are; a scan over one row a chunk puts the pieces in their places. A recording with a seam that would change what
    an earlier one left (a chunk that adds nothing, or tokens out of time order) is folded as a whole; both ways give
    what the fold gives.
    """
    chunks = chunk_lists(tokens)
    chain = chunk_chain(chunks, overlap_s, tolerance)
    whole = chunks.join(chain.where("whole and leave > enter"), ["rec_id", "chunk_ix"])
    pieces = whole.select("rec_id", "offset", F.posexplode(F.slice("tokens", F.col("enter") + 1, F.col("leave") - F.col("enter"))).alias("k", "token"))
    out = pieces.select("rec_id", (F.col("offset") + F.col("k")).cast("int").alias("pos"), *[F.col(f"token.{c}").alias(c) for c in _COLUMNS])
    rest = tokens.join(chain.where("not whole").select("rec_id").distinct(), "rec_id", "left_semi")
    return out.unionByName(stitch_fold(rest, overlap_s, tolerance))
