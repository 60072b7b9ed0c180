"""Stitching as chunks come: keyed state instead of reading everything again.

A recording's state is the end of what is merged, the tokens before it that only a far-reaching seam needs, and chunks that
came early. Each chunk adds to a log what it cut and what it brought; the log's view is the stitched recording.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.stitch import Token, join
from .resume import valid_rows

#: The state store that keyed state of several kinds needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds at the end of a merged recording that stay at hand; seams that reach further back take the rest from the store.
KEEP_S = 60.0

_LOG = "version int, cut int, pos int, id int, text string, start double, duration double, confidence double"


def _packed(tokens: list[Token]) -> str:
    return json.dumps(tokens)


def _unpacked(text: str) -> list[Token]:
    return [tuple(t) for t in json.loads(text)]


def _of_structs(text: str) -> list[Token]:
    return [(t["id"], t.get("text", ""), float(t["start"]), float(t["duration"]), float(t["confidence"])) for t in json.loads(text)]


class Stitcher(StatefulProcessor):
    """Folds each recording's chunks in their order, whenever they come. A chunk that was merged or waits already is left
    out; one that is early waits; with the last one all but a mark leaves the store, by which chunks that come again are
    known."""

    def __init__(self, overlap_s: float, tolerance: float, keep_s: float):
        self.overlap_s, self.tolerance, self.keep_s = overlap_s, tolerance, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next int, settled int, latest double")
        self.tail = handle.getValueState("tail", "tokens string")
        self.settled = handle.getListState("settled", "tokens string")
        self.early = handle.getMapState("early", "chunk_ix int", "tokens string")
        self.done = handle.getValueState("done", "chunks int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came: dict[int, str] = {}
        n_chunks = None
        for df in rows:
            for ix, n, tokens in zip(df["chunk_ix"], df["n_chunks"], df["tokens"], strict=True):
                came.setdefault(int(ix), tokens)
                n_chunks = n_chunks if pd.isna(n) else int(n)
        if self.done.exists():
            return
        following, settled, latest = self.place.get() if self.place.exists() else (0, 0, -math.inf)
        tail = _unpacked(self.tail.get()[0]) if self.tail.exists() else []
        out: list[tuple] = []
        while True:
            if following in came:
                new = _of_structs(came.pop(following) or "[]")
                if self.early.containsKey((following,)):
                    self.early.removeKey((following,))
            elif self.early.containsKey((following,)):
                new = _of_structs(self.early.getValue((following,))[0])
                self.early.removeKey((following,))
            else:
                break
            if new:
                if tail and new[0][2] - self.overlap_s / 2 <= latest:  # a seam that may reach into what was settled
                    tail = [t for (block,) in self.settled.get() for t in _unpacked(block)] + tail
                    self.settled.clear()
                    settled, latest = 0, -math.inf
                n, more = join(tail, new, self.overlap_s, self.tolerance) if tail else (0, new)
                out.append((following, settled + n, -1, None, None, None, None, None))
                out += [(following, settled + n, settled + n + k, *t) for k, t in enumerate(more)]
                tail = tail[:n] + more
                last = tail[-1][2] + tail[-1][3] - self.keep_s if tail else -math.inf
                m = next((i for i, t in enumerate(tail[:-1]) if t[2] >= last), max(len(tail) - 1, 0))
                if m:
                    self.settled.appendValue((_packed(tail[:m]),))
                    settled, latest, tail = settled + m, max(latest, *(t[2] for t in tail[:m])), tail[m:]
            following += 1
        if n_chunks is not None and following >= n_chunks:
            for state in (self.place, self.tail, self.settled, self.early):
                state.clear()
            self.done.update((following,))
        else:
            self.place.update((following, settled, latest))
            self.tail.update((_packed(tail),))
            for ix, tokens in came.items():
                if ix > following and not self.early.containsKey((ix,)):
                    self.early.updateValue((ix,), (tokens or "[]",))
        if out:
            log = pd.DataFrame(out, columns=["version", "cut", "pos", "id", "text", "start", "duration", "confidence"])
            log.insert(0, "rec_id", key[0])
            yield log.astype({"id": "Int32"})

    def close(self) -> None:
        pass


def stitch_log(chunks: DataFrame, overlap_s: float = 15.0, tolerance: float = 0.25, keep_s: float = KEEP_S) -> DataFrame:
    """(rec_id, version, cut, pos, id, text, start, duration, confidence) from chunks (rec_id, chunk_ix, n_chunks, tokens),
    a stream or a table; tokens is an array of structs of id, text, start, duration and confidence.

    A version is a chunk that has been merged. It has a row with pos -1, which says at which place it cuts what was there,
    and a row for each token that it puts there. Chunks count from 0; without n_chunks a recording's state stays. The time
    and state that a chunk takes do not grow with the recording, other than for seams that reach back by more than keep_s.
    The session's state store becomes the one that keyed state of several kinds needs.
    """
    slim = chunks.select("rec_id", F.col("chunk_ix").cast("int"), F.col("n_chunks").cast("int"), F.to_json("tokens").alias("tokens"))
    kind = chunks.schema["rec_id"].dataType.simpleString()
    spark = chunks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.streams  # noqa: B018  the store's coordinator starts with it, and a table needs one too
    return slim.groupBy("rec_id").transformWithStateInPandas(Stitcher(overlap_s, tolerance, keep_s), f"rec_id {kind}, {_LOG}", "append", "None")


def stitched(log: DataFrame) -> DataFrame:
    """(rec_id, pos, id, text, start, duration, confidence): what a log leaves. A token stays unless a later version cuts at
    its place or before. The scan is over one row a chunk."""
    later = Window.partitionBy("r").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    cuts = log.where("pos < 0").select(F.col("rec_id").alias("r"), F.col("version").alias("v"), F.col("cut").alias("c")).distinct()
    least = cuts.select("r", "v", F.min("c").over(later).alias("least"))
    x = log.where("pos >= 0").drop("cut").dropDuplicates(["rec_id", "version", "pos"])
    x = x.join(least, (F.col("rec_id") == F.col("r")) & (F.col("version") == F.col("v")))
    return x.where("least is null or pos < least").select("rec_id", "pos", "id", "text", "start", "duration", "confidence")


def stream_stitching(
    spark: SparkSession, manifests: str, schema: str, decode: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    of: Row | dict[str, Any] | None = None, overlap_s: float = 15.0, tolerance: float = 0.25, keep_s: float = KEEP_S, files: int | None = None,
) -> StreamingQuery:
    """A streaming query that decodes the chunks of the manifests (JSON rows, one a chunk) once each and appends to the log in
    `out`; `stitched(spark.read.parquet(out))` is its view at any time.

    decode maps chunks to rows (rec_id, chunk_ix, n_chunks, tokens), one a chunk, so that a chunk without words counts too.
    Only the recordings of new chunks are touched. What is merged lives in Spark's state store and its checkpoint, so a run
    that was killed goes on where it was, and what it gives equals an uninterrupted one. With `of`, chunks of other
    fingerprints are not decoded. `files` bounds the manifests of a batch. Ends when all manifests that are there are read.
    """
    stream = spark.readStream.schema(schema)
    chunks = (stream.option("maxFilesPerTrigger", files) if files else stream).json(manifests)
    log = stitch_log(decode(chunks if of is None else valid_rows(chunks, of)), overlap_s, tolerance, keep_s)
    return log.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
