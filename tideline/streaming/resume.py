"""Resumable processing of chunks: fingerprints, checkpoints, progress, and a streaming loop over chunk manifests."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.document import write_text
from ..operators.stitch import Token, stitch, stitch_lists

SCHEMA = 1


@dataclass(frozen=True)
class Fingerprint:
    """What a checkpoint was made from; any difference makes it void. The source is named, never a temporary copy."""

    schema: int
    media: str
    media_size: int
    media_mtime_ns: int
    total_samples: int
    model_id: str
    engine_version: str
    chunk_s: float
    overlap_s: float


def fingerprint(media: str, total_samples: int, model_id: str, engine_version: str, chunk_s: float = 120.0, overlap_s: float = 15.0) -> Fingerprint:
    s = os.stat(media)
    return Fingerprint(SCHEMA, os.path.abspath(media), s.st_size, s.st_mtime_ns, total_samples, model_id, engine_version, chunk_s, overlap_s)


def write_checkpoint(path: str, of: Fingerprint, next_start: int, tokens: list[Token]) -> None:
    names = ("id", "text", "start", "duration", "confidence")
    write_text(path, json.dumps({"fingerprint": asdict(of), "next_start": next_start, "tokens": [dict(zip(names, t, strict=True)) for t in tokens]}), fsync=True)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def read_checkpoint(path: str, of: Fingerprint) -> tuple[int, list[Token]] | None:
    """(next_start, tokens), or None: for no file, no JSON, another fingerprint, or any field missing or of a wrong kind.

    next_start must be a whole number as such; a token's numbers may be whole or not.
    """
    try:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        if doc["fingerprint"] != asdict(of) or type(doc["next_start"]) is not int:
            return None
        out = []
        for t in doc["tokens"]:
            if type(t["id"]) is not int or not isinstance(t["text"], str) or not all(_number(t[k]) for k in ("start", "duration", "confidence")):
                return None
            out.append((t["id"], t["text"], float(t["start"]), float(t["duration"]), float(t["confidence"])))
        return doc["next_start"], out
    except (OSError, ValueError, KeyError, TypeError):
        return None


class Status:
    """A recording's state in a file: extracting, running, diarizing, done, or failed with the error."""

    def __init__(self, path: str | None, total_s: float = 0.0, resumed_from_s: float = 0.0, listener: Callable[[dict[str, Any]], None] | None = None):
        self.listener = listener
        self.path, self.total_s, self.resumed_from_s, self.began = path, total_s, resumed_from_s, time.monotonic()
        self.events: list[dict[str, Any]] = []

    def say(self, state: str, done_s: float = 0.0, **more: Any) -> None:
        took = time.monotonic() - self.began
        part = done_s / self.total_s if self.total_s > 0 else 0.0
        pace = (done_s - self.resumed_from_s) / took if took > 0 else 0.0
        doc = {"state": state, "audio_done_s": done_s, "audio_total_s": self.total_s, "elapsed_s": took, "resumed_from_s": self.resumed_from_s, "fraction": round(part, 4), "speed": round(pace, 2)}
        doc["eta_s"] = (self.total_s - done_s) / pace if pace > 0 and self.total_s > 0 else None
        self.events.append(doc | more)
        if self.listener:
            self.listener(doc | more)
        if self.path:
            write_text(self.path, json.dumps(doc | more))

    def __enter__(self) -> Status:
        return self

    def __exit__(self, kind: Any, error: BaseException | None, trace: Any) -> None:
        if error is not None:
            self.say("failed", error=f"{type(error).__name__}: {error}")


def run_chunks(
    decode: Callable[[int, int], list[Token]], total: int, of: Fingerprint | None = None, checkpoint: str | None = None, rate: int = 16_000, chunk_s: float = 120.0, overlap_s: float = 15.0, hop: int = 1,
    status: Status | None = None, resume: bool = True, on_chunk: Callable[[int, int, list[Token]], None] | None = None, keep: bool = False,
) -> list[Token]:
    """Decodes chunks in order and stitches their tokens; after each the checkpoint is written before progress is told.

    decode(start, end) gives a chunk's tokens in its own time. What a resumed run gives equals an uninterrupted one; the
    checkpoint goes when all is done. Without `resume` an old checkpoint is deleted first. on_chunk is told each chunk's
    number, where the next begins and all tokens so far, once they are safe. With `keep` the checkpoint stays, for a caller that has yet to write the result.
    """
    chunk, stride = int(chunk_s * rate), int(chunk_s * rate) - int(overlap_s * rate)
    skip, tokens = 0, []
    if checkpoint and not resume and os.path.exists(checkpoint):
        os.unlink(checkpoint)
    if checkpoint and of and (old := read_checkpoint(checkpoint, of)):
        skip, tokens = old
    if status:
        status.resumed_from_s = skip / rate
    starts = list(range(0, total, stride))
    for k, start in enumerate(starts):
        end = min(start + chunk, total)
        if end - start < hop:
            break
        if start < skip:
            continue
        new = [(i, text, at + start / rate, d, c) for i, text, at, d, c in decode(start, end)]
        tokens = stitch_lists([tokens, new], overlap_s)
        following = starts[k + 1] if k + 1 < len(starts) else total
        if checkpoint and of:
            write_checkpoint(checkpoint, of, following, tokens)
        if on_chunk:
            on_chunk(k, following, tokens)
        if status:
            status.say("running", end / rate)
    if checkpoint and not keep and os.path.exists(checkpoint):
        os.unlink(checkpoint)
    return tokens


def stream_chunks(spark: SparkSession, manifests: str, schema: str, decode: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """A streaming query that decodes each chunk of the manifests (JSON rows, one per chunk) once and appends its tokens.

    decode maps a frame of chunks to one of tokens, so chunks are decoded side by side; stitching follows per recording as
    a batch. Spark's checkpoint remembers what is done, and a batch that is run again replaces its own folder, so no chunk
    appears twice. Ends when all manifests that are there have been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        decode(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    chunks = spark.readStream.schema(schema).json(manifests)
    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_stitched(spark: SparkSession, manifests: str, schema: str, decode: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, of: Row | dict[str, Any] | None = None, overlap_s: float = 15.0) -> DataFrame:
    """stream_chunks to its end, then (rec_id, pos, id, text, start, duration, confidence) stitched per recording.

    With `of`, only chunks of manifests with that fingerprint are decoded; others are of another source or model. Chunks that
    an earlier run decoded are taken from `out`, so what a resumed run gives equals an uninterrupted one. decode gives tokens
    (rec_id, chunk_ix, pos, id, text, start, duration, confidence) in the recording's time.
    """
    chosen = decode if of is None else lambda chunks: decode(valid_rows(chunks, of))
    stream_chunks(spark, manifests, schema, chosen, out, checkpoint).awaitTermination()
    return stitch(spark.read.parquet(out).drop("batch"), overlap_s)


class ChunkProgress(StreamingQueryListener):
    """Tells on_progress(batch, chunks) after each batch of a streaming query that had chunks."""

    def __init__(self, on_progress: Callable[[int, int], None]):
        self.on_progress = on_progress

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        if event.progress.numInputRows:
            self.on_progress(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass


class Unavailable(RuntimeError):
    """An optional stage cannot run here; the base result stands."""


def optional_stage(base: Callable[[], Any], stage: Callable[[Any], Any], required: bool = False, warn: Callable[[str], None] = print) -> Any:
    """The stage's result, or the base's if the stage is Unavailable and not required. Other errors are bugs and go on."""
    result = base()
    try:
        return stage(result)
    except Unavailable as e:
        if required:
            raise
        warn(f"skipped: {e}")
        return result


def valid_rows(rows: DataFrame, of: Row | dict[str, Any]) -> DataFrame:
    """Rows of a manifest whose fingerprint struct equals `of` in every field; nulls equal nulls."""
    want = of.asDict() if isinstance(of, Row) else of
    same = F.lit(True)
    for k, v in want.items():
        same = same & F.col(f"fingerprint.{k}").eqNullSafe(F.lit(v))
    return rows.where(same)
