"""Models at the edge: contracts, a registry, and the frames that run them. No model is part of this engine."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .streaming.resume import Unavailable


class ChunkModel(Protocol):
    """Decodes one chunk on its own: tokens (id, text, start, duration, confidence) in the chunk's time."""

    def __call__(self, samples: Any, rate: int) -> list[tuple[int, str, float, float, float]]: ...


class FileModel(Protocol):
    """Decodes a whole file: segments (start, end, text, words)."""

    def __call__(self, path: str, language: str | None, prompt: str | None) -> list[dict[str, Any]]: ...


class Diarizer(Protocol):
    """Merged segments (speaker, start, end) of a file; none or an empty list if it found nobody."""

    def __call__(self, path: str) -> list[dict[str, Any]] | None: ...


@dataclass
class Engine:
    name: str
    load: Callable[[], Any]
    takes_language: bool = False
    in_chunks: bool = True
    rate: int = 16_000


@dataclass
class Registry:
    engines: dict[str, Engine] = field(default_factory=dict)
    default: str = "chunked"

    def add(self, engine: Engine) -> None:
        self.engines[engine.name] = engine

    def get(self, name: str | None = None, language: str | None = None, prompt: str | None = None) -> Engine:
        name = name or self.default
        if name not in self.engines:
            raise ValueError(f"unknown engine {name}; known: {', '.join(sorted(self.engines)) or 'none'}")
        e = self.engines[name]
        if (language or prompt) and not e.takes_language:
            raise ValueError(f"{name} takes neither language nor prompt")
        return e


#: A preset fills what is not given.
PRESETS: dict[str, dict[str, str]] = {"roman": {"engine": "whole", "language": "en", "prompt": "Write in Roman letters."}}


def with_preset(preset: str | None, **given: str | None) -> dict[str, str | None]:
    base: dict[str, str | None] = dict(PRESETS[preset]) if preset else {}
    return base | {k: v for k, v in given.items() if v is not None}


def decode_chunks(chunks: DataFrame, load: Callable[[], ChunkModel], samples: Callable[[str, int, int], Any], rate: int = 16_000) -> DataFrame:
    """(rec_id, chunk_ix, chunk_start, pos, id, text, start, duration, confidence) for chunks with a path; the model is
    loaded once per worker and chunks are decoded side by side, each with fresh state."""
    kind = chunks.schema["rec_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or load()
            rows = [(r.rec_id, r.chunk_ix, r.start, p, *t) for r in pdf.itertuples() for p, t in enumerate(model(samples(r.path, r.start, r.end), rate))]
            yield pd.DataFrame(rows, columns=["rec_id", "chunk_ix", "chunk_start", "pos", "id", "text", "start", "duration", "confidence"])

    return chunks.mapInPandas(run, f"rec_id {kind}, chunk_ix int, chunk_start long, pos int, id int, text string, start double, duration double, confidence double")


def decode_files(paths: DataFrame, load: Callable[[], FileModel], language: str | None = None, prompt: str | None = None) -> DataFrame:
    """(rec_id, segments) for (rec_id, path)."""
    kind = paths.schema["rec_id"].dataType.simpleString()
    segment = "struct<start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double>>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or load()
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "segments": [model(p, language, prompt) for p in pdf["path"]]})

    return paths.select("rec_id", "path").mapInPandas(run, f"rec_id {kind}, segments array<{segment}>")


def turns_of_segments(segments: list[dict[str, Any]] | None) -> tuple[list[tuple[float, float, int]], list[str]]:
    """(turns, labels): labels by name, turns in time order with the label's number. Nothing found is Unavailable."""
    if not segments:
        raise Unavailable("no speaker segments")
    labels = sorted({s["speaker"] for s in segments})
    return sorted((float(s["start"]), float(s["end"]), labels.index(s["speaker"])) for s in segments), labels


def diarize(paths: DataFrame, load: Callable[[], Diarizer]) -> DataFrame:
    """(rec_id, start, end, speaker) for (rec_id, path); a recording without segments has no rows."""
    kind = paths.schema["rec_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or load()
            rows = []
            for rec_id, path in zip(pdf["rec_id"], pdf["path"], strict=True):
                if found := model(path):
                    rows += [(rec_id, *t) for t in turns_of_segments(found)[0]]
            yield pd.DataFrame(rows, columns=["rec_id", "start", "end", "speaker"])

    return paths.select("rec_id", "path").mapInPandas(run, f"rec_id {kind}, start double, end double, speaker int")


class Describer(Protocol):
    """Says what a picture shows."""

    def __call__(self, picture: bytes, prompt: str) -> str: ...


def describe(pictures: DataFrame, load: Callable[[], Describer], prompt: str = "Copy out all text in this picture.") -> DataFrame:
    """(rec_id, t, seconds, output) for (rec_id, t, picture); the model is loaded once per worker."""
    kind = pictures.schema["rec_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or load()
            rows = []
            for r in pdf.itertuples():
                began = time.monotonic()
                rows.append((r.rec_id, r.t, model(r.picture, prompt), time.monotonic() - began))
            yield pd.DataFrame(rows, columns=["rec_id", "t", "output", "seconds"])

    return pictures.select("rec_id", F.col("t").cast("double"), "picture").mapInPandas(run, f"rec_id {kind}, t double, output string, seconds double")


def log_mel(samples: np.ndarray, rate: int = 16_000, bands: int = 80, window_s: float = 0.025, hop_s: float = 0.010) -> np.ndarray:
    """(frames, bands): logarithms of the energy in bands even on the mel scale, of Hann windows hop_s apart; what chunk
    models read. Samples are numbers of 16 bits or floats from -1 to 1; fewer than a window give no frame."""
    x = np.asarray(samples, np.float64) / (32_768.0 if np.issubdtype(np.asarray(samples).dtype, np.integer) else 1.0)
    size, hop = int(window_s * rate), int(hop_s * rate)
    if len(x) < size:
        return np.zeros((0, bands))
    bins = 1 << (size - 1).bit_length()
    at = np.arange(0, len(x) - size + 1, hop)[:, None] + np.arange(size)
    power = np.abs(np.fft.rfft(x[at] * np.hanning(size), bins)) ** 2
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(0.0, mel(rate / 2), bands + 2) / 2595.0) - 1.0)
    f = np.fft.rfftfreq(bins, 1.0 / rate)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.log(power @ np.maximum(0.0, np.minimum(up, down)) + 1e-10)
