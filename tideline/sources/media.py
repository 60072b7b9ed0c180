"""Media behind a decoder that can be exchanged: probes, audio, tile grids and single frames.

The decoder is the edge to media tools. `ToolDecoder` runs them as child processes; tests and other stores give their own.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import os
import select
import shutil
import subprocess
import tempfile
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..schemas import KEYFRAMES

#: Seconds that a tool may take to answer a probe or to end, and that it may be silent while it decodes.
WAIT_S, SILENT_S = 30, 600
#: Seconds that are decoded before a place that is sought, and within which requests of one file share a decode.
PREROLL_S, SHARED_S = 5.0, 20.0
_PNG = b"\x89PNG\r\n\x1a\n"


class MediaFailure(RuntimeError):
    pass


class ToolMissing(MediaFailure):
    pass


class NoAudio(MediaFailure):
    pass


class NoVideo(MediaFailure):
    pass


@dataclass(frozen=True)
class AudioStream:
    codec: str
    sample_rate: int
    channels: int
    duration_s: float  # 0: not known


def _number(x: Any) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def audio_of(probe: dict[str, Any]) -> AudioStream:
    """The first audio stream of a probe's JSON; its own duration wins over the container's."""
    streams = [s for s in probe.get("streams", []) if s.get("codec_type", "audio") == "audio"]
    if not streams:
        raise NoAudio("no audio stream")
    s = streams[0]
    d = _number(s.get("duration"))
    d = _number(probe.get("format", {}).get("duration")) if d is None else d
    return AudioStream(s.get("codec_name", ""), int(s.get("sample_rate", 0)), int(s.get("channels", 0)), d or 0.0)


def has_video(probe: dict[str, Any]) -> bool:
    return any(s.get("codec_type") == "video" for s in probe.get("streams", []))


def duration_of(probe: dict[str, Any]) -> float | None:
    """The first duration that is a number, streams before the container; None claims nothing."""
    found = [*(s.get("duration") for s in probe.get("streams", [])), probe.get("format", {}).get("duration")]
    return next((d for d in map(_number, found) if d is not None), None)


class Decoder(Protocol):
    def probe(self, path: str) -> dict[str, Any]: ...

    def grid_bytes(self, path: str, fps: float, width: int, height: int) -> Iterator[bytes]: ...

    def audio(self, path: str, out: str, rate: int, on_progress: Callable[[float], None] | None) -> None: ...

    def frame(self, path: str, t: float, width: int | None, exact: bool) -> bytes: ...


class ToolDecoder:
    """ffprobe and ffmpeg, looked up where the task runs. Waits are bounded: a tool that hangs must not hang a task."""

    def __init__(self, ffmpeg: str = "ffmpeg", ffprobe: str = "ffprobe"):
        self.names = ffmpeg, ffprobe

    def _tool(self, k: int) -> str:
        at = shutil.which(self.names[k])
        if not at:
            raise ToolMissing(f"{self.names[k]} is not on the PATH of this executor")
        return at

    def probe(self, path: str) -> dict[str, Any]:
        run = subprocess.run([self._tool(1), "-v", "error", "-print_format", "json", "-show_streams", "-show_format", path], capture_output=True, timeout=WAIT_S)
        if run.returncode:
            raise MediaFailure(run.stderr.decode(errors="replace")[-500:])
        return json.loads(run.stdout)

    def _pipe(self, args: list[str], step: int) -> Iterator[bytes]:
        """What the tool writes, up to `step` bytes at a time. Its errors go to a file, as a pipe that nobody reads would stop
        it once full; it has no input to wait for; and one that is silent for too long is ended."""
        with tempfile.TemporaryFile() as errors, subprocess.Popen([self._tool(0), "-nostdin", "-v", "error", *args], stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=errors) as p:
            try:
                while True:
                    if not select.select([p.stdout], [], [], SILENT_S)[0]:
                        raise MediaFailure(f"{self.names[0]} was silent for {SILENT_S} s")
                    if not (got := os.read(p.stdout.fileno(), step)):
                        break
                    yield got
                if p.wait(WAIT_S):
                    errors.seek(0)
                    raise MediaFailure(errors.read().decode(errors="replace")[-500:])
            finally:
                if p.poll() is None:
                    p.kill()

    def grid_bytes(self, path: str, fps: float, width: int, height: int) -> Iterator[bytes]:
        # sampling comes before scaling, so only frames that are kept are scaled
        return self._pipe(["-i", path, "-an", "-vf", f"fps={fps},scale={width}:{height},format=gray", "-f", "rawvideo", "-"], width * height * 64)

    def grid_range_bytes(self, path: str, fps: float, width: int, height: int, first: int, n: int | None) -> Iterator[bytes]:
        """Frames from `first` on, n of them or all: a coarse seek to some seconds before, which are decoded and left out. It
        gives what a whole scan gives there; `seek_differences` tells for a file whether that holds."""
        t = first / fps
        near = max(0.0, t - PREROLL_S)
        some = ["-frames:v", str(n)] if n is not None else []
        return self._pipe(["-ss", f"{near:.6f}", "-i", path, "-ss", f"{t - near:.6f}", "-an", "-vf", f"fps={fps},scale={width}:{height},format=gray", *some, "-f", "rawvideo", "-"], width * height * 64)

    def pictures(self, path: str, times: list[float], width: int | None) -> list[bytes]:
        """The pictures of ascending times by one decode from the first to the last; fewer if the file ends before."""
        near = max(0.0, times[0] - PREROLL_S)
        wanted = "+".join(f"lt(prev_pts*TB,{t - near:.6f})*gte(pts*TB,{t - near:.6f})" for t in times)
        filters = ",".join([f"select='{wanted}'", *([f"scale={width}:-2"] if width else [])])
        stream = b"".join(self._pipe(["-ss", f"{near:.6f}", "-i", path, "-to", f"{times[-1] - near + 1:.6f}", "-vf", filters, "-fps_mode", "passthrough", "-f", "image2pipe", "-c:v", "png", "-"], 1 << 16))
        return [_PNG + part for part in stream.split(_PNG)[1:]]

    def audio(self, path: str, out: str, rate: int, on_progress: Callable[[float], None] | None = None) -> None:
        rest = b""
        for got in self._pipe(["-y", "-i", path, "-vn", "-ac", "1", "-ar", str(rate), "-c:a", "pcm_s16le", "-progress", "-", out], 4096):
            *lines, rest = (rest + got).split(b"\n")  # a line may come in two reads
            for line in lines:
                key, _, value = line.decode(errors="replace").strip().partition("=")
                if key == "out_time_us" and on_progress and (v := _number(value)) is not None:
                    on_progress(v / 1e6)

    def frame(self, path: str, t: float, width: int | None, exact: bool) -> bytes:
        scale = ["-vf", f"scale={width}:-2"] if width else []
        near = max(0.0, t - 5.0)
        seek = ["-i", path, "-ss", str(t)] if exact else ["-ss", str(near), "-i", path, "-ss", str(t - near)]
        return b"".join(self._pipe([*seek, *scale, "-frames:v", "1", "-f", "image2pipe", "-c:v", "png", "-"], 1 << 16))


def _present(path: str) -> None:
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)


def probe(path: str, decoder: Decoder) -> AudioStream:
    _present(path)
    return audio_of(decoder.probe(path))


def _checked(path: str, decoder: Decoder, fps: float, width: int, height: int) -> dict[str, Any]:
    if not fps > 0 or width <= 0 or height <= 0:
        raise ValueError("fps and grid must be above zero")
    _present(path)
    p = decoder.probe(path)
    if not has_video(p):
        raise NoVideo(path)
    return p


def _whole(path: str, reads: Iterator[bytes], step: int, drop_partial: bool, on_read: Callable[[int], None] | None = None) -> Iterator[bytes]:
    rest, n = bytearray(), 0
    for got in reads:
        rest += got
        whole = len(rest) // step
        for k in range(whole):
            yield bytes(rest[k * step : (k + 1) * step])
        del rest[: whole * step]
        n += whole
        if whole and on_read:
            on_read(n)
    if rest and not drop_partial:
        raise MediaFailure(f"{path}: the last frame has {len(rest)} of {step} bytes")


def grid(path: str, decoder: Decoder, fps: float, width: int, height: int, on_progress: Callable[[float], None] | None = None, drop_partial: bool = False) -> Iterator[bytes]:
    """Frames of width x height bytes. A last frame cut short is an error, or left out with drop_partial; no frame at all is
    none. on_progress is told the seconds that have been read, after each read that ends a frame."""
    _checked(path, decoder, fps, width, height)
    yield from _whole(path, decoder.grid_bytes(path, fps, width, height), width * height, drop_partial, on_progress and (lambda n: on_progress(n / fps)))


def grid_range(path: str, decoder: Decoder, fps: float, width: int, height: int, first: int = 0, end: int | None = None, drop_partial: bool = False) -> Iterator[tuple[int, bytes]]:
    """(frame_ix, tiles) of frames first to end - 1, or to the last. A decoder that seeks (`grid_range_bytes`) reads no more than
    that; from others all that comes before is read and left out, so the frames are the same."""
    if first < 0 or (end is not None and end <= first):
        return
    _checked(path, decoder, fps, width, height)
    n = None if end is None else end - first
    if (first or n is not None) and hasattr(decoder, "grid_range_bytes"):
        got = _whole(path, decoder.grid_range_bytes(path, fps, width, height, first, n), width * height, drop_partial)
        yield from ((first + k, tiles) for k, tiles in enumerate(itertools.islice(got, n)))
    else:
        got = _whole(path, decoder.grid_bytes(path, fps, width, height), width * height, drop_partial)
        yield from itertools.islice(enumerate(got), first, end)


def frame_ranges(path: str, decoder: Decoder, fps: float, split_s: float, duration_s: float | None = None) -> list[tuple[int, int | None]]:
    """Ranges of frames of split_s seconds that cover a file by its duration; the last one is open, as durations are claims."""
    d = duration_of(decoder.probe(path)) if duration_s is None else duration_s
    step = max(1, round(split_s * fps))
    starts = list(range(0, max(1, int((d or 0) * fps)), step))
    return list(zip(starts, [*starts[1:], None], strict=True))


def frame(path: str, t: float, decoder: Decoder, width: int | None = None) -> bytes:
    """The picture at t: a coarse seek with an exact decode of its last seconds, else a full decode."""
    if t < 0 or (width is not None and width <= 0):
        raise ValueError("t must not be negative, width must be above zero")
    _present(path)
    p = decoder.probe(path)
    if not has_video(p):
        raise NoVideo(path)
    for exact in (False, True):
        try:
            if got := decoder.frame(path, t, width, exact):
                return got
        except MediaFailure:
            if exact:
                raise
    d = duration_of(p)
    raise MediaFailure(f"{path}: {t} s lies beyond its end at {d} s" if d is not None and t > d else f"{path}: no picture at {t} s")


def frames_at(requests: DataFrame, decoder: Decoder, width: int | None = None) -> DataFrame:
    """(rec_id, t, picture, error) for requests (rec_id, path, t): keyed lookup of single frames; one that cannot be met has an
    error and no picture.

    Requests of one file come together in order of time, and those within SHARED_S of each other share a decode, where the
    decoder can do that (`pictures`); what it does not bring is asked for by itself.
    """
    kind = requests.schema["rec_id"].dataType.simpleString()

    def near(rows: Iterator[tuple[Any, str, float]]) -> Iterator[list[tuple[Any, str, float]]]:
        some: list[tuple[Any, str, float]] = []
        for row in rows:
            if some and (row[1] != some[0][1] or not row[2] - some[0][2] <= SHARED_S):
                yield some
                some = []
            some.append(row)
        if some:
            yield some

    def shared(some: list[tuple[Any, str, float]]) -> dict[float, bytes]:
        times = sorted({t for _, _, t in some if t >= 0})
        if len(times) < 2 or not hasattr(decoder, "pictures"):
            return {}
        try:
            _present(some[0][1])
            got = decoder.pictures(some[0][1], times, width)
        except (MediaFailure, FileNotFoundError):
            return {}
        return dict(zip(times, got, strict=False)) if len(got) == len(times) else {}

    def run(batches):
        import pandas as pd

        for some in near(row for pdf in batches for row in zip(pdf["rec_id"], pdf["path"], pdf["t"], strict=True)):
            have = shared(some)
            for rec_id, path, t in some:
                try:
                    row = (rec_id, t, have.get(t) or frame(path, t, decoder, width), None)
                except (MediaFailure, FileNotFoundError, ValueError) as e:
                    row = (rec_id, t, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["rec_id", "t", "picture", "error"])

    asked = requests.select("rec_id", "path", F.col("t").cast("double")).repartition("path", F.floor(F.col("t") / (30 * SHARED_S))).sortWithinPartitions("path", "t")
    return asked.mapInPandas(run, f"rec_id {kind}, t double, picture binary, error string")


def frames(paths: DataFrame, decoder: Decoder, fps: float = 1.0, width: int = 128, height: int = 84, drop_partial: bool = False, split_s: float | None = None) -> DataFrame:
    """(rec_id, frame_ix, tiles) for (rec_id, path): frames leave as they come. Each recording is read by one task, or with
    split_s in parts of so many seconds by many; the parts are found by tasks too."""
    if not fps > 0 or width <= 0 or height <= 0:
        raise ValueError("fps and grid must be above zero")
    kind = paths.schema["rec_id"].dataType.simpleString()

    def parts(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(r, p, a, -1 if b is None else b) for r, p in zip(pdf["rec_id"], pdf["path"], strict=True) for a, b in (frame_ranges(p, decoder, fps, split_s) if split_s else [(0, None)])]
            yield pd.DataFrame(rows, columns=["rec_id", "path", "first", "end"])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for rec_id, path, first, end in zip(pdf["rec_id"], pdf["path"], pdf["first"], pdf["end"], strict=True):
                rows: list[tuple[Any, int, bytes]] = []
                for i, tiles in grid_range(path, decoder, fps, width, height, int(first), None if end < 0 else int(end), drop_partial):
                    rows.append((rec_id, i, tiles))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=["rec_id", "frame_ix", "tiles"])
                        rows = []
                yield pd.DataFrame(rows, columns=["rec_id", "frame_ix", "tiles"])

    some = paths.select("rec_id", "path").mapInPandas(parts, f"rec_id {kind}, path string, first int, end int")
    if split_s:
        some = some.repartition("path", "first")
    return some.mapInPandas(run, f"rec_id {kind}, frame_ix int, tiles binary")


def audio_streams(paths: DataFrame, decoder: Decoder) -> DataFrame:
    """(rec_id, codec, sample_rate, channels, duration_s, error) for (rec_id, path); one that cannot be read has an error."""
    kind = paths.schema["rec_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for rec_id, path in zip(pdf["rec_id"], pdf["path"], strict=True):
                try:
                    s = probe(path, decoder)
                    rows.append((rec_id, s.codec, s.sample_rate, s.channels, s.duration_s, None))
                except (MediaFailure, FileNotFoundError) as e:
                    rows.append((rec_id, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["rec_id", "codec", "sample_rate", "channels", "duration_s", "error"]).astype({"sample_rate": "Int32", "channels": "Int32"})

    return paths.select("rec_id", "path").mapInPandas(run, f"rec_id {kind}, codec string, sample_rate int, channels int, duration_s double, error string")


def samples_of_wav(content: bytes) -> np.ndarray:
    """Mono 16-bit PCM of a WAV file as samples."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2 or w.getnchannels() != 1:
            raise MediaFailure("not mono 16-bit PCM")
        return np.frombuffer(w.readframes(w.getnframes()), "<i2")


def seek_differences(full: DataFrame, part: DataFrame, shift: int) -> DataFrame:
    """(rec_id, frames, different): frames of a seeked scan that are not those of the full scan `shift` later."""
    p = part.select("rec_id", (F.col("frame_ix") + shift).alias("frame_ix"), F.col("tiles").alias("other"))
    j = p.join(full, ["rec_id", "frame_ix"], "left")
    return j.groupBy("rec_id").agg(F.count("*").alias("frames"), F.count_if(~F.col("tiles").eqNullSafe(F.col("other"))).alias("different"))


def seek_report(paths: DataFrame, decoder: Decoder, fps: float, width: int, height: int, at: float = 0.5) -> DataFrame:
    """(rec_id, frames, different) of a scan that seeks to `at` of each file's duration against a whole scan: whether a file may
    be read in parts."""
    kind = paths.schema["rec_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for rec_id, path in zip(pdf["rec_id"], pdf["path"], strict=True):
                first = int((duration_of(decoder.probe(path)) or 0) * fps * at)
                rows = [(rec_id, i - first, tiles) for i, tiles in grid_range(path, decoder, fps, width, height, first)]
                yield pd.DataFrame([(*row, first) for row in rows], columns=["rec_id", "frame_ix", "tiles", "first"])

    part = paths.select("rec_id", "path").mapInPandas(run, f"rec_id {kind}, frame_ix int, tiles binary, first int")
    part = part.select("rec_id", (F.col("frame_ix") + F.col("first")).alias("frame_ix"), "tiles")
    return seek_differences(frames(paths, decoder, fps, width, height), part, 0)


def cached_frames(spark: SparkSession, table: str, make: Callable[[], DataFrame], of: dict[str, Any] | None = None) -> DataFrame:
    """Frames from a Parquet table, made and written once: decode once, sweep often. `of` says what they are made of (paths,
    rate, grid): each has a table of its own in the folder, so other frames are never taken for these."""
    if of is not None:
        table = f"{table}/{hashlib.sha256(json.dumps(of, sort_keys=True, default=str).encode()).hexdigest()[:16]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        make().write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)


class _Part(InputPartition):
    def __init__(self, path: str, first: int, end: int | None):
        self.path, self.first, self.end = path, first, end


class _GridReader(DataSourceReader):

    def __init__(self, options: dict[str, str], decoder: Decoder):
        some = options.get("paths", options.get("path", ""))
        self.paths = json.loads(some) if some.startswith("[") else [p for p in some.split(",") if p]
        self.fps, self.width, self.height = float(options.get("fps", 1)), int(options.get("width", 128)), int(options.get("height", 84))
        self.split_s = float(options["split_s"]) if "split_s" in options else None
        self.durations = dict(zip(self.paths, map(float, options["durations"].split(",")), strict=True)) if options.get("durations") else {}
        self.decoder = decoder
        self.first, self.end = 0, None

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            for a, b in frame_ranges(p, self.decoder, self.fps, self.split_s, self.durations.get(p)) if self.split_s else [(0, None)]:
                first = max(a, self.first)
                end = b if self.end is None else self.end if b is None else min(b, self.end)
                if end is None or first < end:
                    out.append(_Part(p, first, end))
        return out or [_Part("", 0, 0)]

    def read(self, partition: _Part) -> Iterator[tuple[str, int, bytes]]:
        for i, tiles in grid_range(partition.path, self.decoder, self.fps, self.width, self.height, partition.first, partition.end):
            yield partition.path, i, tiles


class _PrunedGridReader(_GridReader):
    """Reads no file and no second that the query's filters on rec_id and frame_ix leave out."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("rec_id",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = [p for p in self.paths if p in wanted]
            elif column == ("frame_ix",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = {EqualTo: f.value, GreaterThanOrEqual: f.value, GreaterThan: f.value + 1}.get(type(f), 0)
                high = {EqualTo: f.value + 1, LessThan: f.value, LessThanOrEqual: f.value + 1}.get(type(f))
                self.first = max(self.first, low)
                self.end = high if self.end is None else self.end if high is None else min(self.end, high)
            elif column == ("frame_ix",) and isinstance(f, In) and f.value:
                self.first, high = max(self.first, min(f.value)), max(f.value) + 1
                self.end = high if self.end is None else min(self.end, high)
                yield f  # the range is read, what lies between is left to Spark
            elif not (column in (("rec_id",), ("frame_ix",)) and isinstance(f, IsNotNull)):
                yield f


def grid_source(decoder_type: Callable[[], Decoder] = ToolDecoder, name_: str = "tilegrid", pushdown: bool = False) -> type[DataSource]:
    """A Spark data source of tile grids: options paths (by commas, or a JSON list), fps, width, height, split_s and durations.

    A partition is a recording, or split_s seconds of one; the planner asks for durations unless they are given. With pushdown,
    files and seconds that filters leave out are not read; Spark takes such a source only where the session has
    spark.sql.python.filterPushdown.enabled, which `read_grids` sees to.
    """

    class Grid(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return "rec_id string, frame_ix int, tiles binary"

        def reader(self, schema):
            return (_PrunedGridReader if pushdown else _GridReader)(dict(self.options), decoder_type())

    return Grid


def read_grids(spark: SparkSession, paths: list[str], decoder_type: Callable[[], Decoder] = ToolDecoder, fps: float = 1.0, width: int = 128, height: int = 84, split_s: float | None = 600.0, durations: list[float] | None = None) -> DataFrame:
    """(rec_id, frame_ix, tiles) of files, rec_id being the path: read in parts of split_s seconds, and only where filters ask."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = grid_source(decoder_type, "tilegrid_pruned", pushdown=True)
    spark.dataSource.register(source)
    options = {"paths": json.dumps(paths), "fps": fps, "width": width, "height": height} | ({"split_s": split_s} if split_s else {}) | ({"durations": ",".join(map(str, durations))} if durations else {})
    return spark.read.format(source.name()).options(**options).load()


def keyframes_from_lines(spark: SparkSession, path: str) -> DataFrame:
    """(video_path, app, frame) of annotations, a JSON object a line."""
    return spark.read.schema(KEYFRAMES).json(path).select("video_path", "app", F.explode("keyframes.frame").alias("frame"))


def fetched(wanted: DataFrame, fetch: Callable[[str], bytes], tries: int = 3, most: int = 1 << 30) -> DataFrame:
    """(url, content, error) for (url): what `fetch` gives after up to `tries` tries. Too much, or nothing after the last
    try, is an error in the row, so what is missing is seen."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for url in pdf["url"]:
                content, error = None, None
                for _ in range(tries):
                    try:
                        content, error = fetch(url), None
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a fetch is told in its row
                        error = f"{type(e).__name__}: {e}"
                if content is not None and len(content) > most:
                    content, error = None, f"{len(content)} bytes are more than {most}"
                yield pd.DataFrame([(url, content, error)], columns=["url", "content", "error"])

    return wanted.select("url").mapInPandas(run, "url string, content binary, error string")


def slides_from_table(df: DataFrame) -> DataFrame:
    """(time, slide, value) of a sentence-to-slide table whose time column is Time or Key."""
    have = set(df.columns)
    times = [F.col(c) for c in ("Time", "Key") if c in have]
    if not times or not {"Slidenumber", "Value"} <= have:
        raise ValueError(f"need Time or Key, Slidenumber and Value; have {sorted(have)}")
    return df.select(F.coalesce(*times).cast("double").alias("time"), F.col("Slidenumber").cast("int").alias("slide"), F.col("Value").alias("value"))
