"""Command line: transcribe a recording, mark one or a table of frames, look up a frame, list queries and run one."""

from __future__ import annotations

import argparse
import importlib
import sys
import time
from collections.abc import Sequence
from typing import Any

from pyspark.errors import PySparkException


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tideline")
    sub = p.add_subparsers(dest="verb", required=True)
    t = sub.add_parser("transcribe", help="write the transcript of a media file")
    t.add_argument("media")
    t.add_argument("out")
    t.add_argument("--engines", required=True, help="module:name of a Registry of engines, or of a function that gives one")
    t.add_argument("--diarizer", help="module:name of a function that gives a diarizer")
    t.add_argument("--decoder", help="module:name of a function that gives a decoder; without it the media tools serve")
    for flag in ("--engine", "--language", "--prompt", "--preset", "--status"):
        t.add_argument(flag)
    t.add_argument("--no-resume", action="store_true", help="start over, whatever an earlier run left")
    t.add_argument("--no-diarize", action="store_true", help="write no speakers")
    t.add_argument("--require-diarize", action="store_true", help="fail if speakers cannot be found")
    m = sub.add_parser("mark", help="rank the moments of recordings in a Parquet table of frames, or of a media file into its transcript")
    m.add_argument("frames", help="a table of frames, or a media file if out ends in .json")
    m.add_argument("out")
    m.add_argument("--decoder")
    m.add_argument("--fps", type=float, default=1.0)
    m.add_argument("--delta", type=int, default=8)
    m.add_argument("--budget", type=int, default=40)
    m.add_argument("--gap", type=float, default=5.0)
    f = sub.add_parser("frame", help="write the picture at a time")
    f.add_argument("media")
    f.add_argument("t", type=float)
    f.add_argument("out")
    f.add_argument("--width", type=int)
    q = sub.add_parser("query", help="run a query of the catalogue over a folder of tables")
    q.add_argument("name", nargs="?")
    q.add_argument("folder", nargs="?")
    q.add_argument("out", nargs="?")
    sub.add_parser("help")
    return p


def _named(name: str | None) -> Any:
    if name is None:
        return None
    module, _, what = name.partition(":")
    return getattr(importlib.import_module(module), what)


def _transcribe(a: argparse.Namespace) -> None:
    from .functions.scalars import clock_text
    from .models import Registry, with_preset
    from .sources.media import ToolDecoder
    from .transcribe import transcribe

    engines = _named(a.engines)
    engines = engines if isinstance(engines, Registry) else engines()
    given = with_preset(a.preset, engine=a.engine, language=a.language, prompt=a.prompt)
    diarizer, began = _named(a.diarizer), time.monotonic()
    tell = lambda e: print(f"{e['state']:>10} {100 * e['fraction']:3.0f}%  {clock_text(e['audio_done_s'])}/{clock_text(e['audio_total_s'])}  eta {clock_text(e['eta_s'])}  {e['speed']:.1f}x", file=sys.stderr)
    decoder = _named(a.decoder)() if a.decoder else ToolDecoder()
    doc = transcribe(
        a.media, a.out, engines, decoder, given.get("engine"), given.get("language"), given.get("prompt"), a.status, not a.no_resume, diarizer() if diarizer else None, not a.no_diarize, a.require_diarize,
        warn=lambda x: print(x, file=sys.stderr), on_progress=tell,
    )
    last = doc["sentences"][-1]["end"] if doc["sentences"] else 0.0
    speakers = f", {len(doc['speakers'])} speakers" if "speakers" in doc else ""
    print(f"done: {clock_text(last)} of audio in {clock_text(time.monotonic() - began)}{speakers} -> {a.out}", file=sys.stderr)


def main(args: Sequence[str] | None = None) -> int:
    p = _parser()
    try:
        a = p.parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if a.verb == "help":
            p.print_help()
        elif a.verb == "frame":
            from .sources.media import ToolDecoder, frame

            got = frame(a.media, a.t, ToolDecoder(), a.width)
            with open(a.out, "wb") as f:
                f.write(got)
            print(a.out)
        elif a.verb == "transcribe":
            _transcribe(a)
        elif a.verb == "mark" and a.out.endswith(".json"):
            from .sources.media import ToolDecoder
            from .transcribe import mark_media

            doc = mark_media(a.frames, a.out, _named(a.decoder)() if a.decoder else ToolDecoder(), a.fps, delta=a.delta, budget=a.budget, min_gap_s=a.gap)
            print(f"{len(doc['marks'])} marks -> {a.out}", file=sys.stderr)
        else:
            from pyspark.sql import SparkSession

            from .operators.changes import change_scores_binary, select_marks
            from .plans.catalog import QUERIES

            if a.verb == "query" and not a.name:
                print("\n".join(sorted(QUERIES)))
                return 0
            spark = SparkSession.builder.appName("tideline").getOrCreate()
            if a.verb == "mark":
                select_marks(change_scores_binary(spark.read.parquet(a.frames), a.delta), a.fps, a.budget, a.gap).write.mode("overwrite").parquet(a.out)
                print(a.out)
            else:
                df = QUERIES[a.name](spark, a.folder)
                df.write.mode("overwrite").parquet(a.out) if a.out else df.show(50, False)
        return 0
    except (ValueError, KeyError, RuntimeError, OSError, ImportError, AttributeError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
