"""Transcription and marking of media, the tool edge with scripts in place of media tools, and what goes with them."""

import io
import json
import stat
import wave

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import cli, models, transcribe
from tideline.functions import scalars
from tideline.operators import detectors, document, evaluate, speakers
from tideline.plans import catalog, oracles
from tideline.sources import media
from tideline.streaming import resume


def script(path, text):
    path.write_text("#!/bin/sh\n" + text)
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(path)


def test_tool_that_writes_many_errors_does_not_block(tmp_path):
    noisy = script(tmp_path / "noisy", "head -c 3000000 /dev/zero | tr '\\0' e >&2\nprintf abcdef\n")
    assert b"".join(media.ToolDecoder(noisy, noisy).grid_bytes("x", 1.0, 1, 1)) == b"abcdef"
    bad = script(tmp_path / "bad", "echo 'no such codec' >&2\nexit 3\n")
    with pytest.raises(media.MediaFailure, match="no such codec"):
        list(media.ToolDecoder(bad, bad).grid_bytes("x", 1.0, 1, 1))


def test_silent_tool_is_ended(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "SILENT_S", 0.2)
    mute = script(tmp_path / "mute", "sleep 20\n")
    with pytest.raises(media.MediaFailure, match="silent"):
        list(media.ToolDecoder(mute, mute).grid_bytes("x", 1.0, 1, 1))


def test_progress_lines_torn_between_reads(tmp_path):
    torn = script(tmp_path / "torn", "printf 'frame=1\\nout_time_us=25'\nsleep 0.3\nprintf '00000\\nout_time_us=N/A\\nout_time_us=4000000\\nprogress=end\\n'\n")
    told = []
    media.ToolDecoder(torn, torn).audio("x", "y", 16_000, told.append)
    assert told == [2.5, 4.0]


def wav(samples, rate=10):
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return b.getvalue()


class Decoder:
    """Audio of 30 s at 10 Hz whose samples are their own number; pictures that change at 4 and 8 s."""

    def probe(self, path):
        return {"streams": [{"codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2, "duration": "30"}, {"codec_type": "video", "duration": "12"}], "format": {}}

    def audio(self, path, out, rate, on_progress=None):
        with open(out, "wb") as f:
            f.write(wav(range(300)))
        on_progress(30.0)

    def grid_bytes(self, path, fps, width, height):
        n = width * height
        yield b"".join(bytes([v]) * n for v in [0] * 4 + [100] * 4 + [200] * 4) + b"z" * (n // 2 if path.endswith("cut") else 0)

    def frame(self, path, t, width, exact):
        if t > 12:
            return b""
        return f"{t}".encode()


calls = []


def chunk_model(samples, rate):
    """A token a second, `w7.` where the second ends in 7."""
    calls.append(int(samples[0]))
    first = -(-int(samples[0]) // rate)
    return [(k, f" w{k}" + ("." if k % 10 == 7 else ""), k - int(samples[0]) / rate, 0.5, 1.0) for k in range(first, int(samples[-1]) // rate + 1)]


def engines():
    r = models.Registry()
    r.add(models.Engine("chunked", lambda: chunk_model, rate=10))
    words = [{"word": " salaam", "start": 0.0, "end": 0.5}]
    r.add(models.Engine("whole", lambda: lambda path, language, prompt: [{"start": 0.0, "end": 1.0, "text": f" {language} ", "words": words}], takes_language=True, in_chunks=False, rate=10))
    return r


def diarizer():
    return lambda path: [{"speaker": "B", "start": 10.0, "end": 40.0}, {"speaker": "A", "start": 0.0, "end": 10.0}]


def test_transcribe(tmp_path):
    src, out = tmp_path / "v.mov", tmp_path / "o.json"
    src.write_bytes(b"m")
    told, chunks = [], []
    run = lambda **more: transcribe.transcribe(str(src), str(out), engines(), Decoder(), chunk_s=12.0, overlap_s=4.0, on_progress=told.append, on_chunk=lambda *x: chunks.append(x[:2]), warn=told.append, **more)
    plain = run(diarize=False)
    assert list(plain) == ["audio", "model", "text", "sentences"] and json.loads(out.read_text()) == plain
    assert [w["w"] for s in plain["sentences"] for w in s["tokens"]] == [f" w{k}" + ("." if k % 10 == 7 else "") for k in range(30)]
    assert [s["text"] for s in plain["sentences"]][0] == "".join(f" w{k}" for k in range(8)) + "." and len(plain["sentences"]) == 4
    assert chunks == [(0, 80), (1, 160), (2, 240), (3, 300)] and [x["state"] for x in told][:2] == ["extracting", "extracting"] and told[-1]["state"] == "done"
    labelled = run(diarizer=diarizer())
    assert list(labelled) == ["audio", "model", "speakers", "diarization", "text", "sentences"] and labelled["speakers"] == ["A", "B"]
    assert [s["speaker"] for s in labelled["sentences"]] == ["A", "B", "B", "B"] and list(labelled["sentences"][0]) == ["start", "end", "speaker", "text", "tokens"]
    assert run() == plain and "skipped: no diarizer" in told
    with pytest.raises(resume.Unavailable):
        run(require_diarize=True)
    assert json.loads(out.read_text()) == plain  # the base is written before labels are tried

    def broken(path):
        raise OSError("gone")

    with pytest.raises(OSError):
        run(diarizer=broken)
    assert json.loads(out.read_text()) == plain
    whole = run(engine="whole", language="ur", diarize=False)
    assert whole["text"] == "ur" and whole["sentences"][0]["tokens"] == [{"t": 0.0, "w": " salaam"}]


def test_transcribe_takes_up_where_it_stopped(tmp_path):
    src, out = tmp_path / "v.mov", tmp_path / "o.json"
    src.write_bytes(b"m")

    def stop(k, following, tokens):
        if k == 1:
            raise KeyboardInterrupt

    go = lambda **more: transcribe.transcribe(str(src), str(out), engines(), Decoder(), chunk_s=12.0, overlap_s=4.0, diarize=False, **more)
    with pytest.raises(KeyboardInterrupt):
        go(on_chunk=stop)
    calls.clear()
    resumed = go()
    assert calls == [160, 240] and not (tmp_path / "o.json.ckpt").exists()
    calls.clear()
    assert go() == resumed and calls == [0, 80, 160, 240]
    with pytest.raises(KeyboardInterrupt):
        go(on_chunk=stop)
    calls.clear()
    assert go(resume=False) == resumed and calls == [0, 80, 160, 240]


def test_mark_media_and_verbs(tmp_path, capsys):
    src, out = tmp_path / "v.mov", tmp_path / "o.json"
    src.write_bytes(b"m")
    here = __name__
    verb = ["transcribe", str(src), str(out), "--engines", f"{here}:engines", "--decoder", f"{here}:Decoder"]
    assert cli.main([*verb, "--diarizer", f"{here}:diarizer"]) == 0 and "2 speakers" in capsys.readouterr().err
    base = json.loads(out.read_text())
    assert cli.main(["mark", str(src), str(out), "--decoder", f"{here}:Decoder"]) == 0
    doc = json.loads(out.read_text())
    assert {k: doc[k] for k in base} == base and [m["t"] for m in doc["marks"]] == [4.0] and doc["marks_meta"]["frames_sampled"] == 12
    got = transcribe.mark_media(str(src), str(out), Decoder(), min_gap_s=0.0)
    assert [(m["t"], m["look"]) for m in got["marks"]] == [(4.0, 6.0), (8.0, 9.5)]
    assert cli.main([*verb, "--no-diarize", "--status", str(tmp_path / "s.json")]) == 0 and "speakers" not in capsys.readouterr().err
    assert json.loads((tmp_path / "s.json").read_text())["state"] == "done"
    assert cli.main([*verb, "--language", "ur"]) == 1 and "neither language" in capsys.readouterr().err
    assert cli.main([*verb, "--require-diarize"]) == 1
    assert cli.main(["transcribe", str(src), str(out), "--engines", "no.such:thing"]) == 1
    (tmp_path / "list.json").write_text("[]")
    assert cli.main(["mark", str(src), str(tmp_path / "list.json"), "--decoder", f"{here}:Decoder"]) == 1
    assert (tmp_path / "list.json").read_text() == "[]"


def test_no_resume_reaches_the_run(tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(transcribe, "transcribe", lambda *a, **k: seen.append((a[8], a[10], a[11])) or {"sentences": []})
    verb = ["transcribe", "m", "o", "--engines", f"{__name__}:engines"]
    for more in ([], ["--no-resume"], ["--no-diarize"], ["--require-diarize"]):
        assert cli.main([*verb, *more]) == 0
    assert seen == [(True, True, False), (False, True, False), (True, False, False), (True, True, True)]


def test_frames_by_key_and_partial_frames(spark, tmp_path):
    p = tmp_path / "v.mov"
    p.write_bytes(b"m")
    ask = spark.createDataFrame([("r", str(p), 1.5), ("r", str(p), 99.0), ("r", str(p) + "x", 1.0), ("r", str(p), -1.0)], "rec_id string, path string, t double")
    got = {(r.t, r.picture and bytes(r.picture), r.error) for r in media.frames_at(ask, Decoder()).collect()}
    assert (1.5, b"1.5", None) in got and sorted(e.split(":")[0] for _, x, e in got if x is None) == ["FileNotFoundError", "MediaFailure", "ValueError"]
    cut = tmp_path / "v.cut"
    cut.write_bytes(b"m")
    told = []
    assert len(list(media.grid(str(cut), Decoder(), 2.0, 2, 2, told.append, drop_partial=True))) == 12 and told == [6.0]
    with pytest.raises(media.MediaFailure):
        list(media.grid(str(cut), Decoder(), 2.0, 2, 2))


def test_cache_is_by_what_it_holds(spark, tmp_path):
    made = []
    make = lambda n: lambda: made.append(n) or spark.range(n).withColumnRenamed("id", "frame_ix")
    for n, fps in ((2, 1), (2, 1), (5, 2)):
        assert media.cached_frames(spark, str(tmp_path / "c"), make(n), {"path": "v", "fps": fps}).count() == n
    assert made == [2, 5]


def test_annotations_fetch_and_append(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text('{"video_path":"a","app":"x","keyframes":[{"frame":3},{"frame":9}]}\n{"video_path":"b","app":"y","keyframes":[]}\n')
    assert [tuple(r) for r in media.keyframes_from_lines(spark, str(tmp_path / "k.jsonl")).collect()] == [("a", "x", 3), ("a", "x", 9)]

    def fetch(url):
        if url == "bad":
            raise OSError("down")
        return url.encode() * 3

    got = {r.url: (r.content, r.error) for r in media.fetched(spark.createDataFrame([("ab",), ("bad",), ("long" * 9,)], "url string"), fetch, most=20).collect()}
    assert got["ab"] == (bytearray(b"ababab"), None) and "down" in got["bad"][1] and "more than 20" in got["long" * 9][1]
    for n in (2, 3):
        document.append_lines(spark.range(n), str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 5


def test_log_mel_and_describe(spark):
    t = np.arange(16_000) / 16_000
    m = models.log_mel((np.sin(2 * np.pi * 440 * t) * 20_000).astype(np.int16))
    assert m.shape == (98, 80) and len(set(m.argmax(1))) == 1 and models.log_mel(np.zeros(10)).shape == (0, 80)
    high = models.log_mel(np.sin(2 * np.pi * 4_000 * t))
    assert high[0].argmax() > m[0].argmax()
    p = spark.createDataFrame([("r", 1.0, bytearray(b"xy"))], "rec_id string, t double, picture binary")
    assert models.describe(p, lambda: lambda b, prompt: f"{len(b)}").first().output == "2"


def test_streaming_chunks_are_stitched_and_checked(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "rec_id string, chunk_ix int, fingerprint struct<schema:int,model_id:string>"
    rows = [("r", k, (1, "m")) for k in range(3)] + [("r", 9, (1, "other"))]
    spark.createDataFrame(rows, schema).write.json(src)
    told = []
    listener = resume.ChunkProgress(lambda batch, n: told.append(n))
    spark.streams.addListener(listener)

    def decode(chunks):
        x = chunks.withColumn("id", F.explode(F.sequence(F.col("chunk_ix") * 8, F.col("chunk_ix") * 8 + 11)))
        return x.select("rec_id", "chunk_ix", F.col("id").alias("pos"), "id", F.concat(F.lit(" w"), "id").alias("text"), F.col("id").cast("double").alias("start"), F.lit(0.5).alias("duration"), F.lit(1.0).alias("confidence"))

    run = lambda: [r.id for r in resume.stream_stitched(spark, src, schema, decode, out, ck, {"schema": 1, "model_id": "m"}, 4.0).orderBy("pos").collect()]
    assert run() == list(range(28))
    spark.createDataFrame([("r", 3, (1, "m"))], schema).write.mode("append").json(src)
    assert run() == list(range(36))
    spark.streams.removeListener(listener)


def test_strict_labels_and_empty_turns(spark):
    a = spark.createDataFrame([("r", 0, 1), ("r", 1, 2)], "rec_id string, sent_ix int, speaker int")
    assert speakers.disagreements(a, a.withColumn("speaker", F.lit(1))).first().different == 1
    with pytest.raises(Exception, match="lacks sentence r/1"):
        speakers.disagreements(a, a.where("sent_ix = 0")).collect()
    tokens = spark.createDataFrame([("r", 0, 0, 1.0)], "rec_id string, sent_ix int, pos long, t double")
    with pytest.raises(ValueError, match="empty list of turns"):
        speakers.label_sentences(tokens, spark.createDataFrame([], "rec_id string, start double, end double, speaker int"))


def test_mask_takes_in_equality(spark):
    activity = spark.createDataFrame([("r", 0, 0.2), ("r", 1, 0.1), ("r", 2, 0.0), ("r", 3, 0.0)], "rec_id string, tile_ix int, activity double")
    assert tuple(detectors.noise_mask(activity, 0.2, 0.25).first()) == ("r", 0.25, True)
    assert tuple(detectors.noise_mask(activity, 0.1, 0.25).first()) == ("r", 0.5, False)


def test_marks_at_the_ends_count_as_the_nearest_second(spark):
    seconds = spark.createDataFrame([("r", 1, 0.9), ("r", 2, 0.1), ("r", 3, 0.1)], "rec_id string, second int, instability double")
    marks = spark.createDataFrame([("r", 0.0), ("r", 2.5), ("r", 9.0)], "rec_id string, t double")
    assert tuple(evaluate.unstable_share(marks, seconds, 0.3).first()) == ("r", 3, 1)


def test_sigma_needs_a_spread(spark):
    ours = spark.createDataFrame([("a", 0.9), ("b", 0.9)], "rec_id string, coverage double")
    draws = spark.createDataFrame([("a", 0, 0.4), ("a", 1, 0.6), ("b", 0, 0.5), ("b", 1, 0.5)], "rec_id string, draw int, coverage double")
    got = {r.rec_id: r.sigma for r in evaluate.sigma_above_random(ours, draws, "coverage").collect()}
    assert got == {"a": 4.0, "b": None}


def test_progress_line(spark):
    """Fixed value: the line that the sample of 750 s of 4427.028 s after 21.5 s must give."""
    r = spark.createDataFrame([(750.0, 4427.028, 0.0, 21.5)], "d double, t double, f double, e double")
    x = r.select(scalars.progress_bar(F.col("d"), F.col("t"), F.col("f"), F.col("e"), F.lit("running")).alias("x")).first().x
    assert x == "   running [####--------------------]  17%  12:30/1:13:47 audio  elapsed 0:21  eta 1:45  34.9x"


def test_progress_bar_rounds_as_its_sql(spark, tmp_path):
    """Speeds that lie between two tenths, or are nearly there; below zero, none, and unknown."""
    values = {20: 3.59, 40: 3.06, 60: 1.99, 80: 50.28, 100: 492.95, 140: 536.45, 540: 478.55, 1660: 558.93, 6880: 817.28, 13580: 171.75, 17180: 577.53, 22080: 167.6, 0: 9.0, 1: None}
    spark.createDataFrame([*values.items(), (None, 9.0)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.QUERIES["progress_bar"](spark, str(tmp_path)).collect()
    want = con.sql(f"select event_id, bar from ({oracles.SQL['progress_bar']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert any(r.bar and r.bar.endswith(" 0.0x") for r in got if r.event_id == 60)


def test_models_run_in_tasks(spark, tmp_path):
    chunks = spark.createDataFrame([("r", 0, 0, 120, 80, "p"), ("r", 1, 80, 200, 160, "p")], "rec_id string, chunk_ix int, start long, end long, next_start long, path string")
    got = models.decode_chunks(chunks, lambda: chunk_model, lambda path, a, b: np.arange(a, b), 10).orderBy("chunk_ix", "pos").collect()
    assert [(r.chunk_ix, r.chunk_start, r.id, r.start) for r in got][:2] == [(0, 0, 0, 0.0), (0, 0, 1, 1.0)] and [(r.pos, r.id, r.start) for r in got if r.chunk_ix == 1][:2] == [(0, 8, 0.0), (1, 9, 1.0)]
    paths = spark.createDataFrame([("r", "p")], "rec_id string, path string")
    s = models.decode_files(paths, lambda: lambda path, language, prompt: [{"start": 0.0, "end": 1.0, "text": f"{path}{language}{prompt}", "words": None}], "ur", "x").first().segments
    assert [(x.text, x.words) for x in s] == [("purx", None)]
    assert [tuple(r) for r in models.diarize(paths, diarizer).orderBy("start").collect()] == [("r", 0.0, 10.0, 0), ("r", 10.0, 40.0, 1)]
    assert models.diarize(paths, lambda: lambda path: None).count() == 0


def test_probes_by_row_and_sheets(spark, tmp_path):
    p = tmp_path / "v.mov"
    p.write_bytes(b"m")
    ask = spark.createDataFrame([("a", str(p)), ("b", str(p) + "x")], "rec_id string, path string")
    a, b = media.audio_streams(ask, Decoder()).orderBy("rec_id").collect()
    assert (a.codec, a.sample_rate, a.channels, a.duration_s, a.error) == ("aac", 48_000, 2, 30.0, None) and b.codec is None and b.error.startswith("FileNotFoundError")
    assert media.duration_of({"streams": [{"duration": "N/A"}, {"duration": "4.5"}], "format": {"duration": "9"}}) == 4.5
    assert media.duration_of({"streams": [{}], "format": {"duration": "9"}}) == 9.0 and media.duration_of({"streams": [{}]}) is None
    assert not media.has_video({"streams": [{"codec_type": "audio"}]}) and media.audio_of({"streams": [{"codec_name": "x"}], "format": {"duration": "?"}}).duration_s == 0.0
    sheet = spark.createDataFrame([(1.5, 2, "x")], "Key double, Slidenumber int, Value string")
    assert tuple(media.slides_from_table(sheet).first()) == (1.5, 2, "x")
    assert tuple(media.slides_from_table(sheet.withColumnRenamed("Key", "Time")).first()) == (1.5, 2, "x")
    with pytest.raises(ValueError, match="Time or Key"):
        media.slides_from_table(sheet.drop("Key"))


def test_grids_as_a_source(spark, tmp_path):
    paths = [tmp_path / f"{k}.mov" for k in range(2)]
    for p in paths:
        p.write_bytes(b"m")
    spark.dataSource.register(media.grid_source(Decoder, "testgrid"))
    df = spark.read.format("testgrid").option("paths", ",".join(map(str, paths))).option("width", 3).option("height", 2).load()
    assert df.count() == 24 and {len(r.tiles) for r in df.collect()} == {6} and df.rdd.getNumPartitions() == 2


def test_numbers_of_chunks(spark):
    from tideline.operators import chunks

    for total in (0, 1, 80, 81, 300, 1_680_000):
        rows = chunks.chunk_geometry(spark.createDataFrame([("r", total)], "rec_id string, total long"), 10, 12.0, 4.0).count()
        assert rows == chunks.n_chunks(total, 10, 12.0, 4.0)
    assert chunks.n_chunks(5_760_000) == 4
    assert spark.range(1).select(evaluate.per_minute_budget(F.lit(150.0), 1.0), evaluate.per_minute_budget(F.lit(10.0), 1.0), evaluate.per_minute_budget(F.lit(210.0), 1.0)).first()[:] == (2, 2, 4)
