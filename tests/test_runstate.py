"""Progress, checkpoints, resumption with a count of decoded chunks, media behind a fake decoder, models, CLI."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import cli, models
from tideline.functions import scalars
from tideline.operators.stitch import stitch_lists
from tideline.sources import media
from tideline.streaming import resume


@pytest.mark.parametrize("s, want", [(None, "--:--"), (0.0, "0:00"), (59.9, "0:59"), (60.0, "1:00"), (90.9, "1:30"), (3599.0, "59:59"), (3600.0, "1:00:00"), (3661.0, "1:01:01"), (4427.028, "1:13:47")])
def test_clock(spark, s, want):
    assert spark.createDataFrame([(s,)], "s double").select(scalars.clock(F.col("s")).alias("x")).first().x == want


def test_progress(spark):
    r = spark.createDataFrame([(750.0, 4427.028, 0.0, 21.5), (1.0, 0.0, 0.0, 0.0)], "d double, t double, f double, e double")
    a, b = r.select(scalars.fraction(F.col("d"), F.col("t")).alias("x"), scalars.speed(F.col("d"), F.col("f"), F.col("e")).alias("v"), scalars.eta(F.col("d"), F.col("t"), F.col("f"), F.col("e")).alias("eta")).collect()
    assert a.x == pytest.approx(0.16941388218009915) and a.v == pytest.approx(34.883720930232556) and a.eta == pytest.approx(105.408136)
    assert (b.x, b.v, b.eta) == (0.0, 0.0, None)


def test_small_parsers(spark):
    df = spark.createDataFrame([("30/1", "a=1\nout_time_us=2500000\nb=N/A\nout_time_us=5000000"), ("25", ""), ("1/0", "x"), ("?", "out_time_us=N/A")], "r string, k string")
    got = df.select(scalars.frame_rate(F.col("r")).alias("r"), scalars.out_seconds(F.col("k")).alias("s")).collect()
    assert [(x.r, x.s) for x in got] == [(30.0, 5.0), (25.0, None), (None, None), (None, None)]
    n = spark.createDataFrame([("pcm_s16le", 16000, 1), ("aac", 16000, 1), ("pcm_s16le", 48000, 1)], "c string, r int, n int")
    assert [x.x for x in n.select(scalars.needs_conversion(F.col("c"), F.col("r"), F.col("n")).alias("x")).collect()] == [False, True, True]


def tok(i, t):
    return (i, f" w{i}", t, 0.4, 1.0)


def test_stitch():
    a, b = [tok(i, float(i)) for i in range(10)], [tok(i, i + 0.1) for i in range(6, 16)]
    assert [t[0] for t in stitch_lists([a, b], 4.0)] == list(range(16))
    c = [tok(i if i % 2 else 90 + i, float(i)) for i in range(6, 14)]
    assert [t[0] for t in stitch_lists([a, c], 4.0)][:7] == list(range(7)) and stitch_lists([[], a, []], 4.0) == a
    far = [tok(50, 30.0)]
    assert [t[0] for t in stitch_lists([a, far], 4.0)] == [*range(10), 50]


class Stop(Exception):
    pass


def fake(stop_at=None):
    calls = []

    def decode(start, end):
        if stop_at is not None and len(calls) == stop_at:
            raise Stop
        calls.append(start)
        return [tok(k, (k * 16000 - start) / 16000) for k in range(-(-start // 16000), end // 16000)]

    return decode, calls


def test_resume_gives_the_same_and_decodes_less(tmp_path):
    wav, ck = tmp_path / "a.wav", str(tmp_path / "a.ckpt")
    wav.write_bytes(b"x" * 10)
    total = 360 * 16000
    of = resume.fingerprint(str(wav), total, "m", "1")
    decode, calls = fake()
    whole = resume.run_chunks(decode, total)
    assert len(calls) == 4 and [t[0] for t in whole] == list(range(360))
    first, _ = fake(stop_at=2)
    with pytest.raises(Stop):
        resume.run_chunks(first, total, of, ck)
    status = resume.Status(None, total / 16000)
    again, calls = fake()
    assert resume.run_chunks(again, total, of, ck, status=status) == whole
    assert len(calls) == 2 and status.resumed_from_s == 210.0 and not (tmp_path / "a.ckpt").exists()


def test_checkpoint_is_void_for_any_difference(tmp_path):
    ck = str(tmp_path / "c")
    of = resume.Fingerprint(1, "/a", 1, 2, 3, "m", "v", 120.0, 15.0)
    values = [0.1 + 0.2, 1 / 3, 0.9999999999999999, 4426.987654321, 1e-10]
    resume.write_checkpoint(ck, of, 44, [(1, "a", v, 0.5, 1.0) for v in values])
    assert [t[2] for t in resume.read_checkpoint(ck, of)[1]] == values
    for k in of.__dict__:
        other = resume.Fingerprint(**{**of.__dict__, k: "z"})
        assert resume.read_checkpoint(ck, other) is None
    good = json.load(open(ck))
    for change in ({"next_start": "44"}, {"next_start": 44.0}, {"tokens": "nope"}, {"tokens": [{"id": 1, "text": "a", "start": 0, "duration": 1}]}):
        json.dump(good | change, open(ck, "w"))
        assert resume.read_checkpoint(ck, of) is None
    json.dump(good | {"tokens": [{"id": 1, "text": "a", "start": 0, "duration": 1, "confidence": 1}]}, open(ck, "w"))
    assert resume.read_checkpoint(ck, of)[1] == [(1, "a", 0.0, 1.0, 1.0)]
    open(ck, "w").write("{")
    assert resume.read_checkpoint(ck, of) is None


def test_failed_run_says_so(tmp_path):
    p = tmp_path / "s.json"
    with pytest.raises(Stop), resume.Status(str(p)) as s:
        s.say("running")
        raise Stop("why")
    assert json.loads(p.read_text())["state"] == "failed"


def test_optional_stage():
    def down(_):
        raise resume.Unavailable("no tool")

    said = []
    assert resume.optional_stage(lambda: 1, down, warn=said.append) == 1 and said
    with pytest.raises(resume.Unavailable):
        resume.optional_stage(lambda: 1, down, required=True)
    with pytest.raises(Stop):
        resume.optional_stage(lambda: 1, lambda _: (_ for _ in ()).throw(Stop()))


def test_stream_decodes_each_chunk_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    chunk = spark.createDataFrame([("r", k, k * 10) for k in range(4)], "rec_id string, chunk_ix int, start long")
    chunk.write.json(src)
    run = lambda: resume.stream_chunks(spark, src, "rec_id string, chunk_ix int, start long", lambda d: d.select("rec_id", "chunk_ix"), out, ck).awaitTermination()
    run()
    chunk.withColumn("chunk_ix", F.col("chunk_ix") + 4).write.mode("append").json(src)
    run()
    run()
    assert sorted(r.chunk_ix for r in spark.read.parquet(out).select("chunk_ix").collect()) == list(range(8))


class Fake:
    def __init__(self, frames=(), short=0, audio=True, video=True):
        self.data, self.short, self.kinds = b"".join(bytes(f) for f in frames), short, (audio, video)

    def probe(self, path):
        s = []
        if self.kinds[0]:
            s.append({"codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2, "duration": "2.0"})
        if self.kinds[1]:
            s.append({"codec_type": "video", "duration": "4.0"})
        return {"streams": s, "format": {"duration": "4.0"}}

    def grid_bytes(self, path, fps, width, height):
        d = self.data + b"x" * self.short
        yield from (d[i : i + 3] for i in range(0, len(d), 3))

    def frame(self, path, t, width, exact):
        if not exact:
            raise media.MediaFailure("seek")
        return b"" if t > 4 else b"png"


def test_media_edge(spark, tmp_path):
    p = tmp_path / "v.mp4"
    p.write_bytes(b"")
    p = str(p)
    cuts = [[0] * 4] * 4 + [[100] * 4] * 4 + [[200] * 4] * 4
    paths = spark.createDataFrame([("r", p)], "rec_id string, path string")
    got = media.frames(paths, Fake(cuts), 1.0, 2, 2)
    assert got.count() == 12
    from tideline.operators.changes import change_scores_binary, select_marks

    assert [r.t for r in select_marks(change_scores_binary(got), 1.0, 9, 0.0).orderBy("t").collect()] == [4.0, 8.0]
    still = media.frames(paths, Fake([[7] * 4] * 6), 1.0, 2, 2)
    assert select_marks(change_scores_binary(still), 1.0, 9, 0.0).count() == 0
    assert media.probe(p, Fake()) == media.AudioStream("aac", 48000, 2, 2.0)
    for bad, kind in ((Fake(audio=False), media.NoAudio),):
        with pytest.raises(kind):
            media.probe(p, bad)
    with pytest.raises(media.NoVideo):
        list(media.grid(p, Fake(video=False), 1, 2, 2))
    with pytest.raises(media.MediaFailure):
        list(media.grid(p, Fake([[1] * 4], short=2), 1, 2, 2))
    assert list(media.grid(p, Fake(), 1, 2, 2)) == []
    with pytest.raises(ValueError):
        list(media.grid(p, Fake(), 0, 2, 2))
    with pytest.raises(FileNotFoundError):
        media.probe(p + "x", Fake())
    assert media.frame(p, 1.0, Fake()) == b"png"
    with pytest.raises(media.MediaFailure, match="beyond"):
        media.frame(p, 9.0, Fake())
    with pytest.raises(ValueError):
        media.frame(p, -1.0, Fake())
    part = got.where("frame_ix >= 2").withColumn("frame_ix", F.col("frame_ix") - 2)
    assert media.seek_differences(got, part, 2).first().different == 0
    assert media.seek_differences(got, part, 3).first().different > 0


def test_models():
    r = models.Registry()
    r.add(models.Engine("chunked", dict))
    with pytest.raises(ValueError):
        r.get("none")
    with pytest.raises(ValueError):
        r.get(language="ur")
    assert models.turns_of_segments([{"speaker": "S2", "start": 10, "end": 20}, {"speaker": "S1", "start": 0, "end": 10}]) == ([(0.0, 10.0, 0), (10.0, 20.0, 1)], ["S1", "S2"])
    for none in (None, []):
        with pytest.raises(resume.Unavailable):
            models.turns_of_segments(none)
    assert models.with_preset("roman", prompt="x")["prompt"] == "x"


def test_wav_and_cli(tmp_path, capsys):
    import io
    import wave

    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(np.array([1, -2, 3], "<i2").tobytes())
    assert media.samples_of_wav(b.getvalue()).tolist() == [1, -2, 3]
    assert cli.main(["frame", str(tmp_path / "no.mp4"), "1", "x.png"]) == 1
    assert cli.main(["nope"]) == 2 and cli.main(["help"]) == 0
