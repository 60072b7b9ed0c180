"""Files read in parts and only where asked; requests that share a decode; documents published whole or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tideline.sources import documents, media

W, H = 4, 3
LENGTH = {"a.mov": 50, "b.mov": 7, "c.mov": 0}


class Reel:
    """A decoder of made-up files; it notes in a folder what it is asked to read."""

    def __init__(self, notes, seeks=True, lie=0):
        self.notes, self.lie = notes, lie
        if not seeks:
            self.grid_range_bytes = None
            del self.grid_range_bytes

    def note(self, *what):
        with open(os.path.join(self.notes, "notes"), "a") as f:
            f.write(json.dumps(what) + "\n")

    def probe(self, path):
        n = LENGTH[os.path.basename(path)] + self.lie
        return {"streams": [{"codec_type": "video", "duration": str(float(n))}], "format": {}}

    def frames(self, path, first, end):
        name = os.path.basename(path)
        data = b"".join(bytes([(len(name) + k * 7 + j) % 256 for j in range(W * H)]) for k in range(first, min(end, LENGTH[name])))
        yield from (data[i : i + 5] for i in range(0, len(data), 5))

    def grid_bytes(self, path, fps, width, height):
        self.note("all", os.path.basename(path))
        yield from self.frames(path, 0, 10**9)


class SeekingReel(Reel):
    def grid_range_bytes(self, path, fps, width, height, first, n):
        self.note("part", os.path.basename(path), first, n)
        yield from self.frames(path, first, 10**9 if n is None else first + n)


def noted(folder):
    at = os.path.join(folder, "notes")
    if not os.path.exists(at):
        return []
    with open(at) as f:
        got = sorted(map(json.loads, f), key=repr)
    os.unlink(at)
    return got


@pytest.fixture
def reels(tmp_path):
    for name in LENGTH:
        (tmp_path / name).write_bytes(b"")
    return {name: str(tmp_path / name) for name in LENGTH}


def plain(reels, notes):
    reel = Reel(notes)
    out = [(path, i, bytes(t)) for path in reels.values() for i, t in media.grid_range(path, reel, 1.0, W, H)]
    noted(notes)
    return sorted(out)


@pytest.mark.parametrize("kind, lie", [(SeekingReel, 0), (SeekingReel, -9), (SeekingReel, 30), (Reel, 0)])
def test_parts_are_the_whole(spark, tmp_path, reels, kind, lie):
    notes = str(tmp_path)
    want = plain(reels, notes)
    paths = spark.createDataFrame([(p, p) for p in reels.values()], "rec_id string, path string")
    for split in (None, 8.0, 1.0, 1000.0):
        got = media.frames(paths, kind(notes, lie=lie), 1.0, W, H, split_s=split)
        assert sorted((r.rec_id, r.frame_ix, bytes(r.tiles)) for r in got.collect()) == want
    noted(notes)
    source = media.grid_source(lambda: kind(notes, lie=lie), f"reel{kind.__name__}{lie}".replace("-", "m"))
    spark.dataSource.register(source)
    df = spark.read.format(source.name()).option("paths", json.dumps(list(reels.values()))).option("width", W).option("height", H).option("split_s", 8).load()
    assert sorted((r.rec_id, r.frame_ix, bytes(r.tiles)) for r in df.collect()) == want
    if lie == 0:
        assert df.rdd.getNumPartitions() == 7 + 1 + 1  # 50 seconds, 7 and none by eights


def test_filters_reach_the_files(spark, tmp_path, reels):
    notes = str(tmp_path)
    load = lambda: media.read_grids(spark, list(reels.values()), lambda: SeekingReel(notes), 1.0, W, H, split_s=8.0)
    a = reels["a.mov"]
    want = plain(reels, notes)
    few = load().where((F.col("rec_id") == a) & (F.col("frame_ix") >= 20) & (F.col("frame_ix") < 30))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter" not in plan.replace("RuntimeFilters", "")  # nothing is left to Spark
    assert sorted((r.rec_id, r.frame_ix, bytes(r.tiles)) for r in few.collect()) == [x for x in want if x[0] == a and 20 <= x[1] < 30]
    assert noted(notes) == [["part", "a.mov", 20, 4], ["part", "a.mov", 24, 6]]
    one = load().where((F.col("frame_ix") == 3) & F.col("rec_id").isin(a, reels["b.mov"]))
    assert sorted((r.rec_id, r.frame_ix) for r in one.collect()) == [(a, 3), (reels["b.mov"], 3)]
    assert noted(notes) == [["part", "a.mov", 3, 1], ["part", "b.mov", 3, 1]]
    some = load().where(F.col("frame_ix").isin(2, 9) & (F.col("frame_ix") > 1) & (F.col("frame_ix") <= 40) & (F.length("rec_id") > 0))
    assert sorted((r.rec_id, r.frame_ix) for r in some.collect()) == [(a, 2), (a, 9), (reels["b.mov"], 2)]
    noted(notes)
    assert load().where(F.col("rec_id") == "none").count() == 0 and load().where("frame_ix < 0").count() == 0
    assert noted(notes) == []


def test_long_files_are_read_by_many_tasks(spark, tmp_path, reels):
    notes = str(tmp_path)
    paths = spark.createDataFrame([(1, reels["a.mov"])], "rec_id long, path string")
    media.frames(paths, SeekingReel(notes), 1.0, W, H, split_s=10.0).count()
    assert [x[2] for x in noted(notes) if x[0] == "part"] == [0, 10, 20, 30, 40]


def test_seeks_are_compared_with_a_whole_scan(spark, tmp_path, reels):
    class Off(SeekingReel):
        def grid_range_bytes(self, path, fps, width, height, first, n):
            yield from self.frames(path, first + 1, 10**9 if n is None else first + n + 1)

    paths = spark.createDataFrame([(p, p) for n, p in reels.items() if n != "c.mov"], "rec_id string, path string")
    good = {os.path.basename(r.rec_id): (r.frames, r.different) for r in media.seek_report(paths, SeekingReel(str(tmp_path)), 1.0, W, H).collect()}
    assert good == {"a.mov": (25, 0), "b.mov": (4, 0)}
    bad = {os.path.basename(r.rec_id): (r.frames, r.different) for r in media.seek_report(paths, Off(str(tmp_path)), 1.0, W, H).collect()}
    assert bad == {"a.mov": (24, 24), "b.mov": (3, 3)}


class Album(Reel):
    def __init__(self, notes, together=True, short=False):
        super().__init__(notes)
        self.short = short
        if not together:
            self.pictures = None

    def frame(self, path, t, width, exact):
        self.note("one", os.path.basename(path), t)
        if t > LENGTH[os.path.basename(path)]:
            raise media.MediaFailure("no picture")
        return f"{os.path.basename(path)} {t} {width}".encode()

    def pictures(self, path, times, width):
        self.note("many", os.path.basename(path), times)
        return [f"{os.path.basename(path)} {t} {width}".encode() for t in times if t <= LENGTH[os.path.basename(path)]][: -1 if self.short else None]


def test_near_requests_share_a_decode(spark, tmp_path, reels):
    notes = str(tmp_path)
    asked = [(k, reels["a.mov"], t) for k, t in enumerate([1.0, 3.0, 3.0, 18.0, 45.0, 99.0, -1.0])] + [(9, reels["b.mov"], 2.0), (10, str(tmp_path / "none"), 1.0)]
    df = spark.createDataFrame(asked, "rec_id int, path string, t double").repartition(4)
    got = {(r.rec_id, r.t): (r.picture and bytes(r.picture).decode(), r.error and r.error.split(":")[0]) for r in media.frames_at(df, Album(notes), 7).collect()}
    want = {(k, t): (f"a.mov {t} 7", None) for k, _, t in asked[:5]} | {(5, 99.0): (None, "MediaFailure"), (6, -1.0): (None, "ValueError"), (9, 2.0): ("b.mov 2.0 7", None), (10, 1.0): (None, "FileNotFoundError")}
    assert got == want
    told = noted(notes)
    assert ["many", "a.mov", [1.0, 3.0, 18.0]] in told and ["one", "a.mov", 1.0] not in told
    short = {r.rec_id: bytes(r.picture).decode() for r in media.frames_at(df.where("rec_id < 5"), Album(notes, short=True), 7).collect()}
    assert short == {k: f"a.mov {t} 7" for k, _, t in asked[:5]}  # asked for one by one then


def read(folder):
    return {n: open(os.path.join(folder, n)).read() for n in sorted(os.listdir(folder)) if n.endswith(".json")}


def test_documents_are_published_whole(spark, tmp_path):
    at = str(tmp_path / "out")
    base = spark.createDataFrame([(f"r{k}", json.dumps({"k": k, "text": "é"})) for k in range(20)], "rec_id string, document string").repartition(4)
    documents.write_documents(base, at)
    assert read(at) == {f"r{k}.json": json.dumps({"k": k, "text": "é"}) for k in range(20)}
    some = base.where("rec_id in ('r1', 'r2')").withColumn("document", F.lit("new"))
    documents.write_documents(some, at)
    assert {n for n, x in read(at).items() if x == "new"} == {"r1.json", "r2.json"} and len(os.listdir(at)) == 20
    assert spark.read.text(at, wholetext=True).count() == 20


@pytest.mark.parametrize("bad", ["fails", "twice", "twice apart", "null", "path"])
def test_a_failed_write_changes_nothing(spark, tmp_path, bad):
    at = str(tmp_path / "out")
    old = spark.createDataFrame([(f"r{k}", "old") for k in range(5)], "rec_id string, document string")
    documents.write_documents(old, at)
    new = old.withColumn("document", F.lit("new")).repartition(3)
    if bad == "fails":
        new = new.withColumn("document", F.when(F.col("rec_id") == "r3", F.raise_error(F.lit("no"))).otherwise(F.col("document")))
    elif bad == "twice":
        new = new.unionByName(new).coalesce(1)
    elif bad == "twice apart":
        new = new.unionByName(new)
    else:
        new = new.unionByName(spark.createDataFrame([(None if bad == "null" else "../x", "new")], "rec_id string, document string"))
    with pytest.raises(Exception):  # noqa: B017
        documents.write_documents(new, at)
    assert set(read(at).values()) == {"old"} and os.listdir(at) == sorted(os.listdir(at), key=lambda n: n) or set(read(at).values()) == {"old"}
    documents.clear_staged(spark, at)
    assert sorted(os.listdir(at)) == [f"r{k}.json" for k in range(5)]


def test_labels_come_in_a_second_commit(spark, tmp_path):
    at = str(tmp_path / "out")
    base = spark.createDataFrame([(f"r{k}", "base") for k in range(3)], "rec_id string, document string")
    documents.write_documents_twice(base, lambda d: d.where("rec_id <> 'r0'").withColumn("document", F.lit("labelled")), at)
    assert read(at) == {"r0.json": "base", "r1.json": "labelled", "r2.json": "labelled"}
    other = str(tmp_path / "other")
    with pytest.raises(Exception):  # noqa: B017
        documents.write_documents_twice(base, lambda d: d.withColumn("document", F.raise_error(F.lit("no model"))), other)
    assert set(read(other).values()) == {"base"}


def test_what_a_killed_write_staged(spark, tmp_path):
    at = str(tmp_path / "out")
    writer = documents.DocumentSink({"path": at}).writer(None, False)
    writer.write(iter([__import__("pyspark").sql.Row(rec_id="a", document="x")]))  # and then the driver is gone
    assert read(at) == {} and documents.clear_staged(spark, at) == 1 and os.listdir(at) == []
    assert documents.clear_staged(spark, str(tmp_path / "none")) == 0
