"""Checkpoints judged as a table agree with the reader of one file, case by case; totals count every recording."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tideline.operators import changepoints, recall
from tideline.streaming import checkpoints, resume

FP = "schema int, media string, media_size long, media_mtime_ns long, total_samples long, model_id string, engine_version string, chunk_s double, overlap_s double"
OF = resume.Fingerprint(1, "/a/b c.mov", 123456789012, 1700000000123456789, 70_000_000, "m/é", "1.2", 120.0, 15.5)
TOKEN = {"id": 1, "text": "a", "start": 0, "duration": 1, "confidence": 1}
GOOD = {"fingerprint": OF.__dict__, "next_start": 44, "tokens": [{"id": 1, "text": "a", "start": 0.30000000000000004, "duration": 0.5, "confidence": 1.0}, TOKEN]}

CASES = {
    "good": json.dumps(GOOD),
    "no tokens": json.dumps(GOOD | {"tokens": []}),
    "more keys": json.dumps(GOOD | {"more": 1}),
    "cut": json.dumps(GOOD)[:-5],
    "empty": "",
    "none": None,
    "list": "[1]",
    "null": "null",
    "nothing": "{}",
    **{f"other {k}": json.dumps(GOOD | {"fingerprint": OF.__dict__ | {k: "z"}}) for k in OF.__dict__},
    **{f"no {k}": json.dumps(GOOD | {"fingerprint": {j: v for j, v in OF.__dict__.items() if j != k}}) for k in OF.__dict__},
    "more in it": json.dumps(GOOD | {"fingerprint": OF.__dict__ | {"z": 1}}),
    "whole seconds": json.dumps(GOOD | {"fingerprint": OF.__dict__ | {"chunk_s": 120}}),
    "one nanosecond": json.dumps(GOOD | {"fingerprint": OF.__dict__ | {"media_mtime_ns": 1700000000123456788}}),
    "text number": json.dumps(GOOD | {"fingerprint": OF.__dict__ | {"media_size": "123456789012"}}),
    "null in it": json.dumps(GOOD | {"fingerprint": OF.__dict__ | {"media": None}}),
    "no object": json.dumps(GOOD | {"fingerprint": 3}),
    **{f"next {v!r}": json.dumps(GOOD | {"next_start": v}) for v in ("44", 44.0, 44.5, None, [44], {"a": 1}, -3, 0)},
    "no next": json.dumps({k: v for k, v in GOOD.items() if k != "next_start"}),
    **{f"tokens {v!r}": json.dumps(GOOD | {"tokens": v}) for v in ("nope", None, {"a": 1}, [1], [None], [[TOKEN]], ["x"])},
    **{f"token without {k}": json.dumps(GOOD | {"tokens": [TOKEN, {j: v for j, v in TOKEN.items() if j != k}]}) for k in TOKEN},
    **{f"token {k} {v!r}": json.dumps(GOOD | {"tokens": [TOKEN | {k: v}]}) for k, v in (("id", 1.5), ("id", "1"), ("id", None), ("text", 3), ("text", None), ("start", "0"), ("duration", None), ("confidence", True), ("start", 1e-10), ("start", -2))},
}


def test_every_case_as_the_file_reader_judges_it(spark, tmp_path):
    rows = [(name, doc, tuple(OF.__dict__.values())) for name, doc in CASES.items()]
    df = spark.createDataFrame(rows, f"rec_id string, document string, fingerprint struct<{', '.join(x.replace(' ', ':') for x in FP.split(', '))}>")
    got = {r.rec_id: r for r in checkpoints.judged(df).collect()}
    ok = 0
    for name, doc in CASES.items():
        path = tmp_path / "ck"
        path.unlink(missing_ok=True)
        if doc is not None:
            path.write_text(doc)
        one = resume.read_checkpoint(str(path), OF)
        r = got[name]
        assert (one is None) == (r.void is not None), (name, r.void)
        if one is not None:
            ok += 1
            assert (r.next_start, [tuple(t) for t in r.tokens]) == one, name
    assert ok >= 8 and {r.void for r in got.values()} == {None, "json", "fingerprint", "next_start", "tokens"}


def test_recordings_go_on_or_begin(spark):
    recs = spark.createDataFrame([(k, ("m",)) for k in ("a", "b", "c")], "rec_id string, fingerprint struct<model:string>")
    of = {"fingerprint": {"model": "m"}, "next_start": 9, "tokens": [TOKEN]}
    docs = spark.createDataFrame([("a", json.dumps(of)), ("b", json.dumps(of | {"fingerprint": {"model": "n"}}))], "rec_id string, document string")
    got = {r.rec_id: (r.next_start, len(r.tokens)) for r in checkpoints.going_on(recs, docs).collect()}
    assert got == {"a": (9, 1), "b": (0, 0), "c": (0, 0)}


def test_totals_count_recordings_without_a_change(spark):
    rows = [("a", 0.0, 1), ("a", 3600.0, 2), ("b", 0.0, 5), ("b", 3600.0, 5), ("c", None, 1)]
    df = spark.createDataFrame(rows, "rec_id string, time double, slide int")
    got = {r.kind: (r.recordings, r.changes, r.hours) for r in changepoints.corpus_totals(df).collect()}
    assert got == {"all": (2, 1, 2.0), "slide_flip": (1, 1, 1.0)}
    none = {r.kind: (r.recordings, r.changes, r.hours) for r in changepoints.corpus_totals(df.where("rec_id = 'b'")).collect()}
    assert none == {"all": (1, 0, 1.0)}


@pytest.mark.parametrize("few", [20_000, 0])
def test_short_items_in_long_texts(spark, monkeypatch, few):
    monkeypatch.setattr(recall, "FEW_ITEMS", few)
    text = "xyz " * 25_000 + "qq 🎈e"
    t = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    i = spark.createDataFrame([(k, x) for k, x in enumerate(["qq", "z x", "🎈", "ab", "z qq 🎈e", "E"])], "item_id long, text string")
    began = time.perf_counter()
    got = sorted(r.item_id for r in recall.found_items(t, i).collect())
    assert got == [0, 1, 2, 4, 5] and time.perf_counter() - began < 20
    assert recall.found_items(t, i.where(F.lit(False))).count() == 0
