"""Exact values for the timeline operators, with controls that must give nothing."""

import random
import signal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import changepoints, changes, chunks, detectors, document, evaluate, recall, sentences, speakers

TURN = "rec_id string, start double, end double, speaker int"


def marks(spark, scores, fps, budget, gap):
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(scores)], "rec_id string, i int, score int")
    return [(r.t, r.score, r.look) for r in changes.select_marks(df, fps, budget, gap).orderBy("t").collect()]


@pytest.mark.parametrize(
    "scores, fps, budget, gap, want",
    [
        ([1, 9, 2, 8, 3], 1, 2, 0, [9, 8]),
        ([100, 99, 0, 0, 0, 0, 50], 1, 3, 5, [100, 50]),
        ([100, 99, 0, 0, 0, 0, 50], 1, 3, 0, [100, 99, 50]),
        ([100, 0, 0, 0, 0, 90], 1, 2, 5.0, [100, 90]),
        ([100, 0, 0, 0, 0, 90], 1, 2, 5.001, [100]),
        ([100, 0, 0, 0, 90], 2, 2, 3.0, [100]),
        ([100, 0, 0, 0, 90], 2, 2, 1.5, [100, 90]),
        ([7, 0, 0, 0, 0], 1, 4, 0, [7]),
        ([0, 0, 0], 1, 4, 0, []),
        ([5, 5], 1, 0, 0, []),
        ([9] + [0] * 48 + [8], 49, 2, 1.0, [9]),
    ],
)
def test_marks_keep_their_distance(spark, scores, fps, budget, gap, want):
    assert [s for _, s, _ in marks(spark, scores, fps, budget, gap)] == want


def test_marks_look_midway(spark):
    assert marks(spark, [90, 0, 0, 0, 0, 80, 0, 0, 0, 0], 1, 2, 0) == [(1.0, 90, 3.5), (6.0, 80, 8.0)]
    assert marks(spark, [50] + [0] * 19, 1, 1, 0) == [(1.0, 50, 10.5)]
    assert marks(spark, [0, 42], 2, 1, 0) == [(1.0, 42, 1.0)]
    assert marks(spark, [0] * 5 + [3] * 300, 1, 1, 0) == [(6.0, 3, 155.5)]


def test_budget_by_recording(spark):
    rows = [(r, i, s, b) for r, b in (("a", 1), ("b", 3)) for i, s in enumerate([4, 9, 7])]
    df = spark.createDataFrame(rows, "rec_id string, i int, score int, b int")
    assert {r.rec_id: r.n for r in changes.select_marks(df, 1.0, F.col("b"), 0.0).groupBy("rec_id").agg(F.count("*").alias("n")).collect()} == {"a": 1, "b": 3}


def test_guards():
    for kw in ({"fps": 0}, {"fps": -1}, {"budget": -1}, {"min_gap_s": -1}, {"delta": -1}):
        with pytest.raises(ValueError):
            changes.guard(**kw)


@pytest.mark.parametrize("a, b, want", [([10] * 4, [10] * 4, 0), ([0] * 4, [100, 100, 100, 0], 3), ([0], [8], 0), ([0], [9], 1), ([248], [0], 1), ([10], [250], 1)])
def test_change_scores(spark, a, b, want):
    ints = spark.createDataFrame([("r", 0, a), ("r", 1, b)], "rec_id string, frame_ix int, tiles array<int>")
    raw = spark.createDataFrame([("r", 0, bytearray(a)), ("r", 1, bytearray(b))], "rec_id string, frame_ix int, tiles binary")
    assert [r.score for r in changes.change_scores(ints).collect()] == [want]
    assert [r.score for r in changes.change_scores_binary(raw).collect()] == [want]
    assert changes.change_scores(ints.where("frame_ix = 0")).count() == 0


CASES = [
    ([(0, 10, 0), (10, 20, 1)], [1, 2, 3, 11, 12], 0), ([(0, 10, 0), (10, 100, 1)], [1, 2, 3, 4], 0), ([(0, 30, 0), (50, 80, 1)], [29, 40, 51, 52], 1), ([(0, 10, 0), (50, 60, 1)], [20, 21], 0),
    ([(0, 10, 0), (50, 60, 1)], [45, 46], 1), ([(0, 10, 1), (10, 20, 0)], [1, 2, 11, 12], 1), ([(0, 5, 2), (5, 15, 1), (15, 25, 0)], [1, 6, 7, 16, 17], 1), ([(10, 20, 0), (20, 30, 1)], [5, 11, 12], 0),
    ([(0, 57.809375, 0), (57.809375, 73.796875, 1), (74.404375, 301.906875, 0)], [57.12, 57.52, 57.68, 57.76, 57.84, 58.0, 58.16], 0),
]


def test_votes(spark):
    turns = spark.createDataFrame([(f"r{k}", float(s), float(e), p) for k, (ts, _, _) in enumerate(CASES) for s, e, p in ts], TURN)
    tokens = spark.createDataFrame([(f"r{k}", 0, i, float(t)) for k, (_, xs, _) in enumerate(CASES) for i, t in enumerate(xs)], "rec_id string, sent_ix int, pos int, t double")
    got = {r.rec_id: r.speaker for r in speakers.label_sentences(tokens, turns).collect()}
    assert got == {f"r{k}": w for k, (_, _, w) in enumerate(CASES)}


def naive_at(turns, t):
    before = [x for x in sorted(turns) if x[0] <= t]
    return before[-1][2] if before and t <= before[-1][1] else None


def naive_near(turns, t):
    s = sorted(turns)
    k = len([x for x in s if x[0] <= t])
    return min(s[max(0, k - 1) : k + 1] if k else s[:1], key=lambda x: max(x[0] - t, t - x[1], 0))[2]


def test_lookup_against_a_scan(spark):
    rng = random.Random(5)
    turns = [(float(rng.randint(0, 40)), 0.0, rng.randint(0, 3)) for _ in range(30)]
    turns = [(s, s + rng.choice([0.5, 3, 20]), p) for s, _, p in turns]  # overlaps and equal starts
    points = [rng.choice([rng.uniform(-3, 70), float(rng.randint(0, 60))]) for _ in range(300)]
    t = spark.createDataFrame([("a", *x) for x in turns] + [("b", 0.0, 1.0, 9)], TURN)
    p = spark.createDataFrame([("a", i, x) for i, x in enumerate(points)], "rec_id string, i int, t double")
    at = {r.i: r.speaker for r in speakers.speaker_at(p, t).collect()}
    near = {r.i: r.nearest for r in speakers.nearest_speaker(p, t).collect()}
    assert at == {i: naive_at(turns, x) for i, x in enumerate(points)}
    assert near == {i: naive_near(turns, x) for i, x in enumerate(points)}
    assert None in at.values() and len(set(at.values())) > 2


def test_empty_turns(spark):
    with pytest.raises(ValueError):
        speakers.require_turns(spark.createDataFrame([], TURN))


def test_chunk_geometry(spark):
    df = spark.createDataFrame([("a", 360 * 16000), ("b", 45 * 16000), ("c", 0)], "rec_id string, total long")
    got = chunks.chunk_geometry(df).orderBy("rec_id", "chunk_ix").collect()
    assert [r.start for r in got if r.rec_id == "a"] == [0, 1_680_000, 3_360_000, 5_040_000]
    assert [(r.start, r.end, r.next_start) for r in got if r.rec_id == "b"] == [(0, 720_000, 720_000)]
    assert (got[1].end, got[3].end - got[3].start, len(got)) == (3_600_000, 45 * 16000, 5)


def test_sentence(spark):
    words = [("see", 0.0, 0.4), (" this", 0.5, 0.5), (" column", 1.1, 0.5), (" here.", 1.7, 748.3), (" More", 751.0, 1.0)]
    df = spark.createDataFrame([("r", i, w, s, d) for i, (w, s, d) in enumerate(words)], "rec_id string, pos int, text string, start double, duration double")
    a, b = sentences.sentences(df).orderBy("sent_ix").collect()
    assert (a.start, a.end, a.text, a.tokens[0].t, a.tokens[0].w) == (0.0, 750.0, "see this column here.", 0.0, "see")
    assert b.text == " More"


def test_segments_as_sentences(spark):
    df = spark.createDataFrame([([(0.0, 1.5, " a b ", [(" a", 0.0, 1.0)]), (1.5, 2.5, "c", None)],), (None,)], "s array<struct<start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double>>>>")
    got = [r.x for r in df.select(sentences.sentences_of_segments(F.col("s")).alias("x")).collect()]
    assert got[1] == [] and got[0][0].text == "a b" and got[0][0].tokens[0].w == " a" and got[0][1].tokens == []


def test_change_points(spark):
    df = spark.createDataFrame([("r", float(t), s) for t, s in enumerate([1, 1, 2, -1, 2, None, 3])], "rec_id string, time double, slide int")
    got = [(r.time, r.lower_bound, r.from_slide, r.to_slide, r.kind) for r in changepoints.change_points(df).orderBy("time").collect()]
    assert got == [(2.0, 1.0, 1, 2, "slide_flip"), (3.0, 2.0, 2, -1, "view_cut"), (4.0, 3.0, -1, 2, "view_cut"), (6.0, 4.0, 2, 3, "slide_flip")]


def test_interval_distance(spark):
    m = spark.createDataFrame([("r", 2.0), ("r", 9.0)], "rec_id string, t double")
    i = spark.createDataFrame([("r", 1.0, 3.0), ("r", 4.0, 5.0), ("r", 0.0, 1.0), ("r", 11.0, 12.0), ("x", 0.0, 1.0)], "rec_id string, lo double, hi double")
    got = {(r.lo, r.hi): r.distance for r in evaluate.interval_distance(m, i).collect()}
    assert got == {(1.0, 3.0): 0.0, (4.0, 5.0): 2.0, (0.0, 1.0): 1.0, (11.0, 12.0): 2.0}


def test_sign_tail():
    assert evaluate.sign_tail(10, 10) == 1 / 1024 and evaluate.sign_tail(0, 0) == 1.0 and evaluate.sign_tail(4, 0) == 1.0


def test_sign_tail_of_large_tables():
    """Adding whole numbers does not end in a minute at 400,000 tosses; a running sum of them gives the chances that must come out."""
    stop = lambda *_: pytest.fail("still at work after 60 s")
    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(60)
    try:
        for n in (1_001, 5_002):
            ways, chance, total = 1, {}, 0
            for k in range(n, -1, -1):
                total += ways
                chance[k] = total / 2**n
                ways = ways * k // (n - k + 1)
            for w in (0, 1, n // 2 - 40, n // 2, n // 2 + 1, n // 2 + 40, n // 2 + 200, n // 2 + 400, n):
                assert evaluate.sign_tail(n, w) == pytest.approx(chance[w], rel=1e-12, abs=1e-300)
        assert evaluate.sign_tail(400_000, 304_000) == 0.0 and evaluate.sign_tail(400_000, 90_000) == 1.0
        assert evaluate.sign_tail(400_001, 200_001) == pytest.approx(0.5, abs=1e-12)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_largest_component():
    assert detectors.largest_region(np.array([[1, 0, 1], [1, 1, 0], [0, 0, 1]])) == 3
    assert detectors.largest_region(np.zeros((2, 2))) == 0


def test_recall_finds_parts_of_words(spark):
    t = spark.createDataFrame([(1, "x| The  quick *brown* foxes jumped over"), (2, "nothing"), (3, None)], "doc_id long, text string")
    i = spark.createDataFrame([(1, "he quick brown foxes jum"), (2, "brown fox"), (3, "quick red")], "item_id long, text string")
    assert sorted((r.item_id, r.doc_id) for r in recall.found_items(t, i).collect()) == [(1, 1), (2, 1)]
    assert [r.item_id for r in recall.missed_items(t, i).collect()] == [3]


def test_markdown_items(spark):
    rows = ["1. `early`", "# A", "1. see `x` and `y`", "text `no`", "## B", "2. `z`"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(rows)], "doc string, line_ix int, line string")
    assert [(r.heading, r["item"]) for r in recall.items_of_markdown(df).orderBy("line_ix").collect()] == [("A", "x"), ("B", "z")]


def test_document_adds_and_never_changes(spark, tmp_path):
    s = spark.createDataFrame([("r", 0, 0.0, 1.0, "hi", [(0.0, "hi")])], "rec_id string, sent_ix int, start double, end double, text string, tokens array<struct<t:double,w:string>>")
    media = spark.createDataFrame([("r", "a.wav", "m"), ("e", "b.wav", "m")], "rec_id string, audio string, model string")
    plain = {r.rec_id: r.document.asDict() for r in document.documents(s, media).collect()}
    assert list(plain["r"]) == ["audio", "model", "text", "sentences"] and plain["e"]["sentences"] == []
    labels = spark.createDataFrame([("r", 0, 1, "d 1")], "rec_id string, sent_ix int, speaker int, provenance string")
    full = document.documents(s, media, labels)
    d = full.where("rec_id = 'r'").first().document
    assert list(d.asDict()) == ["audio", "model", "speakers", "diarization", "text", "sentences"] and list(d.sentences[0].asDict()) == ["start", "end", "speaker", "text", "tokens"]
    m = spark.createDataFrame([("r", 0.0625, 5, 1.0)], "rec_id string, t double, score int, look double")
    meta = spark.createDataFrame([("r", (1.0, 8))], "rec_id string, marks_meta struct<fps:double,delta:int>")
    out = document.with_marks(full, m, meta).where("rec_id = 'r'").first().document
    assert out.marks[0].t == 0.062 and out.marks_meta.delta == 8
    path = tmp_path / "x.json"
    document.write_text(str(path), "[1]")
    with pytest.raises(document.NotADocument):
        document.read_document(str(path))
    assert path.read_text() == "[1]" and len(list(tmp_path.iterdir())) == 1


def test_recall_of_many_items_goes_by_a_join(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abé"), 2))
    texts = [(k, " ".join(word() for _ in range(30))) for k in range(40)]
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 6, 7] * 4)] + [(90, texts[5][1][7:40]), (91, ""), (92, "a"), (93, texts[7][1])]
    want = sorted((i, d) for i, x in items for d, t in texts if x.strip() and x.strip() in t)
    t, i = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for few in (20_000, 0):
        monkeypatch.setattr(recall, "FEW_ITEMS", few)
        assert sorted((r.item_id, r.doc_id) for r in recall.found_items(t, i).collect()) == want and len(want) > 20
