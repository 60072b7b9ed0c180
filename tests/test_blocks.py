"""Lookups and overlaps by blocks, spaced choice by peeling: against plain loops, whatever the blocks."""

import random

import numpy as np
import pytest

from tideline.operators import blocks, changes, evaluate, speakers

TURN = "rec_id string, start double, end double, speaker int"


def timeline(rng, n, span, longest):
    return sorted((round(rng.uniform(0, span), rng.choice([0, 2])), round(rng.uniform(0, longest) ** rng.choice([1, 3]) / longest ** rng.choice([0, 2]), 2)) for _ in range(n))


@pytest.mark.parametrize("block", [1.0, 7.0, 100.0, 1e9])
def test_around_equals_a_scan(spark, block):
    rng = random.Random(int(block))
    things = [(r, float(rng.randint(0, 60)), rng.randint(0, 3)) for r in ("a", "b") for _ in range(25)] + [("c", 5.0, 1)]
    points = [(r, k, rng.choice([float(rng.randint(-5, 70)), rng.uniform(-5, 70)])) for r in ("a", "b", "d") for k in range(60)] + [("a", 900, None)]
    got = blocks.around(spark.createDataFrame(points, "rec_id string, k int, t double"), spark.createDataFrame(things, "rec_id string, at double, v int"), "at", block)
    assert got.columns == ["rec_id", "k", "t", "prev", "next"]
    for r in got.collect():
        mine = sorted(x[1:] for x in things if x[0] == r.rec_id)
        before, after = [x for x in mine if r.t is not None and x[0] <= r.t], [x for x in mine if r.t is not None and x[0] > r.t]
        assert (r.prev and tuple(r.prev)) == (before[-1] if before else None) and (r.next and tuple(r.next)) == (after[0] if after else None)
    assert got.count() == len(points)


@pytest.mark.parametrize("block, longest", [(1.0, 3.0), (10.0, 3.0), (10.0, 200.0), (1e9, 50.0)])
def test_overlaps_equal_all_pairs(spark, block, longest):
    rng = random.Random(int(block + longest))
    turns = [(r, s, s + d, rng.randint(0, 4)) for r in ("a", "b") for s, d in timeline(rng, 40, 300, longest)] + [("e", 0.0, 1e6, 7)]
    sentences = [(r, k, s, s + d) for r in ("a", "b", "c", "e") for k, (s, d) in enumerate(timeline(rng, 60, 300, longest))]
    found = blocks.best_overlap(spark.createDataFrame(sentences, "rec_id string, sent_ix int, start double, end double").repartition(3), spark.createDataFrame(turns, TURN), "sent_ix", "speaker", block)
    got = {(r.rec_id, r.sent_ix): r.speaker for r in found.collect()}
    want = {}
    for r, k, s, e in sentences:
        some = [(-(min(e, te) - max(s, ts)), ts, te, v) for q, ts, te, v in turns if q == r and s < e and ts < te and ts < e and s < te]
        if some:
            want[r, k] = min(some)[3]
    assert got == want and len(want) > 50


def test_a_long_turn_goes_only_where_sentences_are(spark):
    """A turn of 30 years, and a sentence at its end: two blocks are worked on, not a quarter of a million."""
    turns = spark.createDataFrame([("a", 0.0, 1e9, 1)], TURN)
    sentences = spark.createDataFrame([("a", 0, 1e9 - 20, 1e9 - 10)], "rec_id string, sent_ix int, start double, end double")
    assert [tuple(r) for r in speakers.overlap_labels(sentences, turns).collect()] == [("a", 0, 1)]


def test_lookups_do_not_hang_on_blocks(spark):
    rng = random.Random(2)
    marks = [("a", float(rng.randint(0, 500))) for _ in range(30)]
    targets = [("a", float(k)) for k in range(0, 520, 7)]
    m, t = (spark.createDataFrame(x, "rec_id string, t double") for x in (marks, targets))
    want = sorted((t_, min(abs(t_ - x) for _, x in marks)) for _, t_ in targets)
    for block in (5.0, 1e6):
        assert sorted((r.t, r.distance) for r in evaluate.nearest_distance(m, t, block).collect()) == want
    plan = evaluate.nearest_distance(m, t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def greedy(scores, fps, budget, gap):
    taken = []
    for s, i in sorted((-s, i) for i, s in enumerate(scores) if s > 0):
        if len(taken) < budget and all(abs(i - j) * (1.0 / fps) >= gap for j in taken):
            taken.append(i)
    return sorted(taken)


SHAPES = {
    "noise": lambda rng, n: [rng.choice([0, 0, 0, rng.randint(1, 50)]) for _ in range(n)],
    "ties": lambda rng, n: [rng.choice([0, 3]) for _ in range(n)],
    "flat": lambda rng, n: [5] * n,
    "rising": lambda rng, n: list(range(1, n + 1)),
    "falling": lambda rng, n: list(range(n, 0, -1)),
    "hills": lambda rng, n: [1 + abs((k * 7) % 400 - 200) for k in range(n)],
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("fps, gap, steps", [(1.0, 3.0, 40), (1.0, 3.0, 4096), (4.0, 2.5, 200), (1.0, 0.0, 64), (3.0, 1.0, 100)])
def test_peeling_equals_the_sequential_choice(spark, shape, fps, gap, steps):
    rng = random.Random(len(shape))
    recordings = {f"r{k}": SHAPES[shape](rng, n) for k, n in enumerate((1, 7, 500, 3000))}
    df = spark.createDataFrame([(r, i, s) for r, x in recordings.items() for i, s in enumerate(x)], "rec_id string, i int, score int").repartition(3)
    for budget in (25, 10**6):
        got = {}
        for r in changes.select_marks(df, fps, budget, gap, steps).collect():
            got.setdefault(r.rec_id, []).append(round(r.t * fps) - 1)
        assert {k: sorted(v) for k, v in got.items()} == {k: greedy(v, fps, budget, gap) if budget < 10**6 or len(v) < 1000 else plain(v, fps, gap) for k, v in recordings.items() if any(v)}


def plain(scores, fps, gap):
    """greedy without a budget, in linear time."""
    reach = max((d for d in range(200) if d * (1.0 / fps) < gap), default=0)
    near, taken = np.zeros(len(scores), bool), []
    for s, i in sorted((-s, i) for i, s in enumerate(scores) if s > 0):
        if not near[i]:
            taken.append(i)
            near[max(0, i - reach) : i + reach + 1] = True
    return sorted(taken)


def test_little_of_a_recording_comes_together(spark):
    """Blocks are groups; what they leave of a recording is their budget, what is near borders and what is open."""
    rng = random.Random(1)
    df = spark.createDataFrame([("r", i, rng.randint(1, 1000)) for i in range(20_000)], "rec_id string, i int, score int")
    done = changes._peeled(df, 1000, changes._reach(1.0, 5.0), 10, "string")
    states = {r.state: r["count"] for r in done.groupBy("state").count().collect()}
    assert states[1] == 200 and states.get(0, 0) < 40 and states.get(2, 0) < 80
    plan = changes.select_marks(df, 1.0, 40, 5.0)._jdf.queryExecution().analyzed().toString()
    assert "collect_list" not in plan


def test_distances_are_steps_times_the_inverse_rate():
    for fps in (1.0, 2.0, 3.0, 7.0, 29.97, 49.0):
        for gap in (0.0, 0.1, 1.0, 2.0, 5.0, 5.001, 1 / 3):
            want = max((d for d in range(2000) if d * (1.0 / fps) < gap), default=0)
            assert changes._reach(fps, gap) == want
