"""Kernels over pairs of frames: any order and batch of frames, whole grids, regions, sweeps, chosen pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import changes, detectors, evaluate, pairs


def movie(seed, n, tiles, change=0.1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 256, (n, tiles), dtype=np.uint8)
    for k in range(1, n):
        same = rng.random(tiles) > change
        x[k, same] = x[k - 1, same]
    return x


def frames(spark, movies, binary=True):
    rows = [(r, k, bytearray(f) if binary else [int(v) for v in f]) for r, x in movies.items() for k, f in enumerate(x)]
    return spark.createDataFrame(rows, f"rec_id string, frame_ix int, tiles {'binary' if binary else 'array<int>'}")


@pytest.fixture
def batches_of(spark):
    def of(n):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)

    yield of
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("batch", [1, 3, 1000])
@pytest.mark.parametrize("order", ["in order", "shuffled", "dealt"])
def test_binary_scores_in_any_order(spark, batches_of, batch, order):
    batches_of(batch)
    movies = {"a": movie(1, 40, 60), "b": movie(2, 1, 60), "c": movie(3, 25, 33)}
    df = frames(spark, movies).coalesce(1)
    df = {"in order": df, "shuffled": df.orderBy(F.rand(3)), "dealt": df.repartition(7)}[order]
    got = sorted(map(tuple, changes.change_scores_binary(df, 16).collect()))
    want = [(r, k, int((np.abs(x[k + 1].astype(int) - x[k]) > 16).sum())) for r, x in movies.items() for k in range(len(x) - 1)]
    assert got == sorted(want)


def test_binary_scores_over_gaps_and_repeated_frames(spark):
    rows = [("a", k, bytearray([k, 0])) for k in (0, 1, 5, 6, 9)]
    df = spark.createDataFrame(rows, "rec_id string, frame_ix int, tiles binary")
    assert sorted(map(tuple, changes.change_scores_binary(df, 2).collect())) == [("a", 0, 0), ("a", 4, 1), ("a", 5, 0), ("a", 8, 1)]
    assert changes.change_scores_binary(df.unionByName(df), 2).count() >= 4  # no order among equal ones, no failure either
    assert changes.change_scores_binary(df.limit(0), 2).count() == 0
    odd = spark.createDataFrame([("a", 0, bytearray(4)), ("a", 1, bytearray(5))], "rec_id string, frame_ix int, tiles binary")
    with pytest.raises(Exception, match="differ in size"):
        changes.change_scores_binary(odd).collect()


def test_what_is_sent_on_is_little(spark):
    """Of 500 frames in order, those at the ends of batches; the scores take no tiles with them."""
    df = frames(spark, {"a": movie(1, 500, 64)}).coalesce(1)
    x = pairs.successive(df, lambda a, b: [pairs.pa.array(np.zeros(len(a), np.int32))], "x int")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange hashpartitioning") <= 2
    assert x.count() == 499


def flood(mask):
    """Cells of the largest region, by walking."""
    left, best = {tuple(map(int, p)) for p in zip(*np.nonzero(mask), strict=True)}, 0
    while left:
        todo, n = [left.pop()], 0
        while todo:
            y, x = todo.pop()
            n += 1
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        best = max(best, n)
    return best


def test_regions_equal_walking():
    rng = np.random.default_rng(0)
    for h, w, p in ((1, 1, 0.5), (1, 9, 0.6), (9, 1, 0.6), (8, 8, 0.5), (12, 7, 0.62), (30, 40, 0.55), (5, 5, 1.0), (5, 5, 0.0)):
        flags = rng.random((60, h, w)) < p
        assert detectors.largest_regions(flags).tolist() == [flood(f) for f in flags]
    spiral = np.zeros((41, 41), bool)
    y = x = 0
    dy, dx = 0, 1
    spiral[0, 0] = True
    for _ in range(2000):
        far = lambda a, b: 0 <= a < 41 and 0 <= b < 41
        ahead, beyond = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
        if not far(*ahead) or (far(*beyond) and spiral[beyond]):
            dy, dx = dx, -dy
            continue
        y, x = ahead
        spiral[y, x] = True
    assert detectors.largest_region(spiral) == flood(spiral)


def plain_activity(x, delta):
    return (np.abs(np.diff(x.astype(int), axis=0)) > delta).mean(axis=0)


@pytest.mark.parametrize("binary", [True, False])
def test_activity_masks_and_regions(spark, batches_of, binary):
    batches_of(7)
    movies = {"a": movie(1, 40, 96, 0.3), "b": movie(2, 1, 96), "c": movie(3, 25, 48, 0.5)}
    df = frames(spark, movies, binary).repartition(3)
    got = {(r.rec_id, r.tile_ix): r.activity for r in detectors.tile_activity(df, 16).collect()}
    want = {(r, k): round(float(v), 9) for r, x in movies.items() if len(x) > 1 for k, v in enumerate(plain_activity(x, 16))}
    assert got == want
    marks = {(r.rec_id, r.frame_ix): r["size"] for r in detectors.region_marks(df, 8, 16, 0.35, 1, 0.4, sizes=True).collect()}
    plain = {}
    for r, x in movies.items():
        if len(x) > 1:
            busy = plain_activity(x, 16) >= 0.35
            out = busy if busy.mean() <= 0.4 else np.zeros(len(busy), bool)
            for k in range(1, len(x)):
                flags = (np.abs(x[k].astype(int) - x[k - 1]) > 16) & ~out
                if n := flood(flags.reshape(-1, 8)):
                    plain[r, k] = n
    assert marks == plain
    masked = spark.createDataFrame([("a", [0, 1, 95]), ("c", [])], "rec_id string, tiles array<int>")
    sizes = {(r.rec_id, r.i): r["size"] for r in detectors.component_sizes(df, 8, 16, masked).collect()}
    for (r, k), n in sizes.items():
        flags = np.abs(movies[r][k + 1].astype(int) - movies[r][k]) > 16
        if r == "a":
            flags[[0, 1, 95]] = False
        assert n == flood(flags.reshape(-1, 8))
    assert len(sizes) == 39 + 24


def test_sweep_is_one_pass_over_frames(spark):
    movies = {"a": movie(1, 30, 96, 0.3), "b": movie(2, 1, 96), "c": movie(3, 25, 96, 0.5)}
    df = frames(spark, movies)
    args = ([8, 16, 40], [0.1, 0.3, 0.5], [1, 4])
    got = {(r.config_ix, r.rec_id): r.n_marks for r in detectors.sweep(df, *args, width=8, factors=(1, 2, 3)).collect()}
    assert len(got) == 54 * 3
    k = 0
    for f in (1, 2, 3):
        grid = df if f == 1 else detectors.coarsen(df, 8, f)
        for d in args[0]:
            for m in args[1]:
                if (f, d, m) in ((1, 8, 0.1), (2, 16, 0.3), (3, 40, 0.5), (2, 8, 0.5)):
                    x = detectors.region_marks(grid, 8 // f, d, m, 1, sizes=True).collect()
                    for s, least in enumerate(args[2]):
                        for r in movies:
                            assert got[k + s, r] == sum(1 for y in x if y.rec_id == r and y["size"] >= least)
                k += len(args[2])
    plan = detectors.sweep(df, *args, width=8, factors=(1, 2, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("settle") <= 2  # for the counts and for the regions, which share what it sends


def test_coarse_frames_by_themselves(spark):
    movies = {"a": movie(1, 5, 100)}
    for binary in (True, False):
        x = detectors.coarsen(frames(spark, movies, binary), 10, 3)
        assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
        got = {r.frame_ix: list(r.tiles) for r in x.collect()}
        for k, f in enumerate(movies["a"]):
            g = f.reshape(10, 10)[:9, :9].reshape(3, 3, 3, 3).sum(axis=(1, 3)) // 9
            assert got[k] == g.ravel().tolist()


@pytest.mark.parametrize("block", [1, 4, 256])
def test_chosen_pairs(spark, block):
    movies = {"a": movie(1, 20, 30), "b": movie(2, 9, 12)}
    rng = np.random.default_rng(5)
    wanted = [(r, int(a), int(b)) for r, n in (("a", 20), ("b", 9)) for a, b in rng.integers(0, n, (60, 2))] + [("a", 3, 99), ("zz", 0, 1)]
    p = spark.createDataFrame(wanted + wanted[:5], "rec_id string, a int, b int")
    x = pairs.chosen(frames(spark, movies), p, lambda a, b: [pairs.pa.array((a != b).sum(axis=1), pairs.pa.int32())], "n int", block)
    want = {(r, a, b): int((movies[r][a] != movies[r][b]).sum()) for r, a, b in wanted if r in movies and b < len(movies[r])}
    assert {(r.rec_id, r.a, r.b): r.n for r in x.collect()} == want and x.count() == len(want)


def test_screens_and_instability(spark):
    movies = {"a": movie(1, 20, 30)}
    df = frames(spark, movies, False)
    share = [float((np.abs(x.astype(int) - y) > 8).mean()) for x, y in zip(movies["a"][1:], movies["a"][:-1], strict=True)]
    got = {r.second: r.instability for r in evaluate.instability(df).collect()}
    assert got == {k: round((share[k - 1] + share[k]) / 2, 9) for k in range(1, 19)}
    p = spark.createDataFrame([("a", 2.0, 3.0, "x"), ("a", 2.0, 3.0, "y"), ("a", 99.0, 0.0, "z")], "rec_id string, a double, b double, note string")
    x = {r.note: r.same for r in evaluate.same_screen(df, p).collect()}
    last = 1 - float((np.abs(movies["a"][19].astype(int) - movies["a"][0]) > 8).mean())
    assert x == {"x": 1 - share[2], "y": 1 - share[2], "z": last}
