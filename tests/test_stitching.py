"""Stitching by seams and by state against the fold: random overlaps, chunks out of order, again, and after a stop."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import stitch
from tideline.streaming import stateful

TOKEN = "id int, text string, start double, duration double, confidence double"
CHUNK = f"rec_id string, chunk_ix int, n_chunks int, tokens array<struct<{TOKEN}>>"
COLUMNS = ["id", "text", "start", "duration", "confidence"]


def recording(rng, chunks, length=12.0, stride=8.0, noise=0.1, mess=0.0):
    """Lists of tokens of overlapping chunks of one recording: tokens misheard, moved, left out, chunks empty or out of order."""
    words = [(rng.randrange(40), round(0.5 * k + rng.random() * 0.2, 3)) for k in range(int(stride * chunks * 2) + 10)]
    out = []
    for c in range(chunks):
        lo, hi = c * stride, c * stride + length
        some = [(i if rng.random() > noise else rng.randrange(40), f" w{i}", round(t + rng.uniform(-0.2, 0.2), 3), 0.3, 1.0) for i, t in words if lo <= t < hi and rng.random() > noise / 2]
        if rng.random() < mess:
            some = rng.choice([[], some[:1], some[-2:], rng.sample(some, len(some)), [(i, x, round(t - 15.0, 3), d, p) for i, x, t, d, p in some]])
        out.append(some)
    return out


def rows(recordings):
    return [(r, c, p, *t) for r, chunks in recordings.items() for c, tokens in enumerate(chunks) for p, t in enumerate(tokens)]


def want(recordings, overlap=4.0):
    return sorted((r, k, *t) for r, chunks in recordings.items() for k, t in enumerate(stitch.stitch_lists(chunks, overlap)))


@pytest.mark.parametrize("noise, mess", [(0.0, 0.0), (0.1, 0.0), (0.6, 0.0), (0.1, 0.3), (1.0, 0.1)])
def test_seams_equal_the_fold(spark, noise, mess):
    rng = random.Random(int(noise * 10 + mess * 100))
    recordings = {f"r{k}": recording(rng, rng.randint(1, 12), noise=noise, mess=mess) for k in range(25)}
    df = spark.createDataFrame(rows(recordings), f"rec_id string, chunk_ix int, pos int, {TOKEN}").repartition(5)
    got = sorted(map(tuple, stitch.stitch(df, 4.0).select("rec_id", "pos", *COLUMNS).collect()))
    assert got == want(recordings)
    whole = stitch.chunk_chain(stitch.chunk_lists(df), 4.0, 0.25).groupBy("whole").agg(F.count_distinct("rec_id").alias("n"))
    by = {r.whole: r.n for r in whole.collect()}
    if mess:
        assert by.get(False, 0) > 0  # some are folded
    elif noise < 0.5:
        assert by.get(False, 0) == 0


def test_no_group_holds_a_recording(spark):
    df = spark.createDataFrame(rows({"r": recording(random.Random(1), 40)}), f"rec_id string, chunk_ix int, pos int, {TOKEN}")
    chunks = stitch.chunk_lists(df)
    plan = stitch.chunk_chain(chunks, 4.0, 0.25)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert chunks.agg(F.max(F.size("tokens"))).first()[0] < 40


def test_seam_matching():
    tok = lambda *xs: [(x, float(k)) for k, x in enumerate(xs)]
    assert stitch.contiguous_seam(tok(1, 2, 3, 4), tok(9, 2, 3, 8), 0.25) == (2, 2)
    assert stitch.contiguous_seam(tok(1, 2), tok(3, 4), 0.25) is None and stitch.seam([], tok(1), 0.25) is None
    assert stitch.subsequence_seam(tok(1, 2, 3), tok(1, 9, 3), 0.25) == (2, 2)
    assert stitch.seam([(1, 0.0)], [(1, 0.25)], 0.25) == (1, 1) and stitch.seam([(1, 0.0)], [(1, 0.26)], 0.25) is None


def chunk_rows(recordings):
    return [(r, c, len(chunks), tokens) for r, chunks in recordings.items() for c, tokens in enumerate(chunks)]


@pytest.mark.parametrize("keep", [0.5, 60.0])
def test_state_over_a_table_equals_the_fold(spark, keep):
    rng = random.Random(5)
    recordings = {f"r{k}": recording(rng, rng.randint(1, 9), noise=0.2, mess=0.2) for k in range(8)}
    log = stateful.stitch_log(spark.createDataFrame(chunk_rows(recordings), CHUNK).repartition(3), 4.0, keep_s=keep)
    got = sorted(map(tuple, stateful.stitched(log).select("rec_id", "pos", *COLUMNS).collect()))
    assert got == want(recordings)


def test_stream_takes_chunks_as_they_come(spark, tmp_path):
    """In any order and twice, over several runs: only what is touched is written, and all equals one fold."""
    rng = random.Random(8)
    recordings = {f"r{k}": recording(rng, 5, noise=0.2) for k in range(3)}
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = CHUNK + ", fingerprint struct<model:string>"
    every = [(*x, ("m",)) for x in chunk_rows(recordings)]
    rng.shuffle(every)
    late = [x for x in every if x[0] == "r2"]  # comes in a later run
    first = [x for x in every if x[0] != "r2"]
    decoded = []

    def run(some, files=None):
        for k, part in enumerate(some):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(src)
            decoded.append(k)
        query = stateful.stream_stitching(spark, src, schema, lambda c: c.drop("fingerprint"), out, ck, {"model": "m"}, 4.0, files=files)
        query.awaitTermination()
        return query

    again = first[:3]
    run([first[:4], [*first[4:7], (first[0][0], 7, 5, [], ("other",))], [*first[7:], *again]], files=1)
    log = spark.read.parquet(out)
    view = lambda: sorted(map(tuple, stateful.stitched(spark.read.parquet(out)).select("rec_id", "pos", *COLUMNS).collect()))
    done = {r: c for r, c in recordings.items() if r != "r2"}
    assert view() == want(done) and log.where("pos < 0").count() == 10
    before = log.count()
    query = run([[*late, *again]])
    assert view() == want(recordings)
    new = spark.read.parquet(out)
    assert new.count() - before == new.where("rec_id = 'r2'").count()  # nothing of the others is written again
    left = sum(int(s["numRowsTotal"]) for p in query.recentProgress for s in p["stateOperators"][-1:])
    assert left <= 3 * 3  # a finished recording leaves its mark alone


def test_stopped_stream_goes_on(spark, tmp_path):
    """Chunks 0 and 2 first: 2 waits in the store over the stop, and 1 lets both in."""
    recordings = {"a": recording(random.Random(3), 4)}
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    every = chunk_rows(recordings)

    def run(some):
        spark.createDataFrame(some, CHUNK).coalesce(1).write.mode("append").json(src)
        stateful.stream_stitching(spark, src, CHUNK, lambda c: c, out, ck, overlap_s=4.0).awaitTermination()
        return sorted(map(tuple, stateful.stitched(spark.read.parquet(out)).select("rec_id", "pos", *COLUMNS).collect()))

    assert run([every[2], every[0]]) == want({"a": recordings["a"][:1]})
    assert run([every[0]]) == want({"a": recordings["a"][:1]})
    assert run([every[1]]) == want({"a": recordings["a"][:3]})
    assert run([every[3]]) == want(recordings)
