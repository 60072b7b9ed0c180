"""Importance resampling against a plain version: features, gains, scores, ranks, ties, odd rows and tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from brute import UPPER
from pyspark.sql import functions as F

from tideline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def features(text, longest=1):
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, percent=10, least=20, buckets=10_000, seed=2024, longest=1):
    """(id, n_features, weight, score, rank) of rows (id, text); ties by id, then as rows come."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, longest)[1]))
    for text in target:
        t.update(map(bucket, features(text, longest)[1]))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for i, text in rows:
        words, f = features(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = {id(x): k + 1 for k, x in enumerate(fit[: percent * len(fit) // 100])}
    return sorted((x[0] if x[0] is not None else -1, *x[1:4], rank.get(id(x)) or 0) for x in out)


def got(df):
    return sorted((r.id if r.id is not None else -1, r.n_features, r.weight, r.score, r.rank or 0) for r in df.collect())


def corpus(rng, n):
    pool = [f"{c}{k}" for c in ("wörd", "Token", "naïve", "x") for k in range(60)]
    return [(i, " ".join(rng.choice(pool) + rng.choice(["", ".", "-", " 7 "]) for _ in range(rng.choice([0, 5, 19, 20, 60])))) for i in range(n)]


@pytest.mark.parametrize("percent, least, buckets, longest", [(10, 20, 10_000, 1), (37, 5, 64, 1), (100, 0, 50, 3), (0, 20, 10, 1)])
def test_scores_and_ranks(spark, percent, least, buckets, longest):
    rng = random.Random(percent + buckets)
    rows, target = corpus(rng, 150), [t for _, t in corpus(rng, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    x = resampling.ranked(docs, wanted, percent=percent, least_words=least, buckets=buckets, longest=longest)
    assert got(x) == plain(rows, target, percent, least, buckets, longest=longest)


def test_many_documents_of_one_score(spark, monkeypatch):
    """Rows of one id and text have one score: it is cut into pieces, and ranks run through."""
    rows = [(3, "one two three")] * 300 + [(4, "one two four")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    x = resampling.ranked(docs, spark.createDataFrame([("one",)], "text string"), percent=50, least_words=1)
    assert got(x) == plain(rows, ["one"], 50, 1)


def test_odd_rows_and_drawn_documents(spark):
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(1, None), (2, ""), (3, "é\x00\x7f è"), (None, text), (None, text + " more"), (5, text), (5, text), (6, text * 300), (7, "A a Á")]
    full = [(i, t, "en", "s", 0, "clash", 1) for i, t in rows]
    docs = spark.createDataFrame(full, DOCS + ", BUCKETS string, score int")
    target = spark.createDataFrame([(None,), ("w1 w2",)], "text string")
    x = resampling.ranked(docs, target, percent=60, least_words=1)
    want = plain(rows, [None, "w1 w2"], 60, 1)
    assert sorted(y[:4] for y in got(x)) == sorted(y[:4] for y in want) and sorted(y[4] for y in got(x)) == sorted(y[4] for y in want)
    drawn = resampling.resample(docs, target, percent=60, least_words=1)
    assert drawn.columns == docs.columns and drawn.count() == sum(1 for y in want if y[4])
    assert resampling.resample(docs, target, percent=100, least_words=1).where("text is not null").count() == 7


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c", "", "", 0)], DOCS)
    assert resampling.ranked(none, some).count() == 0 and resampling.resample(none, some).count() == 0
    assert got(resampling.ranked(some, none, percent=100, least_words=1)) == plain([(1, "a b c")], [], 100, 1)


def test_the_gains_are_one_constant_of_the_plan(spark):
    x = spark.range(2).select(F.aggregate(F.array(F.lit(1)), F.lit(0), lambda a, b: a + resampling.literal_array([4, 5], "int")[b]).alias("x"))
    assert "split(" not in x._jdf.queryExecution().optimizedPlan().toString() and x.first().x == 5
