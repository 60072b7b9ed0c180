"""Dedup of word windows against a plain version; hashes that do not cancel out; odd rows and tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, sha
from pyspark.sql import functions as F

from tideline.llm import windows
from tideline.llm.tokens import Words


def plain(rows, k=20):
    """(id, words, removed, digest of what is kept, spans) of rows (id, text) in the order of ids, those without first."""
    seen, out = set(), []
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if (key := tuple(w[j : j + k])) in seen:
                gone[j : j + k] = [True] * k
            seen.add(key)
        edge = [j for j in range(len(w) + 1) if (j < len(w) and gone[j]) != (j > 0 and gone[j - 1])]
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept), kept, [[a, b] for a, b in zip(edge[::2], edge[1::2], strict=True)]))
    return out


def corpus(rng, n, words=12):
    pool = [" ".join(f"w{rng.randrange(words)}" for _ in range(rng.randint(3, 60))) for _ in range(15)]
    gaps = [" ", "\n", "\t \r\n", "\x0b", " é "]
    return [(i, "".join(rng.choice(pool) + rng.choice(gaps) for _ in range(rng.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("k, n, parts", [(20, 120, 4), (1, 40, 3), (2, 60, 5), (7, 60, 1), (64, 60, 4)])
def test_windows_that_start_earlier_go(spark, k, n, parts):
    rng = random.Random(k)
    rows = corpus(rng, n)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    want = plain(sorted(rows), k)
    got = {r.doc_id: tuple(r) for r in windows.window_report(df, k).collect()}
    assert [got[x[0]] for x in want] == [x[:4] for x in want] and sum(x[2] for x in want) > 0
    got = {r.id: (r.kept, r.spans) for r in windows.window_dedup(df, k).collect()}
    assert [got[x[0]] for x in want] == [x[4:] for x in want]


def test_many_chunks(spark, tmp_path):
    """Each document a chunk of its own, or nearly so: what a bucket says decides all."""
    rows = corpus(random.Random(9), 90)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    chunks, n = windows.chunked(df, "doc_id", "text", chunk_bytes=100)
    assert n > 30
    finish = lambda ids, words, gone: pa.table([ids, pa.array(np.add.reduceat(np.append(gone, False), words.first[:-1]) * (words.count > 0), pa.int64())], ["id", "n"])
    got = dict(map(tuple, windows.repeated_windows(chunks, n, finish, "id long, n long", 20).collect()))
    assert got == {x[0]: x[2] for x in plain(rows)}
    place = chunks.groupBy("target").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("target").collect()
    assert all(x.b < y.a for x, y in zip(place[:-1], place[1:], strict=True))  # ranges, in order


def test_windows_of_one_group_and_one_word(spark):
    """Copies of one text, and one word all along: most of all rows share their windows."""
    copy = " ".join(f"c{k}" for k in range(50))
    rows = [(i, copy if i % 3 else "again " * (i % 70)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = {r.doc_id: tuple(r) for r in windows.window_report(df).collect()}
    assert [got[i] for i, _ in rows] == [x[:4] for x in plain(rows)]


def test_odd_rows(spark):
    long = " ".join(str(k) for k in range(30))
    rows = [(None, long), (1, None), (2, ""), (3, " \n\t"), (4, "few words"), (5, long), (5, long), (6, f"{long}\x00é {long}"), (7, "x " * 200_000)]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, body string, TARGET int")
    got = sorted(((r.id or 0, r.kept, r.spans) for r in windows.window_dedup(df).collect()), key=repr)
    assert got == sorted(((x[0] or 0, x[4], x[5]) for x in plain(rows)), key=repr)
    # rows of one id are documents in an order of their own: what one loses is kept by another
    two = spark.createDataFrame([(5, f"a {long}"), (5, f"b {long}")], "doc_id long, text string")
    assert sorted(r.n_removed for r in windows.window_report(two).collect()) == [0, 30]


def test_ids_of_other_types_and_empty_tables(spark):
    long = " ".join(str(k) for k in range(30))
    df = spark.createDataFrame([('b"', long), ("a", long), (None, "x")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_removed) for r in windows.window_report(df).collect()) == [("", 0), ("a", 0), ('b"', 30)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert windows.window_report(none).count() == 0 and windows.window_dedup(none).columns == ["id", "kept", "spans"]
    with pytest.raises(ValueError):
        windows.window_report(none, 0)


def test_hashes_equal_the_polynomial():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**64, 90, dtype=np.uint64)
    words[:3] = [0, 2**64 - 1, windows.PRIME]
    for k in (1, 2, 3, 20, 33):
        first, second = windows.rabin_karp(words, k)
        spread, mixed = windows.mix64(words), [int(x) for x in windows.mix64(words)]
        for i in range(len(words) - k + 1):
            want = sum(int(words[i + j]) * pow(windows.BASE, k - 1 - j, windows.PRIME) for j in range(k)) % windows.PRIME
            assert first[i] == windows.mix64(np.array([want], np.uint64))[0]
            assert second[i] == sum(mixed[i + j] * pow(windows.BASE64, k - 1 - j, 1 << 64) for j in range(k)) % (1 << 64)
        assert len(spread) == 90


def test_patterns_that_cancel_out_modulo_two_to_the_64(spark):
    """Thue-Morse runs of two words collide under any polynomial modulo 2**64, not under the other modulus."""
    bits = [bin(k).count("1") & 1 for k in range(2048)]
    a, b = (" ".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    first, second = windows.rabin_karp(Words(pa.array([a])).hash, 2048), windows.rabin_karp(Words(pa.array([b])).hash, 2048)
    assert first[1] == second[1] and first[0] != second[0]
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [r.n_removed for r in windows.window_report(df, 2048).collect()] == [0, 0]
