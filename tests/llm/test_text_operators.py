"""Text operators against plain versions, and the cases that tend to break them."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from brute import WORD, components, lines, quality, sha, shingles, substrings
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import bpe, bwt, fingerprints, gru, lm, mixing, neardup, toxicity, urls
from tideline.llm import lines as line_ops
from tideline.llm import quality as rules
from tideline.llm import substrings as subs
from tideline.llm.queries import RANKS

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "lé", "ga", "Xi", "тo"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    """Prose, copies, near copies, shared passages and lines, null, empty and blank texts, one long text."""
    rng = random.Random(3)
    base = [prose(rng, rng.choice([3, 12, 60, 150])) for _ in range(14)]
    passage, line = prose(rng, 60), "A line that is License-like, Version 2.0."
    docs = dict(enumerate(base))
    docs |= {20: base[3], 21: base[3].upper(), 22: base[5] + " more", 23: base[7] + "\n" + line, 24: line + "\n" + base[8] + "\n " + line.lower() + "\t", 25: prose(rng, 20) + passage + prose(rng, 5), 26: passage}
    docs |= {27: passage[10:150] + prose(rng, 9), 28: None, 29: "", 30: " \n\t ", 31: "one", 32: "One", 33: "x" * 5_000 + " " + passage, 34: "ab" * 200, 35: "é" * 49 + passage[:60], 36: "no no no no " * 40}
    words = base[9].split(" ")
    for k in range(6):
        w = list(words)
        for _ in range(k):
            w[rng.randrange(len(w))] = "zz%d" % k
        docs[40 + k] = " ".join(w)
    docs[46] = " ".join(words[:60] * 2)
    return docs


CORPUS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["a", "b", None, "é"][i % 4], 1) for i, t in CORPUS.items()]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings(docs, hot, monkeypatch):
    monkeypatch.setattr(subs, "HOT", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in subs.substring_report(docs).collect()}
    assert got == substrings(CORPUS)


def test_substring_spans_and_short_windows(docs, empty):
    got = {r.id: r for r in subs.substring_dedup(docs, 30).collect()}
    want = substrings(CORPUS, 30)
    assert {i: sha(bytes(r.kept)) for i, r in got.items()} == {i: x[3] for i, x in want.items()}
    assert {i: sum(b - a for a, b in r.spans) for i, r in got.items()} == {i: x[1] for i, x in want.items()}
    assert subs.substring_report(empty).count() == 0


@pytest.mark.parametrize("length", [24, 64, 65, 88, 120, 200])
def test_substrings_of_any_length(spark, length):
    rng = random.Random(length)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700))
    texts = {i: base[(a := rng.randrange(0, 300)) : a + rng.randrange(100, 400)] for i in range(12)}
    texts |= {20: base[:250] + "X" + base[251:], 21: base[:330] + "Y" + base[331:], 22: base}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: r for r in subs.substring_dedup(docs, length).collect()}
    want = substrings(texts, length)
    assert {i: (sum(b - a for a, b in r.spans), sha(bytes(r.kept))) for i, r in got.items()} == {i: (x[1], x[3]) for i, x in want.items()}


@given(st.lists(st.lists(st.text("ab", max_size=12), min_size=1, max_size=4), min_size=1, max_size=3))
@settings(max_examples=60, deadline=None)
def test_merged_transforms_sort_all_suffixes(shards):
    made, flat = [], []
    for strings in shards:
        raw = [s.encode() for s in strings]
        bounds = np.cumsum([0, *map(len, raw)])
        made.append((*bwt.transform(np.frombuffer(b"".join(raw), np.uint8), bounds, 16), bounds))
        flat.append(raw)
    z, common = bwt.merge([m[1] for m in made], [len(s) for s in shards], 16)
    suffix, at = [], [0] * len(shards)
    for j in z.tolist():
        p, bounds = made[j][0][at[j]], made[j][2]
        at[j] += 1
        starts = bounds[:-1] + np.arange(len(bounds) - 1)
        i = int(np.searchsorted(starts, p, "right")) - 1
        suffix.append((flat[j][i][p - starts[i] :], (j, i)))
    keys = [([b + 1 for b in s] + [0], mark) for s, mark in suffix]
    assert keys == sorted(keys)
    for (a, _), (b, _), n in zip(suffix[:-1], suffix[1:], common[1:].tolist(), strict=True):
        assert n == next((k for k in range(len(a) + 1) if k >= len(a) or k >= len(b) or a[k] != b[k]), None)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    got = {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k).collect()}
    assert got == components(CORPUS, k)


def test_near_duplicates_of_dense_groups(spark):
    """Every link counts where many near copies meet: components of a group whose members differ more and more."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    group = {}
    for i in range(70):
        w = list(base)
        for _ in range(rng.choice([2, 6, 9, 14])):
            w[rng.randrange(80)] = f"v{rng.randrange(10_000)}"
        group[i] = " ".join(w)
    df = spark.createDataFrame([(i, t) for i, t in group.items()], "doc_id long, text string")
    assert {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 2).collect()} == components(group, 2)
    kept = {r.doc_id for r in neardup.keep_one(df, 2).collect()}
    assert kept == {c for _, c in components(group, 2).values()}


def test_near_duplicates_without_rows(empty, spark):
    assert neardup.neardup_report(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (1, None), (1, "a b"), (1, "a b"), (2, "a b")], "doc_id long, text string")
    assert sorted(r.component_id for r in neardup.near_duplicates(odd, 2).collect()) == [1, 1, 1, 1]


def test_lines(docs, empty, spark):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_ops.line_report(docs).collect()}
    assert got == {i: (n, d, sha(t)) for i, (n, d, t) in lines(CORPUS).items()}
    assert line_ops.line_report(empty).count() == 0
    odd = spark.createDataFrame([(None, "the same long line", 1), (1, "the same long line", 2), (2, "The same long line ", 3)], "doc_id long, text string, __doc int")
    out = line_ops.line_dedup(odd).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "__doc"} and sorted(r.text for r in out) == ["", "the same long line", "the same long line"]


def test_hot_lines(spark):
    """A line of half of all documents is settled by its aggregate."""
    rows = [(i, f"Common line of many\nown line number {i}") for i in range(3_000)]
    got = line_ops.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True)
    assert got.agg(F.sum("n_dropped")).first()[0] == 2_999


def test_quality(docs, empty):
    got = {r.doc_id: tuple(r)[1:9] for r in rules.quality_report(docs).drop("longest_repeat").collect()}
    assert got == {i: quality(t) for i, t in CORPUS.items()}
    kept = {r.doc_id for r in rules.quality_filter(docs).collect()}
    assert kept == {i for i, t in CORPUS.items() if quality(t)[6]} and rules.quality_report(empty).count() == 0


@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=4))
@settings(max_examples=80, deadline=None)
def test_longest_repeats(texts):
    first = np.cumsum([0, *map(len, texts)])
    key = np.array([d * 10 + x for d, t in enumerate(texts) for x in t], np.uint64)
    want = [max([n for n in range(1, len(t) - i + 1) if any(t[j : j + n] == t[i : i + n] for j in range(len(t) - n + 1) if j != i)], default=0) for t in texts for i in range(len(t))]
    assert rules.longest_repeats(first, key).tolist() == want


def test_bpe_is_what_the_library_gives(docs, empty):
    ranks = bpe.load_ranks(RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: tuple(r)[1:] for r in bpe.bpe_report(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in CORPUS.items():
        ids = lib.encode_ordinary(t or "")
        assert got[i] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or ""))
    assert bpe.bpe_report(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    coder, rng = bpe.text_bpe(RANKS, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(3_000):
        t = "".join(rng.choice(["ab", "the", "é", "中", "🙂", " ", "\n", "1", "ing", "'s", "ß", "\x00", "<|endoftext|>"]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == lib.encode_ordinary(t)


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, "ab cd", 5), (2, None, 6)], "doc_id long, text string, decoded_ int")
    x = bpe.decode_column(bpe.encode_column(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert [(bytes(r.decoded), r.decoded_) for r in x.orderBy("doc_id").collect()] == [(b"ab cd", 5), (b"", 6)]
    clash = bpe.encode_column(df.withColumn("IDS", F.lit(1)), RANKS, public_tokenizers.PATTERN)
    assert clash.columns == ["doc_id", "text", "decoded_", "ids"] and clash.where("ids is null").count() == 0
    clash = bpe.round_trip_column(df.withColumn("Ids", F.lit(1)).withColumn("decoded_sha256", F.lit(2)), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.decoded_sha256 for r in clash.collect()} == {1: sha("ab cd"), 2: sha("")}


def test_bpe_side_by_side(monkeypatch):
    """Many pieces in step, with small stores, against the library and against one piece at a time."""
    ranks, rng = bpe.load_ranks(RANKS), random.Random(5)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = [*"abcdefghijklmnop qrstuvwxyzéßж中🙂\n'1", "ing", "tion", "\x00", "\x01", "   ", "zz" * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1_500)] + ["".join(map(chr, range(1, 40))), "x" * 9_000, "é" * 4_000]
    want = [np.array(lib.encode_ordinary(t), "<u4").tobytes() for t in texts]
    for keep, pairs in ((250_000, 1 << 18), (50, 1 << 4)):
        monkeypatch.setattr(bpe, "KEEP", keep)
        monkeypatch.setattr(bpe, "KEEP_PAIRS", pairs)
        coder = bpe.TextBpe(ranks, public_tokenizers.PATTERN)
        got = [x for k in range(0, len(texts), 300) for x in coder.encode_batch(texts[k : k + 300])]
        assert got == want and [coder.decode(x) for x in got] == [t.encode() for t in texts]
        assert len(coder.known) <= max(keep, len({p for t in texts[-300:] for p in coder.findall(t)}))


def test_fingerprints(docs, empty):
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(docs).collect()}
    ids, off = sorted(CORPUS), []
    for k, i in enumerate(ids):
        t, after = CORPUS[i] or "", CORPUS[ids[(k + 1) % len(ids)]] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        a, b, c = (set(w for w in [tuple(WORD.findall(x)[j : j + 5]) for j in range(max(1, len(WORD.findall(x)) - 4))] if w) for x in (t, edited, after))
        true = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        off += [r.near_edited - true(a, b), r.near_next - true(a, c)]
    assert got[3].fingerprint == got[20].fingerprint and got[3].fingerprint != got[21].fingerprint
    assert got[28].fingerprint == "" and got[29].near_next == 1.0 and np.abs(off).max() < 0.3 and np.abs(off).mean() < 0.05
    assert fingerprints.fingerprint_report(empty).count() == 0


def test_fingerprint_of_one_document_and_repeated_ids(spark):
    one = spark.createDataFrame([(1, "a b c d e f"), (1, "b"), (None, "x")], "doc_id long, text string")
    r = fingerprints.fingerprint_report(one).collect()
    assert len(r) == 1 and r[0].n_chars == 11 and r[0].near_next == 1.0


def fill(sizes, weights=(5, 2, 1), cap=3.0):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        t = {s: cap * sizes[s] if s in capped else left * w[s] / free for s in order}
        over = {s for s in order if s not in capped and t[s] > cap * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mixing(docs, empty):
    rows = mixing.mixing_report(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in CORPUS.items()}
    by = {}
    for i in CORPUS:
        s = ["a", "b", None, "é"][i % 4]
        by[s] = by.get(s, 0) + size[i]
    t = fill(by)
    for r in rows:
        s = ["a", "b", None, "é"][r.doc_id % 4]
        assert (r["size"], r.source_size) == (size[r.doc_id], by[s]) and r.target == pytest.approx(t[s]) and r.taken <= 3 * r["size"]
    for s in by:
        assert abs(sum(r.taken for r in rows if ["a", "b", None, "é"][r.doc_id % 4] == s) - t[s]) < 0.25 * t[s] + 20
    assert sorted(rows) == sorted(mixing.mixing_report(docs).collect()) and mixing.mixing_report(empty).count() == 0
    copies = mixing.mix(docs)
    assert copies.columns == docs.columns
    n = {r.doc_id: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    assert all(n.get(r.doc_id, 0) * r["size"] == r.taken for r in rows)


def test_mixing_of_skewed_sources(spark):
    sizes = {"a": 10, "b": 100_000, "c": 3, "d": 0, "e": 500}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, [5, 2, 1], 3.0).collect()}
    assert got == pytest.approx(fill(sizes)) and sum(got.values()) == pytest.approx(100_513)


def test_url_rules(spark):
    rows = [
        (1, "http://A.Example.COM/en/825?x=1"), (2, "https://www.example.com/en/7?"), (3, "x://shop.net/de/1#a"), (4, "x://a.example.net/de/88"), (5, "ftp://c.org/es/"), (6, "nothing"), (7, None), (8, "http://com/en/"),
        (9, "http://notexample.com/en/7"), (10, "http://h.com/fr/1"), (11, "://"), (12, "a://b://c/d"), (13, "http://x.com?/en/"), (7, None),
    ]
    got = {(r.page_id, r.host, r.path, r.rule) for r in urls.url_report(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        (1, "a.example.com", "/en/825", "com/en/"), (2, "www.example.com", "/en/7", "example.com/en/7"), (3, "shop.net", "/de/1", "net/de/"), (4, "a.example.net", "/de/88", "example.net/de/8"), (5, "c.org", "/es/", "org/es/"),
        (6, "", "", None), (7, "", "", None), (8, "com", "/en/", "com/en/"), (9, "notexample.com", "/en/7", "com/en/"), (10, "h.com", "/fr/1", None), (11, "", "", None), (12, "b:", "//c/d", None), (13, "x.com", "", None),
    }


def test_url_templates_learn(spark):
    rules_ = [("block", "h.com", "/bad/x"), ("allow", "h.com", "/good/x")]
    rows = [(i, f"http://h.com/bad/{'x' if i % 2 else 'y'}{i}") for i in range(40)] + [(100 + i, f"http://h.com/good/{'x' if i % 2 else 'y'}{i}") for i in range(40)]
    got = {r.id: r.verdict for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules_).collect()}
    assert {got[i] for i in range(40)} == {"block"} and {got[100 + i] for i in range(40)} == {"allow"}
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string"), rules_).count() == 0


def edits(a, b):
    """Restricted edit distance with transpositions."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_fuzzy_trie_against_edit_distance():
    terms = ["idiot$", "moron$", "worthless$", "scum$", "idol$"]
    trie, rng = toxicity.FuzzyTrie(terms), random.Random(4)
    for _ in range(3_000):
        w = list(rng.choice(terms).rstrip("$"))
        for _ in range(rng.randint(0, 3)):
            k, how = rng.randrange(len(w) + 1), rng.randrange(4)
            w = w[:k] + [rng.choice("abdiotms")] + w[k + (how == 1) :] if how < 2 else w[:k] + w[k + 1 :] if how == 2 else w[:k] + w[k : k + 2][::-1] + w[k + 2 :]
        word = "".join(w)
        near = [(edits(t[:-1], word), i) for i, t in enumerate(terms)]
        near = [(e, i) for e, i in near if e <= toxicity.errors_for(terms[i])]
        got = trie.match(word)
        assert (got is not None) == bool(near) and (got is None or got[1] == min(near)[0])


def test_toxicity_learns_terms_and_their_misspellings(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        words, bad = prose(rng, 40).split(" "), i % 5 == 0
        if bad:
            words[7], words[30] = rng.choice(["blarghy", "foulword"]), rng.choice(["blarghy", "zutnik"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(1_000, prose(rng, 20) + " Blagrhy, " + prose(rng, 20)), (1_001, None), (1_002, "")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, lab).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == int(i % 5 == 0) for i in held) / len(held) > 0.97
    assert got[1_000].predicted == 1 and got[1_001].predicted == got[1_002].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    none = toxicity.toxicity_report(docs, lab.limit(0)).agg(F.max("predicted")).first()[0]
    assert none == 0


def test_quotation_is_milder():
    m = toxicity.Model(["idiot$"], [0.6], context={toxicity.QUOTES: -1.6})
    assert m.score('he wrote "you idiot" and left') < m.score("you idiot and left")


def test_lm_counts_and_score(docs, empty):
    got = {r.doc_id: r for r in lm.lm_report(docs).collect()}
    low = lambda t: [*WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)})), None]
    counts = {}
    for i, t in CORPUS.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in low(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in CORPUS.items():
        w, r = low(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)) and r.score < 0
    assert lm.lm_report(empty).count() == 0


def test_gru_steps_gate_by_gate():
    """The parts that work on gates that lie together against plain ones: sums by symbol, tanh, and a whole training step."""
    rng = np.random.default_rng(3)
    ids = np.sort(np.concatenate([np.zeros(300, np.int64), np.full(8, 1), np.full(9, 2), rng.integers(3, 40, 60)]))
    x = rng.standard_normal((len(ids), 3 * gru.HIDDEN))
    edge = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    assert np.allclose(gru._sums(x, edge), np.add.reduceat(x, edge, axis=0), atol=1e-12)
    assert np.allclose(gru._sums(x[:1], edge[:1]), x[:1])
    v = np.array([-90.0, -3.0, -1e-4, 0.0, 0.5, 7.0, 90.0])
    assert np.allclose(gru._tanh(v.copy()), np.tanh(v), atol=1e-15)
    shape = gru.Shape.of(40)
    flat = gru.start(shape, np.ones(40))
    p, h = gru.split(flat, shape), rng.standard_normal((5, gru.HIDDEN)).astype(np.float32)
    tokens, first = rng.integers(0, 40, (7, 5)), rng.random((7, 5)) < 0.2
    hs, last, _ = gru.forward(p, tokens, first, h, False)
    for t in range(7):
        h = np.where(first[t][:, None], 0, h)
        g, hu = p["x"][tokens[t]], h @ p["u"]
        z, r = (1 / (1 + np.exp(-(g + hu)[:, k * gru.HIDDEN : (k + 1) * gru.HIDDEN])) for k in range(2))
        c = np.tanh(g[:, 2 * gru.HIDDEN :] + r * hu[:, 2 * gru.HIDDEN :])
        h = c + z * (h - c)
        assert np.allclose(hs[t], h, atol=1e-5)
    assert np.allclose(last, h, atol=1e-5)


def test_gru_gradient_and_carried_state():
    shape = gru.Shape.of(7)
    flat = gru.start(shape, np.ones(7)).astype(np.float64)
    rng = np.random.default_rng(0)
    tokens, bounds = np.append(rng.integers(2, 7, 30), 1).astype(np.int32), np.array([0, 31])
    whole = gru.log_likelihood(flat, shape, tokens, bounds)[0]
    h, total = np.zeros((1, gru.HIDDEN)), 0.0
    for t in range(31):  # a step at a time
        before = np.array([[tokens[t - 1] if t else gru.END]])
        hs, h, _ = gru.forward(gru.split(flat, shape), before, np.array([[t == 0]]), h, False)
        total += float(gru.output(gru.split(flat, shape), shape, hs[0], tokens[t : t + 1])[0][0])
    assert whole == pytest.approx(total, rel=1e-4)
    p, grad = gru.split(flat, shape), np.zeros_like(flat)
    before, target, first, doc, _ = next(gru.windows(tokens, bounds))
    loss = lambda f: -gru.output(gru.split(f, shape), shape, gru.forward(gru.split(f, shape), before, first, np.zeros((1, gru.HIDDEN)), False)[0].reshape(-1, gru.HIDDEN).astype(np.float64), target.reshape(-1))[0].sum()
    hs, _, tape = gru.forward(p, before, first, np.zeros((1, gru.HIDDEN)), True)
    _, dh = gru.output(p, shape, hs.reshape(-1, gru.HIDDEN).astype(np.float64), target.reshape(-1), gru.split(grad, shape))
    gru.backward(p, before, first, tape, dh.reshape(hs.shape), gru.split(grad, shape))
    for k in rng.choice(len(flat), 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-3
        down[k] -= 1e-3
        assert grad[k] == pytest.approx((loss(up) - loss(down)) / 2e-3, abs=2e-2)


def test_gru_learns_what_follows():
    rng = np.random.default_rng(1)
    docs = [np.append(np.tile(rng.permutation([2, 3, 4, 5]), 10), 1) for _ in range(200)]
    tokens, bounds = np.concatenate(docs).astype(np.int32), np.cumsum([0, *map(len, docs)])
    shape = gru.Shape.of(6)
    flat = gru.start(shape, np.bincount(tokens, minlength=6) + 1.0)
    before = gru.log_likelihood(flat, shape, tokens, bounds).sum()
    adam = gru.Adam(len(flat), 0.02)
    for _ in range(60):
        gru.train(flat, shape, tokens, bounds, adam)
    assert gru.log_likelihood(flat, shape, tokens, bounds).sum() > 0.6 * before


def test_words_of_arrays():
    texts = ["a  bc", None, "", "\x0bé\x1c ", "x"]
    from tideline.llm.tokens import Words

    w = Words(pa.array(texts))
    got = [bytes(w.flat[a:b]).decode() for a, b in zip(w.begin, w.end, strict=True)]
    assert got == [x for t in texts for x in WORD.findall(t or "")] and w.count.tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert len({frozenset(shingles("a b a b a", 2))}) == 1
