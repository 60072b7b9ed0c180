"""What the dealt methods themselves give, against plain versions, and the cases off the main path."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from brute import WORD, components, lines, shingles
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import fingerprints, gru, lm, mixing, neardup, quality, substrings, toxicity, urls
from tideline.llm import lines as line_ops
from tideline.llm.tokens import span_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("hot, least", [(2_000, 10_000), (2_000, 0), (3, 2)])
def test_lines_by_the_sorted_stream_and_by_the_aggregate(spark, hot, least):
    rng = random.Random(hot + least)
    pool = [f"line number {k} of the pool" for k in range(40)]
    texts = {i: "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {k} {rng.random()}" for k in range(rng.randint(0, 150))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_ops.line_dedup(df, counts=True, hot=hot, least=least).collect()}
    assert got == lines(texts)


def test_lines_of_repeated_ids_and_clashing_names(spark):
    shared = "a line that all share"
    rows = [(1, shared, 7, 8), (2, f"own one of two\n{shared}", 7, 8), (2, "another text of two\nits second unique line", 7, 8), (2, f"{shared}\nits second unique line", 7, 8), (None, shared, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, WORDS int")
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in line_ops.line_dedup(df, counts=True).collect())
    assert got == [(0, shared, 1, 0), (1, shared, 1, 0), (2, "another text of two\nits second unique line", 2, 0), (2, "its second unique line", 2, 1), (2, "own one of two", 2, 1)]


def family(rng, n, words, change):
    base = [f"w{k}" for k in range(words)]
    return [" ".join(rng.choice(["x", "y"]) + str(rng.random()) if rng.random() < change else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("capacity", [1 << 20, 2_000])
def test_families_at_the_edge_of_likeness(spark, monkeypatch, capacity):
    """Groups whose texts share most keys and are linked here and there: every link counts, in one cell or in many."""
    monkeypatch.setattr(neardup, "CELL", capacity)
    rng = random.Random(7)
    texts = dict(enumerate(family(rng, 60, 60, 0.05) + family(rng, 40, 90, 0.035) + [None, "", "one"] + family(rng, 5, 300, 0.3)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 2, 80).collect()}
    want = components(texts, 2)
    assert got == want and 30 < len({c for _, c in want.values()}) < 100


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(1)
    a, b = (" ".join(f"{p}{rng.randrange(10**6)}" for _ in range(40)) for p in "ab")
    rows = [(1, a, 0), (2, b, 0), (2, a + " more", 0), (3, b, 0), (4, "", 0), (4, None, 0), (5, "", 0), (None, a, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted((r.id, r.component_id) for r in neardup.near_duplicates(df, 2, 80).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5)]
    assert sorted((r.doc_id or 0) for r in neardup.keep_one(df).collect()) == [0, 1, 4, 4, 5]


def test_signatures_never_hide_a_link():
    rng = np.random.default_rng(0)
    sets = []
    for n in (1, 5, 16, 17, 130, 900, 5_000):
        base = rng.integers(0, 2**63, n * 2, dtype=np.uint64)
        sets += [np.unique(base[:n]), np.unique(base[: n + n // 9]), np.unique(base[n // 12 : n]), np.unique(base[n // 2 : n + n // 2])]
    n = np.array([len(s) for s in sets])
    sign, at = neardup.signatures(np.concatenate(sets), n)
    a, b = (np.array(x) for x in zip(*[(i, j) for i, j in itertools.permutations(range(len(sets)), 2) if n[i] <= n[j]], strict=True))
    allowed = neardup._may_be_alike(a, b, n, sign, at, 80)
    alike = np.array([neardup._alike(sets[i], sets[j], 80) for i, j in zip(a, b, strict=True)])
    assert alike.sum() > 20 and not (alike & ~allowed).any()
    near = (100 * n[a] >= 80 * n[b]) & (n[b] < 1_500)
    assert (allowed & ~alike & near).sum() < 0.2 * near.sum()


def test_hashes_that_no_pattern_cancels():
    a, b = b"a", b"b"
    for _ in range(13):
        a, b = a + b, b + a
    flat = np.frombuffer(a + b, np.uint8)
    x, y = span_hashes(flat, np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
    assert x != y and span_hashes(flat, np.array([0]), np.array([len(a)]), step=1_000)[0] == x
    import pyarrow as pa

    m = quality.measures(pa.array([a.decode() + "\n" + b.decode()]))
    assert m["n_dup_lines"].tolist() == [0] and m["n_words"].tolist() == [2]


def test_hot_anchor_over_few_partitions(spark, monkeypatch):
    """An anchor whose stretches each chunk holds more often than a byte counts."""
    monkeypatch.setattr(substrings, "HOT", 900)
    gram = "THE-ONE-ANCHOR-OF-THEM-ALL"
    rng = random.Random(3)
    texts = {i: "".join(f"{rng.randrange(10**9):09d}{'x' * 12}{gram}{rng.randrange(10**9):09d}yyyyyyyyyyyy" for _ in range(8)) for i in range(150)} | {900 + i: f"{'x' * 12}{gram}{i:09d}yyyyyyyyyyyy" for i in range(40)}
    texts |= {2_000 + i: texts[i][100:400] for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    from brute import substrings as plain

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.substring_report(df).collect()}
    assert got == plain(texts)


def test_quotation_of_any_length():
    m = toxicity.Model(["idiot$"], [0.95], context={toxicity.QUOTES: math.log(toxicity.QUOTED)})
    long = "she wrote “one two three four five six seven eight nine ten eleven you idiot twelve thirteen fourteen fifteen sixteen seventeen” and left"
    plain, inside = m.score(long.replace("“", "").replace("”", "")), m.score(long)
    assert inside < plain and inside == pytest.approx(m.score('then "you idiot" was said'), abs=1e-9)
    for text in ('he said " you idiot', 'an "odd word" and you idiot', "it's you, idiot, 5\" tall", "« never closed you idiot"):
        assert m.score(text) == pytest.approx(plain)
    assert bytes(toxicity.quoted('a "b c" d „e f“ «g» h'.split())) == bytes([0, 1, 1, 0, 1, 1, 1, 0])


def test_quotation_prior_does_not_jump(spark):
    """How many clean rows hold a term says nothing of quotations that no row shows."""
    def shift(clean):
        rows = [(i, "a plain text with a vile idiot in it" if i < 60 else "some idiot of a clean row" if i < 60 + clean else "nothing of the kind is said here") for i in range(4_000)]
        lab = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "id long, toxic int")
        return toxicity.fit(spark.createDataFrame(rows, "id long, text string"), lab).context[toxicity.QUOTES]

    assert shift(0) == shift(3) == pytest.approx(math.log(toxicity.QUOTED))


def test_toxicity_scores_against_a_plain_version():
    terms, purity = ["idiot$", "scumb", "vile$"], [0.9, 0.8, 0.95]
    m = toxicity.Model(terms, purity, fuzzy=[0.7, 0.6, 0.5], forms={"idiott": (3, 1)}, context={"you": 0.5, "film": -1.0, toxicity.QUOTES: -1.2}, base=0.03)
    rng = random.Random(2)
    words = ["idiot", "idiott", "idoit", "scumbag", "scumball", "skumbag", "vile", "you", "film", "a", "of", '"idiot"', "mild"]

    def chance(word):
        bare = word.strip(toxicity.EDGE)
        if bare == "idiot":
            return 0, 0.9
        if bare == "idiott":
            return 0, (3 + 2 * 0.7) / 6
        if bare == "idoit":
            return 0, 0.7
        if bare.startswith("scumb"):
            return 1, 0.8
        return (2, 0.95) if bare == "vile" else None

    for _ in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        best = {}
        for i, w in enumerate(text):
            if (hit := chance(w)) is None:
                continue
            near = {x.strip(toxicity.EDGE) for x in text[max(0, i - 5) : i] + text[i + 1 : i + 6]}
            known = [v for k, v in (("you", 0.5), ("film", -1.0)) if k in near]
            odds = math.log(hit[1] / (1 - hit[1])) + (sum(known) / len(known) if known else 0.0) + (-1.2 if w == '"idiot"' else 0.0)
            best[hit[0]] = max(best.get(hit[0], 0.0), 1 / (1 + math.exp(-odds)))
        assert m.score(" ".join(text)) == pytest.approx(1 - 0.97 * math.prod(1 - p for p in best.values()))


def test_toxicity_of_empty_and_repeated_rows(spark):
    schema, lab = "doc_id long, text string, score int", "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    assert toxicity.toxicity_report(none, spark.createDataFrame([], lab)).count() == 0
    docs = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (None, None, 1)], schema)
    got = toxicity.toxicity_report(docs, spark.createDataFrame([(1, 1, None), (None, 1, 1)], lab)).collect()
    assert len(got) == 3 and {r.predicted for r in got} == {0} and all(0 <= r.score <= 1 for r in got)


def xx(x, seed):
    return xxhash.xxh64_intdigest(x, seed=seed & (1 << 64) - 1)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprint(text):
    """Shingles of five words, a minimum for each of 128 bins, empty bins filled along their own probes, four bits of each."""
    number = lambda v, n=8: (v & (1 << 8 * n) - 1).to_bytes(n, "little")
    words = [signed(xx(w.encode(), 42)) for w in WORD.findall(text)]
    bins = {}
    for k in range(max(1, len(words) - 4)) if words else []:
        h = 42
        for w in words[k : k + 5]:
            h = xx(number(w), h)
        h = signed(h)
        b = (h >> 57) + 64
        bins[b] = min(bins.get(b, h), h)
    if not bins:
        return ""
    out = 0
    for i in range(128):
        p = signed(xx(number(i, 4), 42))
        probes = ((p & 127) + a * (2 * (p >> 32 & 63) + 1) & 127 for a in range(128))
        z = bins[i] if i in bins else next(bins[b] for b in probes if b in bins)
        out = out << 4 | xx(number(i, 4), xx(number(z), 42)) & 15
    return f"{out:0128x}"


def test_fingerprints_against_a_plain_version(spark):
    rng = random.Random(5)
    texts = {i: " ".join(f"w{rng.randrange(50)}" for _ in range(n)) for i, n in enumerate([0, 1, 3, 4, 5, 6, 40, 200, 3_000])} | {20: "é ß 中 x\ty\nz", 21: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(df).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: plain_fingerprint(t or "").upper() for i, t in texts.items()}
    ids = sorted(texts)
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[i] or "", texts[nxt] or ""
        q = len(t) // 4
        assert got[i].edited_fingerprint == plain_fingerprint(t[: len(t) - q] + n[:q]).upper()


def test_lm_scores_against_a_plain_version(spark, monkeypatch):
    """The model's log-probability of whole texts, word by word in plain Python from the fitted parameters."""
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice("the a of Cat dog runs sees zeta eta".split()) for _ in range(rng.randint(0, 30))) for i in range(60)} | {70: None, 71: "never-seen The", 72: "the " * 700}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept, fit = {}, lm.fit

    def caught(docs, hashes, frequency):
        kept["flat"], kept["n"] = fit(docs, hashes, frequency), len(hashes)
        return kept["flat"]

    monkeypatch.setattr(lm, "fit", caught)
    monkeypatch.setattr(lm, "VOCABULARY", 5)
    got = {r.doc_id: r for r in lm.lm_report(df).collect()}
    low = lambda t: WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {}
    for i in train:
        for w in low(texts[i]):
            counts[w] = counts.get(w, 0) + 1
    size = max(5, int(math.sqrt(sum(counts.values()) + len(train))))
    assert kept["n"] == min(size, len(counts)) == len(counts)  # all words are in the vocabulary: their order is by count and hash
    frequent = sorted(counts, key=lambda w: -counts[w])
    assert len(set(counts.values())) == len(counts)
    ids = {w: k + 2 for k, w in enumerate(frequent)}
    shape = gru.Shape.of(kept["n"] + 2)
    p = {k: v.astype(np.float64) for k, v in gru.split(kept["flat"], shape).items()}
    h_ = gru.HIDDEN
    for i, t in texts.items():
        state, before, total = np.zeros(h_), gru.END, 0.0
        words = [*low(t), None]
        for k, w in enumerate(words):
            target = gru.END if w is None else ids.get(w, gru.UNK)
            g, u = p["x"][before], state @ p["u"]
            z, r = (1 / (1 + np.exp(-(g + u)[a : a + h_])) for a in (0, h_))
            state = z * state + (1 - z) * np.tanh(g[2 * h_ :] + r * u[2 * h_ :])
            y = np.append(state, 1.0)
            c, j = divmod(target, shape.width)
            for logits, at in ((y @ p["cw"], c), (y @ p["ww"][c], j)):
                total += logits[at] - np.log(np.exp(logits).sum())
            if target == gru.UNK:
                total += math.log(1 / 1)  # of words that training lacks there is one kind of place: (0 + 1) / (0 + 0 + 1)
            before = target
        assert got[i].score == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-4)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_lm_of_one_very_long_text_beside_many(spark):
    tokens = np.concatenate([np.full(400_000, 2), [1], np.tile([3, 1], 800)]).astype(np.int32)
    bounds = np.concatenate([[0], [400_001], 400_001 + np.cumsum(np.full(800, 2))])
    shape = gru.Shape.of(5)
    most = max(before.size for before, *_ in gru.windows(tokens, bounds))
    assert most <= max(gru.FILL, gru.STREAMS * gru.STEPS)
    ll = gru.log_likelihood(gru.start(shape, np.ones(5)), shape, tokens, bounds)
    assert len(ll) == 801 and np.isfinite(ll).all() and np.allclose(ll[1:], ll[1], rtol=1e-4)
    rows = [(None, "a b"), (None, "a b"), (3, "c"), (3, "c")]
    got = lm.lm_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and len({(r.doc_id, round(r.score, 6)) for r in got}) == 2


def test_training_windows_hold_every_symbol_once():
    rng = np.random.default_rng(3)
    sizes = np.append(rng.integers(1, 60, 300), [30_000, 2_500])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    tokens = rng.integers(2, 50, bounds[-1]).astype(np.int32)
    tokens[bounds[1:] - 1] = gru.END
    cut = gru.segments(bounds, 1_000)
    assert set(bounds) <= set(cut) and np.diff(cut).max() <= 1_000 and (np.diff(cut) > 0).all()
    seen = [(int(b), int(t)) for before, target, _, doc, _ in gru.windows(tokens, cut, 32, 512, bounds[:-1]) for b, t, d in zip(before.ravel(), target.ravel(), doc.ravel(), strict=True) if d >= 0]
    first = set(bounds[:-1].tolist())
    assert sorted(seen) == sorted((gru.END if k in first else int(tokens[k - 1]), int(tokens[k])) for k in range(len(tokens)))


def test_url_paths_of_any_depth_and_merged_branches(spark):
    rules_ = [("block", "h.com", "/a/b/c/d/bad"), ("allow", "h.com", "/a/b/c/d/good")]
    url = lambda leaf, i: f"http://h.com/a/b/c/d/{leaf}/{'q' if i % 2 else 'r'}{i}"
    rows = [(i, url("bad", i)) for i in range(40)] + [(100 + i, url("good", i)) for i in range(40)] + [(200 + i, f"http://h.com/{'/'.join('s' * 9)}/{i}") for i in range(3)]
    got = {r.id: (r.verdict, r.template) for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules_).collect()}
    assert {got[i][0] for i in range(40)} == {"block"} and {got[100 + i][0] for i in range(40)} == {"allow"}
    assert all(re.match(r"h\.com/.+/.+/.+/.+/.+/.+$", got[i][1]) for i in (0, 100)) and got[200][1].count("/") == 10
    # two branches that are blocked alike, two that are allowed alike: each pair is one template, with what is not labelled
    rules_ = [("block", "k.org", f"/{x}/x") for x in ("pa", "pb")] + [("allow", "k.org", f"/{x}/x") for x in ("qa", "qb")]
    rows = [(1_000 * k + i, f"http://k.org/{x}/{'x' if i < 30 else 'z'}{i}") for k, x in enumerate(("pa", "pb", "qa", "qb")) for i in range(32)]
    got = {r.id: (r.verdict, r.template.split("/")[1]) for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules_).collect()}
    assert {got[31], got[1_031]} == {("block", "~+")} and {got[2_031], got[3_031]} == {("allow", "~-")}


def test_many_sources_are_mixed_as_by_plain_filling(spark):
    rng = random.Random(9)
    sizes = {f"s{k:03d}": rng.choice([1, 5, 40, 1_000, 30_000]) * rng.randint(1, 9) for k in range(150)} | {None: 77}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [5, 2, 1], 3.0).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    free, capped = set(order), set()
    while True:
        level = (sum(sizes.values()) - sum(3.0 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if 3.0 * sizes[s] < level * weight[s]}
        if not more:
            break
        free, capped = free - more, capped | more
    assert len(capped) > 20 and all(got[s] == pytest.approx(3.0 * sizes[s] if s in capped else level * weight[s]) for s in order)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No rows; then nulls in all columns, repeated rows and ids, a column whose name clashes."""
    for name, rows in (("none", []), ("odd", [(1, None, None, None, None), (None, "x " * 80, "en", "a", 1), (2, " ".join(f"w{k}" for k in range(90)), "en", None, 5), (2, " ".join(f"w{k}" for k in range(90)), "en", None, 5), (2, " ".join(f"v{k}" for k in range(90)), None, "a", 5)])):
        docs = spark.createDataFrame(rows, DOCS)
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert len(got) == 0 if not rows else {r.doc_id for r in got} == {2} and {r.n_tokens > 90 for r in got} == {True}
    odd = spark.read.parquet(str(tmp_path / "odd/documents.parquet")).withColumns({"ids": F.lit(1), "n_dropped": F.lit(2), "print": F.lit(3), "component_id": F.lit(4)})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, "").count() >= 0
    for f in (quality.quality_filter, line_ops.line_dedup, neardup.keep_one, mixing.mix):
        assert f(odd).columns == odd.columns
    assert len(shingles("a b", 2)) == 1


@pytest.mark.parametrize("hot", [20_000, 0])
def test_stretches_that_cancel_out_modulo_two_to_the_64(spark, monkeypatch, hot):
    """Thue-Morse runs of two bytes collide under any polynomial modulo 2**64: a document that differs loses nothing."""
    monkeypatch.setattr(substrings, "HOT", hot)
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    prefix = "".join(random.Random(5).choices("cdefghij", k=200))
    one, other = (prefix + "".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    df = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    got = {r.id: len(r.kept) for r in substrings.substring_dedup(df, length=1224).collect()}
    assert got == {1: 1224, 2: 1224, 3: 0}
